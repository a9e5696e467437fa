"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression together with literal tokens that every URL it fits must contain. Each
rule is filed under that one of its tokens that is rarest among the URLs at hand. A URL's own
tokens fetch the rules filed under them, and only these run their expression. The longest
rule that fits decides; a URL that none fits gets the default verdict.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no host
rule; a rule without tokens is filed under the empty token, which every URL has; of equally
long rules the one that sorts first decides; repeated rows are judged alike; without rules
all URLs get the default; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.llm.shared import source

DEFAULT = "allow"
# Action, host, path.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Rules of the method: path patterns of pages that are no articles. They yield to host rules.
PATTERN_RULES = (
    ("block", r"/(tags?|category|categories|archive|author)/"),
    ("block", r"/(login|signin|signup|register|logout)([/?.#]|$)"),
    ("block", r"/(cart|checkout|basket|wishlist)([/?.#]|$)"),
    ("block", r"/wp-(admin|login|json)"),
    ("block", r"[?&](sessionid|phpsessid|jsessionid)="),
    ("block", r"\.(jpg|jpeg|png|gif|css|js|zip|exe|pdf)$"),
)
_TOKEN = r"[a-z0-9]+"
_HOST_RANK, _PATTERN_RANK = 1_000_000, 0
RULE_DDL = "rule string, action string, pattern string, tokens array<string>, weight int"


def host_rule(action: str, host: str, path: str) -> tuple:
    """Fits the host and its subdomains where the path starts so. ``pattern`` is held against
    lower-cased host and path: ``//host`` and path."""
    pattern = rf"^//([^/]*\.)?{re.escape(host)}{re.escape(path)}"
    tokens = re.findall(_TOKEN, host)
    # A path's last token may go on in the URL, unless something else follows it in the rule.
    tokens += [t for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return (host + path, action, pattern, tokens, _HOST_RANK + len(host + path))


def pattern_rule(action: str, pattern: str) -> list[tuple]:
    """One rule per alternative of the first group, so that each has a literal token."""
    group = re.search(r"\(([^()]+)\)", pattern)
    made = []
    for choice in group[1].split("|") if group else [""]:
        whole = pattern[: group.start()] + choice + pattern[group.end() :] if group else pattern
        edge = pattern[group.start() - 1] if group and group.start() else ""
        end = pattern[group.end() :] if group else ""
        bounded = edge in "/]." and end[:1] in ("/", "(", "[", "=", "$", "")
        tokens = re.findall(_TOKEN, choice) if bounded and re.fullmatch(r"[a-z0-9]+", choice) and end else []
        made.append((whole, action, whole, tokens, _PATTERN_RANK + len(whole)))
    return made


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [host_rule(*rule) for rule in HOST_RULES]
    rows += [one for rule in PATTERN_RULES for one in pattern_rule(*rule)]
    return spark.createDataFrame(rows, RULE_DDL)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    """The text's distinct tokens, and the empty one."""
    return F.array_union(F.array(F.lit("")), F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def token_counts(urls: DataFrame, target: str) -> DataFrame:
    """(token, n): URLs holding each token; counted before the shuffle."""
    return urls.select(F.explode(_tokens(F.col(target))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def index_rules(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rules`` with ``token``: the rarest of their literal tokens, the empty one if they have none."""
    filed = rules.withColumn("token", F.explode_outer("tokens")).fillna({"token": ""})
    weighed = filed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "token")).alias("rarest")
    kept = weighed.groupBy("rule", "action", "pattern", "weight").agg(rarest)
    return kept.select("rule", "action", "pattern", "weight", F.col("rarest.token").alias("token"))


def judge(urls: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``key``, host, path, rule, verdict and weight for every row.

    Rows are grouped by URL while rules are matched, so a URL that many rows share is matched once.
    """
    split = urls.select(F.col(key).alias("_key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
                        F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^[^?#]*([^#]*)", 1).alias("_rest"))
    targeted = split.withColumn("_target", F.concat(F.lit("//"), "host", "path", "_rest"))
    counts = token_counts(targeted, "_target")
    filed = index_rules(rules, counts)
    distinct = targeted.select("_target").distinct()
    candidates = distinct.withColumn("token", F.explode(_tokens(F.col("_target")))).join(filed, "token")
    fits = candidates.where(F.regexp_like("_target", F.col("pattern")))
    best = fits.groupBy("_target").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "rule", "action")).alias("best")
    )
    judged = targeted.join(best, "_target", "left")
    return judged.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        (-F.col("best.w")).alias("weight"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(source(spark, sf_dir, "pages"), rule_table(spark), "page_id")
    base = F.col("weight") >= _HOST_RANK
    return judged.select("page_id", "host", "path", F.when(base, F.col("rule")).alias("rule"), "verdict")


SQL = r"""
WITH split AS (
  SELECT page_id,
    coalesce(CASE WHEN position('://' IN url) > 0 THEN
      translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN position('://' IN url) > 0 THEN
      regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path,
    coalesce(url, '') AS url
  FROM pages
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT s.page_id, r.rhost || r.rpath AS rule, r.action
  FROM split s JOIN rules r
    ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
), best AS (
  SELECT page_id, arg_min(rule, (-length(rule), rule)) AS rule, arg_min(action, (-length(rule), rule)) AS action
  FROM fits GROUP BY page_id
), patterns(pattern) AS (
  VALUES ('/(tags?|category|categories|archive|author)/'), ('/(login|signin|signup|register|logout)([/?.#]|$)'),
         ('/(cart|checkout|basket|wishlist)([/?.#]|$)'), ('/wp-(admin|login|json)'),
         ('[?&](sessionid|phpsessid|jsessionid)='), ('\.(jpg|jpeg|png|gif|css|js|zip|exe|pdf)$')
), own AS (
  SELECT DISTINCT s.page_id FROM split s JOIN patterns p
    ON regexp_matches('//' || s.host || s.path || regexp_extract(s.url, '^[^?#]*([^#]*)', 1), p.pattern)
)
SELECT s.page_id, s.host, s.path, b.rule,
  coalesce(b.action, CASE WHEN o.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b USING (page_id) LEFT JOIN own o USING (page_id)
"""
