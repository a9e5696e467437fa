import random

from courtside.llm import urlrules as ur


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for action, h, p in ur.HOST_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return host, path, best


def cases():
    rng = random.Random(4)
    parts = ["www.", "m.", "", "example", "Example", "other", ".com", ".net", ".org", "/en/", "/es/", "/fr", "/", "?a=/en/", "#x", "com", "://"]
    urls = ["http://" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    urls += [None, "", "no scheme.com/en/", "https://EXAMPLE.COM/en/x", "https://www.example.com/en/", "https://example.com/en",
             "https://notexample.com/en/", "https://example.com:80/en/", "ftp://net/es/", "https://x.net/es/../fr/", "a://b://c.com/",
             "https://x.org/tag/y", "https://x.org/login", "https://x.org/loginpage", "https://x.org/a.pdf", "https://x.org/?SESSIONID=1",
             "https://x.org/?sessionid=1", "https://x.org/wp-admin", "https://x.com/tag/1", "http://漢字.com/é"]
    return urls


def test_rules_equal_the_definition(spark):
    urls = cases()
    pages = spark.createDataFrame([(i, u, "r", 5) for i, u in enumerate(urls)], "page_id bigint, url string, rule string, weight int")
    found = {r.page_id: r for r in ur.judge(pages.unionByName(pages.limit(0)), ur.rule_table(spark), "page_id").collect()}
    assert len(found) == len(urls)
    for i, url in enumerate(urls):
        host, path, best = plain(url)
        assert (found[i].host, found[i].path) == (host, path), url
        if best:
            assert (found[i].rule, found[i].verdict) == best, url
    verdicts = {url: found[i].verdict for i, url in enumerate(urls)}
    assert verdicts["https://x.org/tag/y"] == verdicts["https://x.org/login"] == verdicts["https://x.org/?sessionid=1"] == "block"
    assert verdicts["https://x.org/loginpage"] == verdicts["https://x.org/?SESSIONID=1"] == verdicts["https://x.com/tag/1"] == "allow"


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/"), (2, "http://b.com/"), (3, "http://example.com/en/")], "page_id bigint, url string")
    counts = ur.token_counts(pages, "url")
    filed = {r.rule: r.token for r in ur.index_rules(ur.rule_table(spark), counts).collect()}
    assert filed["example.com/en/"] == "example" and filed["www.example.com/en/"] == "www" and filed["com/"] == "com"
    assert filed["/wp-admin"] == ""


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    none = spark.createDataFrame([], ur.RULE_DDL)
    assert [r.verdict for r in ur.judge(pages, none, "page_id").collect()] == ["allow"]
    assert ur.judge(pages.limit(0), ur.rule_table(spark), "page_id").count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    text = ur.query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_query_equals_its_sql(spark, sf_dir):
    from compare import check, connect

    assert check(spark, connect(sf_dir), "op6_url_filters", ur.query, ur.SQL, sf_dir) is None
