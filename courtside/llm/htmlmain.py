"""Main text of web pages by consensus paths per host.

Each page's containers are scored by the text they hold outside menus, adverts and the like. The
deepest one with most of the text is widened to the outermost article or, where there is none, to each
container around it that adds text. It votes, with its generalised tag-class path, for its host; Spark counts the votes. Every
page is then read again with its host's winning paths, and only where none of them
holds a fair share of the text with the page's own best container.

Defined cases: null or empty html gives an empty text; a page without a url belongs to the empty
host; markup that is cut off or badly nested is read as far as it goes; equal votes take the path
that sorts first; repeated pages vote again and each get a row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from courtside.llm.shared import chunks, source
from courtside.workspace import staged

# Winning paths kept per host.
PATHS = 3
# A container must hold this share of the page's text; the deepest such one is the best.
SHARE = 0.6
ARTICLE_SHARE = 0.2
# A winning path counts on a page where it holds this share of the text of the page's own best container.
NEARLY = 0.99
# Where the page has more text elsewhere, a path still counts if it holds this share of what it holds on the host's
# pages on average and the element around it adds nothing.
FAIR = 0.5
# Text in no container makes the whole page the container from this share of the page's text on.
LOOSE_SHARE = 0.05
# A path longer than this is kept as a hash of the whole of it.
LONG_PATH = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s "
    "samp small source span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("head nav header footer aside form button select option menu dialog".split())
CONTAINERS = frozenset("article main section div td body center".split())
# Elements whose start closes an open paragraph, and those that close one of their own kind.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot select body article section div".split())
# Words of class, id or role names that mark what is not the article: the first ones wherever they stand in a name, the
# others only as a whole name or its last word, since they are topics of articles as well.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo cookie cookies "
    "consent gdpr popup modal overlay newsletter paywall nav navbar "
    "navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead comment comments "
    "disqus replies pagination pager toolbar complementary contentinfo".split()
)
TOPICS = frozenset(
    "banner promotion notice notices alert subscribe subscription menu aside header discussion respond share sharing social "
    "related recommended recommendations search login signup".split()
)
# Words after which a topic's name is still that of a box: share-box, search-form, menu-list.
BOXES = frozenset("box bar form list area block links buttons wrapper container inner outer top bottom left right".split())
# Elements that a mark can take out of the article; headings, paragraphs, preformatted text and what stands in a line are text.
MARKABLE = frozenset(
    "div section ul ol dl li table tbody tr td th center details fieldset figure iframe article main blockquote p".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math|object|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|object|math|title)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


def _marks(name: str, tag: str) -> bool:
    """Whether a class, id or role name marks what is not the article."""
    parts = _PART.findall(name)
    if not parts:
        return False
    if tag == "p":  # a paragraph is text unless its whole name says otherwise
        return len(parts) == 1 and parts[0] in MARKS
    if not MARKS.isdisjoint(parts):
        return True
    last = parts[-2] if len(parts) > 1 and parts[-1] in BOXES else parts[-1]
    return last in TOPICS


class Page:
    """Elements with their parents, paths and drop marks, and the text pieces in page order."""

    def __init__(self, markup: str):
        self.parent, self.tag, self.path, self.dropped, self.marked = [-1], [""], [""], [False], [False]
        self.depth = [0]
        self.pieces: list[tuple[int, str]] = []  # (element, text); a lone space is a block's edge
        # For each tag, where its open elements lie in the stack.
        stack, open_tags = [0], {}
        at = 0
        for match in _TOKEN.finditer(markup):
            if match.start() > at:
                self.pieces.append((stack[-1], entities.unescape(markup[at : match.start()])))
            at = match.end()
            tag = match["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                self.pieces.append((stack[-1], " "))
            if match["end"]:
                if open_tags.get(tag):
                    self._close(stack, open_tags, {tag})
                continue
            if tag in CLOSES_P and open_tags.get("p"):
                self._close(stack, open_tags, {"p"}, CONTAINERS)
            elif tag in SIBLINGS and any(open_tags.get(t) for t in SIBLINGS[tag]):
                self._close(stack, open_tags, SIBLINGS[tag], LISTS)
            if tag in VOID:
                continue
            self._open(stack[-1], tag, match["rest"])
            if not match["rest"].endswith("/") or tag not in INLINE:
                open_tags.setdefault(tag, []).append(len(stack))
                stack.append(len(self.parent) - 1)
        if at < len(markup):
            rest = markup[at:]
            cut = re.search(r"<[a-z/!?][^>]*\Z", rest, re.I)  # a tag that the end of the page cuts off
            self.pieces.append((stack[-1], entities.unescape(rest[: cut.start()] if cut else rest)))

    def _close(self, stack: list[int], open_tags: dict[str, list[int]], tags: set[str], walls: frozenset = frozenset()) -> None:
        """Pop to the nearest open element of ``tags``, unless an element of ``walls`` is in between."""
        nearest = max((open_tags[tag][-1] for tag in tags if open_tags.get(tag)), default=0)
        wall = max((open_tags[tag][-1] for tag in walls - tags if open_tags.get(tag)), default=0)
        if nearest and nearest > wall:
            for element in stack[nearest:]:
                open_tags[self.tag[element]].pop()
            del stack[nearest:]

    def _open(self, parent: int, tag: str, rest: str) -> None:
        classes: list[str] = []
        marked = False
        if rest:
            for name, a, b, c in _NAMED.findall(rest):
                value = (a or b or c).lower()
                marked |= tag in MARKABLE and any(_marks(token, tag) for token in value.split())
                if name.lower() == "class":
                    classes = sorted({re.sub(r"\d+", "0", token) for token in value.split()})
        self.parent.append(parent)
        self.tag.append(tag)
        step = ".".join([tag, *classes])
        above = self.path[parent]
        path = "" if tag in ("html", "body") else f"{above}>{step}"
        if len(path) > LONG_PATH:
            path = "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.path.append(path)
        self.marked.append(marked)
        self.dropped.append(tag in DROPPED or (marked and tag not in ("html", "body", "article", "main")))
        self.depth.append(self.depth[parent] + 1)

    def _hidden(self, drop: bool = True) -> list[bool]:
        """Which elements lie in dropped ones."""
        hidden = [False] * len(self.parent)
        for i in range(1, len(hidden)):
            hidden[i] = hidden[self.parent[i]] or (self.dropped[i] and (drop or self.tag[i] != "form"))
        return hidden

    def best(self) -> tuple[str, int] | None:
        """(path, characters) of the best container."""
        for drop in (True, False):  # a form around a whole page is no form of it
            hidden = self._hidden(drop)
            held, block = [0] * len(hidden), [0] * len(hidden)
            loose = 0  # text that no container but the body holds
            linked = [False] * len(hidden)
            for i in range(1, len(hidden)):
                linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
                block[i] = i if self.tag[i] in CONTAINERS and self.path[i] else block[self.parent[i]]
            for element, text in self.pieces:
                if not hidden[element] and not linked[element]:
                    size = len(text.strip())
                    held[element] += size
                    loose += 0 if block[element] else size
            for i in range(len(held) - 1, 0, -1):
                held[self.parent[i]] += held[i]
            if held[0]:
                break
        else:
            return None
        found = [
            i for i in range(1, len(held))
            if not hidden[i] and (
                (self.tag[i] in CONTAINERS and held[i] >= SHARE * held[0])
                or (self.tag[i] in ("article", "main") and held[i] >= ARTICLE_SHARE * held[0])
            )
        ]
        if not found:
            return ("", held[0])
        best = max(found, key=lambda i: (self.tag[i] == "article", self.depth[i], held[i], -i))
        best = self._widened(best, held, loose)
        return (self.path[best], held[best])

    def _widened(self, best: int, held: list[int], loose: int) -> int:
        """The outermost article or main element around ``best``; without one, the outermost element
        that adds text. The page itself only if it has text that lies in no container."""
        above = [best]
        while self.parent[above[-1]] >= 0:
            above.append(self.parent[above[-1]])
        named = [i for i in above if self.tag[i] == "article" and not self.marked[i]]
        named = named or [i for i in above if self.tag[i] in ("article", "main")]
        if named:
            return named[-1]
        if loose >= LOOSE_SHARE * held[0] and loose:
            return 0
        for i in above:
            if self.path[i] and held[i] > held[best]:
                best = i
        return best

    def text(self, path: str) -> str:
        """Text of the outermost elements with ``path``, without what is dropped inside."""
        inside, hidden = [path == ""] + [False] * (len(self.parent) - 1), [False] * len(self.parent)
        for i in range(1, len(inside)):
            up = self.parent[i]
            inside[i] = inside[up] or self.path[i] == path
            # Marks above the container do not count; those within it do.
            hidden[i] = inside[up] and (hidden[up] or self.dropped[i])
        return " ".join("".join([t if inside[e] and not hidden[e] else " " for e, t in self.pieces]).split())


def best_container(markup: str | None) -> tuple[str, int] | None:
    return Page(markup).best() if markup else None


def main_text(markup: str | None, paths: list[str], sizes: list[int] | None = None) -> tuple[str, str | None]:
    """(text, the path it came from): the first of ``paths`` that holds a fair share, else the page's own.

    ``sizes``: how many characters each path holds on average. A path counts if it holds nearly all of what the page's
    own best container holds. It also counts beside other boxes of the page, if it holds enough of that average and no
    text stands next to it in the element around it: such text is a part of the article that the template does not know.
    """
    if not markup:
        return "", None
    page = Page(markup)
    own = page.best()
    own_text = page.text(own[0]) if own else ""
    for path, size in zip(paths, sizes or [0] * len(paths)):
        found = own_text if own and path == own[0] else page.text(path)
        if not found:
            continue
        if len(found) >= NEARLY * len(own_text):
            return found, path
        around = path.rpartition(">")[0]
        alone = len(page.text(around)) <= len(found) if around else own[0] != ""
        if size and len(found) >= FAIR * size and alone:
            return found, path
    return (own_text, own[0]) if own else ("", None)


def host_of(url: Column) -> Column:
    """Lower-cased host between the first ``://`` and the next ``/``, ``?`` or ``#``; else empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


def container_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, chars): how many pages of a host have their best container there."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 4 << 20):
                votes: dict[tuple[str, str], list[int]] = {}
                for host, markup in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    best = best_container(markup)
                    if best:
                        count = votes.setdefault((host, best[0]), [0, 0])
                        count[0] += 1
                        count[1] += best[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()),
                     pa.array([v[0] for v in votes.values()], pa.int64()), pa.array([v[1] for v in votes.values()], pa.int64())],
                    names=["host", "path", "votes", "chars"],
                )

    read = pages.select(host_of(F.col("url")).alias("host"), "html")
    counted = read.mapInArrow(score, "host string, path string, votes bigint, chars bigint")
    return counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))


def winning_paths(pages: DataFrame, most: int = PATHS) -> DataFrame:
    """(host, paths, sizes): up to ``most`` paths per host, the one with most votes first, and their mean characters."""
    ranked = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("chars"), "path")
    votes = container_votes(pages).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)
    size = F.floor(F.col("chars") / F.col("votes")).alias("size")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "path", size)))
    return votes.groupBy("host").agg(
        F.transform(ordered, lambda x: x["path"]).alias("paths"), F.transform(ordered, lambda x: x["size"]).alias("sizes")
    )


def extract(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) for every page, by its host's winning paths."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 4 << 20):
                found = [
                    main_text(markup, ranked or [], sizes)
                    for markup, ranked, sizes in zip(
                        part.column("html").to_pylist(), part.column("paths").to_pylist(), part.column("sizes").to_pylist()
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([f[0] for f in found], pa.string()),
                     pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())],
                    names=["page_id", "url", "text", "n_chars", "path"],
                )

    hosted = pages.select(F.col("page_id").cast("bigint"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = hosted.join(paths, "host", "left").select("page_id", "url", "html", "paths", "sizes")
    return joined.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = source(spark, sf_dir, "pages")
    # Stored first, so that its size is known and Spark need not shuffle the pages where it is small.
    return extract(pages, staged(winning_paths(pages), "host-paths"))
