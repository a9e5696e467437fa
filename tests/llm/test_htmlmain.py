import pytest

from courtside.llm import htmlmain as hm

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>para</b>graph\n with  text.</p><p>Second&nbsp;one.</p>"
EXPECTED = "Title & more First paragraph with text. Second one."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


CASES = {
    "plain": page(f"<nav><ul><li><a href='/x'>menu</a></ul></nav><article>{ARTICLE}</article><footer>foot</footer>"),
    "cut_off": page(f"<header>top</header><article>{ARTICLE}<footer>&copy; x</footer>").replace("</body></html>", ""),
    "open_tags": page("<article><h1>Title &amp; more</h1><p>First <b>para</b>graph with text.<br><p>Second one.</article>"),
    "scripts": page(f"<script>var t='</p><article>no</article>';</script><style>p{{}}</style><article>{ARTICLE}</article>"),
    "forms": page(f"<article>{ARTICLE}<form><input value=x><p>sign up</p></form><div class='share-box'>share</div></article>"),
    "comments": page(f"<article>{ARTICLE}</article><section id='comments'><p>{'reader words ' * 9}</p></section>"),
    "sidebar": page(f"<div class='sidebar'><p>{'side ' * 5}</p></div><article>{ARTICLE}</article><!-- <p>no</p> -->"),
    "cookie": page(f"<div class='cookie-notice'>We use cookies</div><article>{ARTICLE}<aside>note</aside></article>"),
    "classes": page(f"<div class='nav'>menu</div><div class='post-12 entry'>{ARTICLE}</div><div class='ad'>buy</div>"),
}


@pytest.mark.parametrize("name", CASES)
def test_own_best_container(name):
    assert hm.main_text(CASES[name], [])[0] == EXPECTED


def test_consensus_path_wins_over_an_odd_page(spark):
    usual = page(f"<div class='main-7'><div class='text'>{ARTICLE}</div></div><div class='extra'>{'<p>long words here</p>' * 2}</div>")
    odd = page(f"<div class='main-9'><div class='text'>{ARTICLE}</div></div><div class='extra'>{'<p>long words here</p>' * 60}</div>")
    rows = [(i, "http://a.example/x", usual, "p") for i in range(5)] + [(9, "http://A.example/y", odd, "p")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, paths string")
    paths = hm.winning_paths(pages)
    assert paths.first().paths[0] == ">div.main-0>div.text"
    found = {r.page_id: r.text for r in hm.extract(pages, paths).collect()}
    assert set(found.values()) == {EXPECTED}


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://b.example", "   "), (4, "http://b.example", "<<<>>> a < b"),
            (5, "http://b.example", "<p" * 2000), (6, "http://b.example", "<div>" * 3000 + "deep"), (None, "u", "<p>x</p>"),
            (7, "http://b.example", "</p></div>just text &am &#x41;"), (7, "http://b.example", "</p></div>just text &am &#x41;")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = hm.extract(pages, hm.winning_paths(pages)).collect()
    texts = [(r.page_id, r.text, r.n_chars) for r in found]
    assert len(texts) == len(rows) and all(n == len(t) for _, t, n in texts)
    assert (1, "", 0) in texts and (2, "", 0) in texts and (6, "deep", 4) in texts
    assert texts.count((7, "just text &am A", 15)) == 2
    empty = pages.limit(0)
    assert hm.extract(empty, hm.winning_paths(empty)).count() == 0


def test_whole_query_drops_what_is_around_the_article(spark, sf_dir):
    found = hm.query(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert found.count() == pages.count()
    import html
    import re

    sources = {r.page_id: r.html for r in pages.collect()}
    for r in found.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", sources[r.page_id], re.S)[1]
        plain = re.sub(r"<(b|/b|i|/i|a|/a)\b[^>]*>", "", article)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())


LEAD, BODY = "<p>" + "lead text " * 7 + "</p>", "<p>" + "body text " * 13 + "</p>"
WHOLE = ("lead text " * 7 + "body text " * 13).strip()


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='content'>{LEAD}<div class='body'>{BODY}</div></div><div class='ad'>buy</div>",
        f"<div class='content'>{LEAD}<div class='wrap'><div class='body'>{BODY}</div></div></div>",
        f"{LEAD}<div class='body'>{BODY}</div>",
        f"<article>{LEAD}<article class='embed'>{BODY}</article></article>",
        f"<article>{LEAD}<article class='comment'>{BODY}</article></article>",
        f"<main>{LEAD}<div class='body'>{BODY}</div></main>",
    ],
)
def test_text_around_the_deepest_container_stays(body):
    assert hm.main_text(page(body), [])[0] == WHOLE


def test_deep_containers_have_paths_of_their_own():
    deep = "<div class='{}'>" + "<div class='level'>" * 60 + "<p>{}</p>" + "</div>" * 61
    read = hm.Page(page(deep.format("one", "first") + deep.format("two", "second")))
    paths = [read.path[element] for element, text in read.pieces if text in ("first", "second")]
    assert len(set(paths)) == 2 and [read.text(p) for p in paths] == ["first", "second"]


def test_page_of_another_template_is_not_cut_to_a_teaser(spark):
    usual = page(f"<article>{BODY * 3}</article>")
    other = page(f"<div class='story'>{LEAD * 9}</div><div class='more'><article><p>Read this teaser</p></article></div>")
    short = page("<article><p>A short piece.</p></article>")
    rows = [(i, "http://a.example/x", usual) for i in range(8)] + [(8, "http://a.example/y", other), (9, "http://a.example/z", short)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    paths = hm.winning_paths(pages)
    assert paths.first().paths[0] == ">article"
    found = {r.page_id: r.text for r in hm.extract(pages, paths).collect()}
    assert found[8] == ("lead text " * 63).strip() and found[9] == "A short piece."
    assert {found[i] for i in range(8)} == {("body text " * 39).strip()}


@pytest.mark.parametrize("self_closed", ["<svg class=i />", "<svg/>", "<math />", "<object data='x'/>", "<iframe src=\"a>b\" />"])
def test_self_closed_foreign_elements_swallow_nothing(self_closed):
    assert hm.main_text(page(f"<article>{self_closed}{ARTICLE}</article>"), [])[0] == EXPECTED


@pytest.mark.parametrize(
    "body, text",
    [
        ('<article><h2 id="share-price">Share price</h2><p>rose today</p></article>', "Share price rose today"),
        ('<article><p class="search-engine-history">Engines</p><p>grew</p></article>', "Engines grew"),
        ('<article><pre>x = 1 <span class="token comment"># one</span></pre></article>', "x = 1 # one"),
        ('<article><p>foo<img src="a.png">bar</p></article>', "foobar"),
        ('<article><div class="search-engines"><p>Engines</p></div></article>', "Engines"),
        ('<article><p>text</p><div class="share-box">share</div><div class="search">find</div><p class="ad">buy</p></article>', "text"),
    ],
)
def test_marks_take_out_boxes_and_leave_text(body, text):
    assert hm.main_text(page(body), [])[0] == text


def test_a_loose_character_does_not_make_the_page_the_container():
    boxes = f"<div class='story'>{BODY * 4}</div><div class='extra'><p>other box</p></div>"
    assert hm.main_text(page(f"| {boxes}"), [])[0] == hm.main_text(page(boxes), [])[0] == ("body text " * 52).strip()


def test_text_beside_the_winning_path_stays(spark):
    usual = page(f"<div class='content'><div class='body'>{BODY * 5}</div></div>")
    lead = page(f"<div class='content'>{LEAD * 5}<div class='body'>{BODY * 5}</div></div>")
    rows = [(i, "http://a.example/x", usual) for i in range(8)] + [(8, "http://a.example/y", lead)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in hm.extract(pages, hm.winning_paths(pages)).collect()}
    assert found[8] == ("lead text " * 35 + "body text " * 65).strip() and found[0] == ("body text " * 65).strip()


def test_nested_blocks_in_open_paragraphs_take_linear_time():
    import time

    started = time.perf_counter()
    hm.main_text("<p><td>" + "<blockquote>" * 60_000 + "x", [])
    hm.main_text("<div>" * 50_000 + "<li>a" * 50_000, [])
    assert time.perf_counter() - started < 10
