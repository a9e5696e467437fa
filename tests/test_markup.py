import time

import pytest

from courtside.operators.extract import extract_tables
from courtside.schemas import TOTALS
from courtside.sources.markup import Element, parse, shot_tooltips, stat_table


def table(inner: str, table_id: str = "totals_stats") -> str:
    return f'<html><body><table id="{table_id}">{inner}</table></body></html>'


def test_headers_of_all_rows_shift_the_keys():
    page = table(
        '<thead><tr><th data-stat="over">Per game</th></tr><tr><th data-stat="a">A</th><th>no key</th>'
        '<th data-stat="">empty</th><th data-stat="b">B</th></tr></thead><tbody><tr><td>1</td></tr></tbody>'
    )
    found = stat_table(page, "totals_stats", None)
    assert found["status"] == "ok"
    assert found["headers"] == ["over", "a", "b"]


def test_cells_without_end_tags_and_implied_body():
    page = table("<TR CLASS=x><TD>1<td DATA-APPEND-CSV=p1>two<th>3<tr><td>4")
    rows = stat_table(page, "totals_stats", None)["rows"]
    assert [r["cells"] for r in rows] == [["1", "two", "3"], ["4"]]
    assert rows[0]["append_csv"] == [None, "p1", None]
    assert rows[0]["row_class"] == "x"


def test_text_joins_nested_elements_and_decodes_references():
    page = table("<tbody><tr><td> O&#39;Neil <b>&amp;</b> <a href='?a=1&b=2'>Co</a><!-- no --></td></tr></tbody>")
    assert stat_table(page, "totals_stats", None)["rows"][0]["cells"] == [" O'Neil & Co"]


def test_nested_table_rows_and_cells_count_too():
    page = table("<tbody><tr><td>a<table><tr><td>b</td></tr></table></td></tr></tbody>")
    rows = stat_table(page, "totals_stats", None)["rows"]
    assert [r["cells"] for r in rows] == [["ab", "b"], ["b"]]


def test_table_in_comment_or_script_does_not_count():
    hidden = table("<tbody></tbody>")
    for page in (f"<!-- {hidden} -->", f"<script>var x='{hidden}'</script>", "<p>gone"):
        assert stat_table(page, "totals_stats", None)["status"] == "no_table"


def test_wrapper_holds_table_directly_or_in_first_comment():
    inner = '<table id="advanced"><tbody><tr><td>1</td></tr></tbody></table>'
    for page in (f'<div id="all_advanced">{inner}</div>', f'<div id="all_advanced"><p>x</p><!-- {inner} --></div>'):
        assert stat_table(page, "advanced", "all_advanced")["rows"][0]["cells"] == ["1"]
    for page in (
        f'<div id="all_advanced"></div>{inner}',
        f'<div id="all_advanced"><!-- ad --><!-- {inner} --></div>',
        f'<div id="all_advanced"><div><!-- {inner} --></div></div>',
    ):
        assert stat_table(page, "advanced", "all_advanced")["status"] == "no_table"


def test_odd_markup_is_survived():
    for page in ("", "<", "a < b", "<!-- open", "<td", '<a href="x', "</b></table>", "<b>" * 5000 + "x", "<!-->x-->"):
        stat_table(page, "totals_stats", None)
        shot_tooltips(page)
    assert parse("a < b <i>c</i>").text() == "a < b c"
    assert parse("<!-->x").text() == "x"


CHART = (
    '<div id="div_shot-chart"><div id="shot-wrapper"><div class="tooltip make" style="top:18px;left:244px;" '
    'tip="Jan 3, 2024, T01 at T02&lt;br&gt;1st Qtr, 11:22 remaining&lt;br&gt;Made 2-pointer from 18 ft'
    '&lt;br&gt;T01 leads 10-8"></div><div class="tooltip">x</div><div class="miss tooltip"></div></div></div>'
)


def test_shot_tooltips():
    page = f'<span itemprop="name">Site</span><div id="meta"><span itemprop=name>Player 1</span></div><!-- {CHART} -->'
    found = shot_tooltips(page)
    assert found["status"] == "ok" and found["player_name"] == "Player 1"
    assert [t["style"] for t in found["tooltips"]] == ["top:18px;left:244px;", ""]
    assert found["tooltips"][0]["tip"].split("<br>")[3] == "T01 leads 10-8"


def test_shot_page_without_comment_or_wrapper():
    assert shot_tooltips(CHART)["status"] == "no_comment"
    assert shot_tooltips("<!-- " + CHART.replace("shot-wrapper", "other") + " -->")["status"] == "no_wrapper"


def seconds(markup):
    start = time.perf_counter()
    parse(markup)
    return time.perf_counter() - start


@pytest.mark.parametrize(
    "shape",
    [
        lambda n: "<b>" * n + "</i>" * n,
        lambda n: "<div>" * n,
        lambda n: "<p><b>" * n,
        lambda n: '<b a="' * n,
        lambda n: "<b a='" * n + ">",
        lambda n: "<b a=\"x' " * n,
        lambda n: "<td>" * n + "</b>" * n,
        lambda n: "<tr><td>" * n,
        lambda n: "<!-- " * n,
        lambda n: "<title>" * n,
    ],
)
def test_bad_markup_takes_linear_time(shape):
    parse(shape(200))
    small, large = (min(seconds(shape(n)) for _ in range(3)) for n in (4000, 32000))
    assert large < 0.05 + 24 * small and large < 3


def test_what_follows_the_last_tag_is_kept():
    assert parse("<p>a<!-- x > y").children[0].children == ["a", " x > y"]
    assert parse("<title>a > b").children[0].children == ["a > b"]
    assert parse("<title>a</title></b>tail").text() == "atail"
    assert parse("<p>a</p>tail <b").text() == "atail <b"
    assert parse("no tags").text() == "no tags" and parse("").children == []


def test_a_failing_page_gets_a_status_row(spark):
    pages = spark.createDataFrame(
        [(1, 1998, None, '<table id="totals_stats">'), (2, 1998, False, table("<tbody></tbody>"))],
        "page_id bigint, season bigint, is_playoff boolean, html string",
    )
    found = {r.page_id: r for r in extract_tables(pages, TOTALS).collect()}
    assert found[1].status == "error" and "KeyError" in found[1].message and found[1].rows == []
    assert found[2].status == "ok" and found[2].message is None


def test_an_id_is_found_escaped_and_attributes_of_others_stay_unread(monkeypatch):
    page = '<div id="a&#108;l_x"><table id="t"><tr class="r"><td title="none">1<td>2</table></div>'
    assert [row["cells"] for row in stat_table(page, "t", "all_x")["rows"]] == [["1", "2"]]
    read = []
    attrs = Element.attrs.fget
    monkeypatch.setattr(Element, "attrs", property(lambda element: read.append(element.tag) or attrs(element)))
    stat_table('<p title="z"></p><div id="all_x"><table id="t"><tr><td title="none">1</table></div>', "t", "all_x")
    assert "p" not in read and "td" not in read
