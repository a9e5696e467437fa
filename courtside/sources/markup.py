"""Reading page markup: the one place where Python touches the data.

A page becomes a light element tree; the helpers below pick out table rows and shot
tooltips from it. All typing, cleaning and filtering happens later in Spark columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
RAW_TEXT = {
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript",
}
# An opening tag ends these open elements, searched up to the given boundary.
CLOSED_BY = {
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "li": ({"li"}, {"ul", "ol", "table", "td", "th"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = {
    "address", "article", "aside", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
TABLE_PARTS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}

_ATTRS = r"(?>=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=]+)*+"
# One match per token: the text before it, then a comment, a raw-text element with its
# body, a tag, other markup, or a lone "<" that belongs to the text.
TOKEN = re.compile(
    r"([^<]*)(?:"
    r"(<!--)(?:>|->|(.*?)(?:--!?>|\Z))"
    rf"|<({'|'.join(sorted(RAW_TEXT))})(?=[\s/>])({_ATTRS})>(.*?)(?:</\4\s*>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_ATTRS})>"
    r"|<[!?/][^>]*>"
    r"|(<)|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")

# Fixed value: the cell attribute that carries the player's id.
PLAYER_ATTRIBUTE = "data-append-csv"


class Element:
    __slots__ = ("tag", "source", "children", "parent", "depth", "_attrs")

    def __init__(self, tag: str, source: str, parent: Element | None):
        self.tag, self.source, self.parent, self.children = tag, source, parent, []
        self.depth = 0 if parent is None else parent.depth + 1
        self._attrs = None

    @property
    def attrs(self) -> dict:
        """Attributes, read from the tag's source on first use; of repeats the first counts."""
        if self._attrs is None:
            self._attrs = {}
            for name, double, single, bare in ATTRIBUTE.findall(self.source):
                self._attrs.setdefault(name.lower(), unescape(double or single or bare))
        return self._attrs

    def walk(self) -> list[Element]:
        """Descendant elements in document order, at any nesting depth."""
        found, pending = [], self.children[::-1]
        while pending:
            node = pending.pop()
            if type(node) is Element:
                found.append(node)
                if node.children:
                    pending += node.children[::-1]
        return found

    def comments(self):
        """Comments below this element in document order."""
        pending = self.children[::-1]
        while pending:
            node = pending.pop()
            if type(node) is Element:
                pending.extend(node.children[::-1])
            elif type(node) is Comment:
                yield node

    def below(self, marks, at_root: tuple = ()) -> list[tuple[Element, tuple]]:
        """Descendants in document order, each with which of ``marks`` some element above it meets.

        ``at_root`` says which hold for this element's own place; the tests are handed down, so no
        element walks back up.
        """
        held = at_root or tuple(False for _ in marks)
        held = tuple(h or mark(self) for h, mark in zip(held, marks))
        found, pending = [], [(child, held) for child in self.children[::-1] if type(child) is Element]
        while pending:
            node, held = place = pending.pop()
            found.append(place)
            # Most elements hold text alone, and nothing is handed down there.
            inside = [child for child in node.children[::-1] if type(child) is Element]
            if inside:
                inner = tuple([h or mark(node) for h, mark in zip(held, marks)])
                pending += [(child, inner) for child in inside]
        return found

    def text(self) -> str:
        if len(self.children) == 1 and type(self.children[0]) is str:
            return self.children[0]
        found, pending = [], self.children[::-1]
        while pending:
            node = pending.pop()
            if type(node) is Element:
                pending.extend(node.children[::-1])
            elif type(node) is str:
                found.append(node)
        return "".join(found)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Comment(str):
    """Comment text, kept apart from character data."""


class _Open:
    """The open elements: the innermost one, and for each tag those that are open, outermost first.

    Every element is opened and ended once, and what an end tag reaches is found by depth.
    """

    def __init__(self, root: Element):
        self.current = root
        self.by_tag: dict[str, list[Element]] = {}

    def push(self, element: Element) -> None:
        self.by_tag.setdefault(element.tag, []).append(element)
        self.current = element

    def end_through(self, depth: int) -> None:
        """End all elements at ``depth`` and deeper."""
        while self.current.depth >= depth:
            self.by_tag[self.current.tag].pop()
            self.current = self.current.parent

    def deepest(self, tags) -> int:
        depth = 0
        for tag in tags:
            held = self.by_tag.get(tag)
            if held and held[-1].depth > depth:
                depth = held[-1].depth
        return depth

    def unwind(self, closed: set, boundary: set) -> None:
        """End the outermost of ``closed`` that is open below the boundary, with all inside it."""
        floor, first = self.deepest(boundary), None
        for tag in closed:
            held = self.by_tag.get(tag)
            if held:
                at = bisect_right(held, floor, key=lambda element: element.depth)
                if at < len(held) and (first is None or held[at].depth < first):
                    first = held[at].depth
        if first is not None:
            self.end_through(first)

    def close(self, tag: str) -> None:
        """What an end tag closes; a stray one changes nothing.

        Nothing reaches out of a table, and inside a cell only table parts can be closed from within.
        """
        held = self.by_tag.get(tag)
        if not held:
            return
        depth = held[-1].depth
        if depth < self.deepest(("table",)) or (tag not in TABLE_PARTS and depth < self.deepest(("td", "th"))):
            return
        self.end_through(depth)


def parse(markup: str) -> Element:
    root = Element("", "", None)
    open_ = _Open(root)
    # Behind the last ">" no tag can end, so nothing there is searched for one.
    last = markup.rfind(">") + 1
    unended = None
    for match in TOKEN.finditer(markup, 0, last):
        if match.end() == match.start():
            break
        text, bang, comment, raw, raw_attrs, body, close, tag, attrs, lone = match.groups("")
        unended = None
        if text or lone:
            text += lone
            open_.current.children.append(unescape(text) if "&" in text else text)
        if tag:
            tag = tag.lower()
            if close:
                open_.close(tag)
                continue
            if tag in CLOSED_BY or tag in CLOSES_P:
                _prepare(open_, tag)
            element = Element(tag, attrs, open_.current)
            open_.current.children.append(element)
            if tag not in VOID:
                open_.push(element)
        elif bang:
            open_.current.children.append(Comment(comment))
            if comment and match.end(3) == last:
                unended = "comment"
        elif raw:
            raw = raw.lower()
            element = Element(raw, raw_attrs, open_.current)
            element.children.append(unescape(body) if raw in ("title", "textarea") else body)
            open_.current.children.append(element)
            if match.end(6) == last:
                unended = raw
    _add_rest(open_.current, markup[last:], unended)
    return root


def _add_rest(current: Element, rest: str, unended: str | None) -> None:
    """What follows the last ``>``: more of the comment or raw element left open there, else text."""
    if not rest:
        return
    if unended == "comment":
        current.children[-1] = Comment(current.children[-1] + rest)
    elif unended:
        current.children[-1].children[0] += unescape(rest) if unended in ("title", "textarea") else rest
    else:
        text, mark, comment = rest.partition("<!--")
        if text:
            current.children.append(unescape(text))
        if mark:
            current.children.append(Comment(comment))


def _prepare(open_: _Open, tag: str) -> None:
    """End what the new tag implicitly ends, and add the implied table parts."""
    if tag in CLOSED_BY:
        open_.unwind(*CLOSED_BY[tag])
    else:
        open_.unwind({"p"}, {"table", "td", "th"})
    if tag == "tr" and open_.current.tag == "table":
        _open_implied(open_, "tbody")
    elif tag in ("td", "th") and open_.current.tag in ("table", "tbody", "thead", "tfoot"):
        if open_.current.tag == "table":
            _open_implied(open_, "tbody")
        _open_implied(open_, "tr")


def _open_implied(open_: _Open, tag: str) -> None:
    element = Element(tag, "", open_.current)
    open_.current.children.append(element)
    open_.push(element)


def stat_table(markup: str, table_id: str, wrapper_id: str | None) -> dict:
    """Header keys and body rows of a statistics table.

    Without a wrapper the table may be anywhere in the live markup. With one it must lie
    in the wrapper, or in the first comment directly below it.
    """
    root = parse(markup)
    tables = _tables(root, table_id, wrapper_id)
    if not tables and wrapper_id:
        wrappers = list(filter(_has_id(wrapper_id), root.walk()))
        hidden = [c for w in wrappers for c in w.children if isinstance(c, Comment)]
        if hidden:
            tables = _tables(parse(hidden[0]), table_id, None)
    if not tables:
        return {"status": "no_table", "headers": [], "rows": []}
    headers, rows = [], []
    for table, place in tables:
        for element, (in_head, in_row, in_body) in table.below(_PARTS, place):
            if element.tag == "th" and in_head and in_row and element.attrs.get("data-stat"):
                headers.append(element.attrs["data-stat"])
            elif element.tag == "tr" and in_body:
                rows.append(_row(element))
    return {"status": "ok", "headers": headers, "rows": rows}


_PARTS = tuple((lambda element, tag=tag: element.tag == tag) for tag in ("thead", "tr", "tbody"))


def _has_id(value: str | None):
    """Test for an id; the attributes of a tag are read only where its source can hold it, as it is or escaped."""
    if value is None:
        return lambda element: False
    return lambda element: (value in element.source or "&" in element.source) and element.attrs.get("id") == value


def _tables(root: Element, table_id: str, wrapper_id: str | None) -> list[tuple[Element, tuple]]:
    """Outermost tables of that id (inside the wrapper), with the table parts around each."""
    wanted = lambda element: element.tag == "table" and element.attrs.get("id") == table_id
    marks = (wanted, *_PARTS, _has_id(wrapper_id))
    return [
        (element, held[1:4])
        for element, held in root.below(marks)
        if wanted(element) and not held[0] and (held[4] or not wrapper_id)
    ]


def _row(tr: Element) -> dict:
    cells = [cell for cell in tr.walk() if cell.tag in ("th", "td")]
    return {
        "row_class": tr.attrs.get("class", ""),
        "cells": [cell.text() for cell in cells],
        "append_csv": [
            cell.attrs.get(PLAYER_ATTRIBUTE) if PLAYER_ATTRIBUTE in cell.source.lower() else None
            for cell in cells
        ],
    }


def shot_tooltips(markup: str) -> dict:
    """Player name and the make/miss tooltips of a shot-chart page."""
    root = parse(markup)
    name = next(
        (
            e.text()
            for e, (in_meta,) in root.below((_has_id("meta"),))
            if in_meta and e.tag == "span" and e.attrs.get("itemprop") == "name"
        ),
        "",
    )
    outcome = {"status": "no_comment", "player_name": name, "tooltips": []}
    chart = next((c for c in root.comments() if 'id="div_shot-chart"' in c), None)
    if chart is None:
        return outcome
    is_chart = lambda e: e.tag == "div" and e.attrs.get("id") == "div_shot-chart"
    is_wrapper = lambda e: e.tag == "div" and e.attrs.get("id") == "shot-wrapper"
    # The outermost wrappers: what lies in a wrapper within a wrapper is below the outer one as well.
    taken: set[int] = set()
    wrappers = []
    for e, (in_chart, in_taken) in parse(chart).below((is_chart, lambda e: id(e) in taken)):
        if is_wrapper(e) and in_chart and not in_taken:
            taken.add(id(e))
            wrappers.append(e)
    if not wrappers:
        return outcome | {"status": "no_wrapper"}
    points = [e for w in wrappers for e in w.walk() if e.tag == "div" and _is_point(e)]
    tooltips = [{"style": e.attrs.get("style", ""), "tip": e.attrs.get("tip", "")} for e in points]
    return outcome | {"status": "ok", "tooltips": tooltips}


def _is_point(element: Element) -> bool:
    names = element.classes()
    return "tooltip" in names and ("make" in names or "miss" in names)
