"""Fields of HTML pages by rule: one pass over each page inside an Arrow batch.

Python only finds the raw texts the rules name; everything made of them (dates, prices, names,
URLs) is a column expression afterwards, see `records`.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An opening tag of the key ends an open element of the value.
ENDS = {
    "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_STEP = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[^\]]+\]|:not\([^)]+\))*)(?::eq\((-?\d+)\))?$")
_TESTS = {
    "": lambda a, v: True, "=": lambda a, v: a == v, "*=": lambda a, v: v in a,
    "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v),
}
#: A `&` that begins no entity with a semicolon; scripts and styles, in which none is decoded, are passed over.
_BARE = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([*^$]?=)['\"]?([^'\"\]]*)['\"]?)?\]|:not\(\.([\w-]+)\)")


class Node:
    """An element: its descendants are the nodes, and its text the parts, between two places of the page."""

    __slots__ = ("attrs", "classes", "end", "page", "part", "parts_end", "start", "tag")

    def __init__(self, page: Page, tag: str, attrs: dict[str, str]):
        self.page, self.tag, self.attrs = page, tag, attrs
        self.classes = attrs.get("class", "").split()
        self.start, self.part = len(page.nodes), len(page.parts)
        self.end = self.parts_end = 0

    def text(self) -> str:
        return "".join(p for p in self.page.parts[self.part : self.parts_end] if p is not None)

    def block(self) -> str:
        """The text with its line breaks."""
        return "".join("\n" if p is None else p for p in self.page.parts[self.part : self.parts_end])


class Page(HTMLParser):
    """All elements of a page in document order, with where each tag and class occurs, from one parse.

    Nothing here calls itself, so pages may be nested to any depth.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.parts: list[str | None] = []
        self.by_tag: dict[str, list[int]] = {}
        self.by_class: dict[str, list[int]] = {}
        self.root = Node(self, "", {})
        self.nodes.append(self.root)
        self.stack = [self.root]
        self.feed(html)
        self.close()
        while self.stack:
            self._pop()

    def _pop(self) -> str:
        node = self.stack.pop()
        node.end, node.parts_end = len(self.nodes), len(self.parts)
        return node.tag

    def handle_starttag(self, tag, attrs):
        while self.stack[-1].tag in ENDS.get(tag, ()):
            self._pop()
        node = Node(self, tag, {k: v or "" for k, v in attrs})
        self.nodes.append(node)
        self.by_tag.setdefault(tag, []).append(node.start)
        for c in node.classes:
            self.by_class.setdefault(c, []).append(node.start)
        self.stack.append(node)
        if tag in VOID:
            self._pop()
        if tag == "br":
            self.parts.append(None)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.stack[1:]):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        self.parts.append(data)


def tree(html: str, closed_entities: bool = False) -> Node:
    """`closed_entities`: an entity without its semicolon is text, as in a title that was cut."""
    if closed_entities:
        html = _BARE.sub(lambda m: m[0] if m[1] else "&amp;", html)
    return Page(html).root


@cache
def _steps(selector: str) -> list[list[tuple]]:
    """Per alternative its steps: tag, class to look up, all tests, position."""
    out = []
    for alternative in selector.split(","):
        steps = []
        for step in alternative.split():
            tag, parts, nth = _STEP.match(step).groups()
            first, checks = None, []
            for mark, name, attr, op, value, without in _PART.findall(parts):
                if mark == ".":
                    first = first or name
                    checks.append(lambda n, v=name: v in n.classes)
                elif mark == "#":
                    checks.append(lambda n, v=name: n.attrs.get("id") == v)
                elif without:
                    checks.append(lambda n, v=without: v not in n.classes)
                else:
                    checks.append(lambda n, k=attr, v=value, t=_TESTS[op]: k in n.attrs and t(n.attrs[k], v))
            if tag not in (None, "*"):
                checks.append(lambda n, v=tag: n.tag == v)
            steps.append((None if tag in (None, "*") else tag, first, checks, None if nth is None else int(nth)))
        out.append(steps)
    return out


def select(root: Node, selector: str) -> list[Node]:
    """Descendants that match, in document order; `,` separates alternatives, blanks descend."""
    page, wanted = root.page, set()
    for steps in _steps(selector):
        found = [root.start]
        for tag, first, checks, nth in steps:
            places = page.by_class.get(first, ()) if first else page.by_tag.get(tag, ()) if tag else range(len(page.nodes))
            seen, hits = set(), []
            for base in found:
                low, high = bisect_right(places, base), bisect_left(places, page.nodes[base].end)
                for i in places[low:high]:
                    if i not in seen and all(c(page.nodes[i]) for c in checks):
                        seen.add(i)
                        hits.append(i)
            found = hits if nth is None else hits[nth:][:1]
        wanted.update(found)
    return [page.nodes[i] for i in sorted(wanted)]


def _values(scope: Node, html: str, selector: str, attr: str) -> list[str]:
    """Raw texts of one rule.

    `text`; `block` (text with line breaks kept); `self` (that of the item); `=label` (selector
    "keys || values": the value next to that label); `>label` (selector "rows || key || value": the
    values in the first row with that key); `linked` (address, line break, text of each link); `re`
    (the selector is a pattern on the page source); else an attribute.
    """
    if attr == "re":
        return re.findall(selector, html)
    if attr.startswith("="):
        keys, values = (select(scope, s) for s in selector.split("||"))
        pairs = {k.text().strip(): v.text().strip() for k, v in zip(keys, values)}
        return [pairs[attr[1:]]] if attr[1:] in pairs else []
    if attr.startswith(">"):
        rows, key, value = selector.split("||")
        for row in select(scope, rows):
            if [k.text().strip() for k in select(row, key)[:1]] == [attr[1:]]:
                return [n.text() for n in select(row, value)]
        return []
    if attr == "self":
        return [scope.block()]
    nodes = select(scope, selector)
    if attr == "linked":
        return [f"{n.attrs['href']}\n{n.text().strip()}" for n in nodes if n.attrs.get("href") and n.text().strip()]
    if attr == "text":
        return [n.text() for n in nodes]
    if attr == "block":
        return [n.block() for n in nodes]
    return [n.attrs[attr] for n in nodes if attr in n.attrs]


def _fields(scope: Node, html: str, rules) -> dict[str, list[str]]:
    """Values of the first rule of each field that finds any; rules come in order of priority."""
    out: dict[str, list[str]] = {}
    for field, selector, attr in rules:
        if field not in out:
            values = [v for v in (x.strip() for x in _values(scope, html, selector, attr)) if v]
            if values:
                out[field] = values
    return out


#: Rows that a task holds before it hands them on.
ROWS = 500


def extract(
    pages: DataFrame, rules: dict[tuple[str, str], tuple[str | None, list[tuple[str, str, str]]]], closed_entities: bool = False
) -> DataFrame:
    """Columns of `pages(url, html, source_id, page_kind, …)` but html, and position, fields, error.

    `rules[(source_id, page_kind)]`: item selector and (field, selector, attribute) rules. With an
    item selector a page gives one row per item, without one row. Pages whose source has no rules
    and pages that fail give one row with an error. Further columns, such as the caller's key, stay.
    `closed_entities`: only entities with a semicolon are decoded; browsers decode some without.
    """
    keep = [c for c in pages.columns if c not in ("html", "position", "found", "error")]
    names = [*keep, "position", "found", "error"]

    def rows_of(html, source, kind):
        try:
            item, field_rules = rules[(source, kind)]
            root = tree(html, closed_entities)
            scopes = [root] if item is None else select(root, item)
            return [(i, json.dumps(_fields(x, html, field_rules), ensure_ascii=False), None) for i, x in enumerate(scopes)]
        except Exception as e:  # one bad page must not fail the job
            return [(-1, None, f"{type(e).__name__}: {e}")]

    def run(batches):
        for pdf in batches:
            kept, rows = [], []
            for at, (html, source, kind) in enumerate(zip(pdf["html"], pdf["source_id"], pdf["page_kind"])):
                found = rows_of(html, source, kind)
                rows += found
                kept += [at] * len(found)
                if len(rows) >= ROWS or (rows and at == len(pdf) - 1):
                    made = pd.DataFrame(rows, columns=names[-3:])
                    yield pd.concat([pdf[keep].iloc[kept].reset_index(drop=True), made], axis=1)
                    kept, rows = [], []

    taken = pages.select(*keep, "html")
    schema = StructType([*taken.schema.fields[:-1], StructField("position", LongType()), StructField("found", StringType()), StructField("error", StringType())])
    return taken.mapInPandas(run, schema).select(
        *keep, "position", F.from_json("found", "map<string,array<string>>").alias("fields"), "error"
    )
