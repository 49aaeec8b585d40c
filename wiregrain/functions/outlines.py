"""Outlines of XML, HTML and CSV bodies; all merge, so that parts of the data can be outlined apart."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field
from typing import Any

from . import dom

XML_DEPTH = 5
_NUMBER = re.compile(r"[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)|0[xX][0-9a-fA-F]+p[+-]?\d+", re.IGNORECASE)
# Formats of text values, tried in this order.
FORMATS = (
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z"),
    ("iso8601", r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?"),
    ("url", r"^https?://"),
    ("email", r"^[^@]+@[^@]+\.[^@]+\Z"),
)
MIN_SAMPLES, MAX_ENUM = 5, 10


@dataclass
class XmlOutline:
    """An element: distinct attribute names, distinct children, and whether it occurs more than once among siblings."""

    name: str
    attributes: dict[str, None] = field(default_factory=dict)
    children: dict[str, XmlOutline] = field(default_factory=dict)
    repeated: bool = False
    truncated: bool = False

    @classmethod
    def of(cls, node: dom.Node, spaces: dict[str, str], depth: int = 0) -> XmlOutline:
        spaces = spaces | {k[6:]: v for k, v in node.attrs.items() if k.startswith("xmlns:")}
        out = cls(_local(node.tag, spaces), {_local(a, spaces): None for a in node.attrs})
        if depth >= XML_DEPTH:
            out.truncated = bool(node.elements())
            return out
        for child in node.elements():
            made = cls.of(child, spaces, depth + 1)
            if made.name in out.children:
                out.children[made.name].repeated = True  # only the first of a name is outlined
            else:
                out.children[made.name] = made
        return out

    def merge(self, other: XmlOutline) -> XmlOutline:
        self.attributes |= other.attributes
        self.repeated |= other.repeated
        self.truncated |= other.truncated
        for name, child in other.children.items():
            self.children[name] = self.children[name].merge(child) if name in self.children else child
        return self

    def depth(self) -> int:
        return max((1 + c.depth() for c in self.children.values()), default=0)

    def any_truncated(self) -> bool:
        return self.truncated or any(c.any_truncated() for c in self.children.values())

    def dump(self) -> dict:
        out: dict[str, Any] = {"name": self.name, "child_count": len(self.children)}
        if self.attributes:
            out["attributes"] = sorted(self.attributes)
        if self.repeated:
            out["repeated"] = True
        if self.children:
            out["children"] = [self.children[c].dump() for c in sorted(self.children)]
        return out


def _local(name: str, spaces: dict[str, str]) -> str:
    """A name without its prefix where the prefix stands for a web address."""
    prefix, colon, local = name.partition(":")
    return local if colon and spaces.get(prefix, "").startswith(("http://", "https://")) else name


def xml_outline(text: str) -> XmlOutline:
    root = dom.parse_xml(text)
    return XmlOutline.of(root.elements()[0], {})


@dataclass
class HtmlOutline:
    """Title, tag counts, ids, forms with inputs, and meta tags of a page; of its first ``elements`` down to ``depth`` where given."""

    title: str = ""
    tags: dict[str, int] = field(default_factory=dict)
    ids: dict[str, str] = field(default_factory=dict)
    forms: list[dict] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    truncated: bool = False

    @classmethod
    def of(cls, text: str, elements: int | None = None, depth: int | None = None) -> HtmlOutline:
        out, seen = cls(), 0
        stack = [(dom.parse_html(text), 0)]
        while stack and (elements is None or seen < elements):
            n, level = stack.pop()
            if n.tag and n.tag != "#document":
                seen += 1
                out.note(n)
            if depth is None or level < depth:
                stack += [(c, level + 1) for c in reversed(n.children)]
            elif n.elements():
                out.truncated = True
        out.truncated |= any(n.tag for n, _ in stack)
        return out

    def note(self, n: dom.Node) -> None:
        self.tags[n.tag] = self.tags.get(n.tag, 0) + 1
        if n.tag == "title" and not self.title:
            self.title = n.inner_text().strip()
        if n.attrs.get("id"):
            self.ids.setdefault(n.attrs["id"], n.tag)
        if n.tag == "meta":
            name = n.attrs.get("name") or n.attrs.get("property") or ""
            if name or n.attrs.get("content"):
                self.meta.setdefault(name, n.attrs.get("content", ""))
        if n.tag == "form":
            inputs = [
                {"name": c.attrs.get("name", ""), "type": c.tag if c.tag != "input" else c.attrs.get("type", "")}
                for c in n.walk()
                if c.tag in ("input", "select", "textarea")
            ]
            self.forms.append({"action": n.attrs.get("action", ""), "method": n.attrs.get("method", "").upper(), "inputs": inputs})

    def merge(self, other: HtmlOutline) -> HtmlOutline:
        self.title = self.title or other.title
        for t, n in other.tags.items():
            self.tags[t] = self.tags.get(t, 0) + n
        self.ids = {**other.ids, **self.ids}
        self.meta = {**other.meta, **self.meta}
        self.forms += other.forms
        self.truncated |= other.truncated
        return self


def read_csv(text: str) -> list[list[str]]:
    """Rows of a comma-separated text, empty lines left out; quotes are taken as they come."""
    return [r for r in csv.reader(io.StringIO(text), strict=False) if r]


def is_number(text: str) -> bool:
    return bool(_NUMBER.fullmatch(text))


def csv_table(text: str) -> tuple[list[str], list[list[str]], bool]:
    """Column names, data rows and whether the first row is a header: it is, unless most of its cells are numbers."""
    rows = read_csv(text)
    if not rows:
        raise ValueError("empty CSV")
    first = rows[0]
    numbers = sum(is_number(c.strip()) for c in first)
    if len(rows) > 1 and numbers > len(first) // 2:
        return [f"col_{i}" for i in range(len(first))], rows, False
    return first, rows[1:], True


def text_format(values: list[str]) -> tuple[str, list[str]]:
    """Format of text values, and all of them if they are an enumeration."""
    if len(values) < MIN_SAMPLES:
        return "", []
    for name, pattern in FORMATS:
        if all(re.search(pattern, v) for v in values):
            return name, []
    distinct = sorted(set(values))
    return ("enum", distinct) if len(distinct) <= MAX_ENUM else ("", [])


class CsvColumn:
    """Type, format, share of empty cells and examples of a column; columns of the same name merge."""

    def __init__(self, place: tuple) -> None:
        self.place, self.cells, self.values = place, 0, 0
        self.number = self.boolean = True
        self.formats = {name for name, _ in FORMATS}
        self.distinct: set[str] = set()
        self.firsts: dict[str, tuple] = {}

    def add(self, cell: str, order: tuple) -> None:
        self.cells += 1
        if not cell:
            return
        self.values += 1
        self.number = self.number and is_number(cell)
        self.boolean = self.boolean and cell.lower() in ("true", "false", "0", "1")
        self.formats = {n for n, p in FORMATS if n in self.formats and re.search(p, cell)} if self.formats else self.formats
        if len(self.distinct) <= MAX_ENUM:
            self.distinct.add(cell)
        if len(self.firsts) < 3 or cell in self.firsts or order < max(self.firsts.values()):
            self._first({cell: order})

    def _first(self, found: dict[str, tuple]) -> None:
        for cell, order in found.items():
            self.firsts[cell] = min(order, self.firsts.get(cell, order))
        self.firsts = dict(sorted(self.firsts.items(), key=lambda x: x[1])[:3])

    def merge(self, other: CsvColumn) -> CsvColumn:
        self.place = min(self.place, other.place)
        self.cells, self.values = self.cells + other.cells, self.values + other.values
        self.number, self.boolean = self.number and other.number, self.boolean and other.boolean
        self.formats &= other.formats
        self.distinct |= other.distinct  # more than MAX_ENUM on any side: no enumeration
        self._first(other.firsts)
        return self

    def dump(self, name: str) -> dict:
        kind = "string" if not self.values else "number" if self.number else "boolean" if self.boolean else "string"
        form, enum = "", []
        if kind == "string" and self.values >= MIN_SAMPLES:
            form = next((n for n, _ in FORMATS if n in self.formats), "")
            if not form and len(self.distinct) <= MAX_ENUM:
                form, enum = "enum", sorted(self.distinct)
        empty = round((self.cells - self.values) / self.cells, 6) if self.cells else 0.0
        return {"column": name, "type": kind, "format": form, "empty_frequency": empty, "examples": list(self.firsts), "enum_values": enum}


def csv_columns(names: list[str], rows: list[list[str]]) -> list[dict]:
    """``CsvColumn`` of each column over all rows."""
    out = []
    for i, name in enumerate(names):
        column = CsvColumn((i,))
        for k, row in enumerate(rows):
            column.add(row[i].strip() if i < len(row) else "", (k,))
        out.append(column.dump(name))
    return out
