"""Element trees of HTML and XML texts, CSS selectors and XPath over them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from xml.parsers import expat

# Elements without content, and elements that belong into the head.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
# Elements whose start closes an open element of the named kinds.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element, or a text where ``tag`` is empty. The root of a document has the tag ``#document``."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag]

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.children[::-1]

    def inner_text(self) -> str:
        return self.text if not self.tag else "".join(n.text for n in self.walk() if not n.tag)


class _Builder(HTMLParser):
    """Tree with the implied html, head and body elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = self.root.add(Node("html"))
        self.head = self.html.add(Node("head"))
        self.body = self.html.add(Node("body"))
        self.open: list[Node] = [self.head]
        self.in_head = True

    def _to_body(self) -> None:
        if self.in_head:
            self.in_head, self.open = False, [self.body]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            target.attrs = {**given, **target.attrs}
            if tag == "body":
                self._to_body()
            return
        if self.in_head and tag not in HEAD_ONLY:
            self._to_body()
        if tag in CLOSES:
            stop = {"li": ("ul", "ol")}.get(tag, ("table",) if tag in ("tr", "td", "th", "tbody", "tfoot") else ())
            self._close(CLOSES[tag], stop)
        elif tag in CLOSES_P:
            self._close(("p",), ("button",))
        node = self.open[-1].add(Node(tag, given))
        if tag not in VOID:
            self.open.append(node)

    def _close(self, tags: tuple, stop: tuple) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self._to_body()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.in_head and len(self.open) == 1:
            if not data.strip():
                return
            self._to_body()
        self.open[-1].add(Node("", text=data))


def parse_html(text: str) -> Node:
    """The tree of an HTML text; any text gives one."""
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def parse_xml(text: str) -> Node:
    """The tree of an XML text, names with their prefix; ``ValueError`` where it is not well formed."""
    root = Node("#document")
    stack = [root]
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda tag, attrs: stack.append(stack[-1].add(Node(tag, dict(attrs))))
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda data: stack[-1].add(Node("", text=data)) if stack[-1].tag != "#document" else None
    parser.buffer_text = True
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise ValueError(f"no XML: {e}") from None
    return root


# -- CSS ----------------------------------------------------------------------

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[A-Za-z_][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:(?P<pseudo>[\w-]+)(?P<open>\()?""",
    re.VERBOSE,
)
Test = Callable[[Node], bool]


class SelectorError(ValueError):
    """No selector."""


def _siblings(n: Node, same: bool) -> list[Node]:
    return [c for c in n.parent.elements() if not same or c.tag == n.tag] if n.parent else [n]


def _nth(argument: str) -> Callable[[int], bool]:
    a = argument.replace(" ", "").lower()
    a = {"odd": "2n+1", "even": "2n"}.get(a, a)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", a)
    if not m:
        raise SelectorError(argument)
    if m.group(3):
        return lambda i: i == int(m.group(3))
    step, base = int({"": 1, "+": 1, "-": -1}.get(m.group(1), m.group(1))), int(m.group(2) or 0)
    return lambda i: (i == base) if not step else (i - base) % step == 0 and (i - base) // step >= 0


def _pseudo(name: str, argument: str) -> Test:
    same = name.endswith("-of-type")
    if name in ("first-child", "first-of-type"):
        return lambda n: _siblings(n, same)[0] is n
    if name in ("last-child", "last-of-type"):
        return lambda n: _siblings(n, same)[-1] is n
    if name in ("only-child", "only-of-type"):
        return lambda n: len(_siblings(n, same)) == 1
    if name in ("nth-child", "nth-of-type"):
        fits = _nth(argument)
        return lambda n: fits(_siblings(n, same).index(n) + 1)
    if name in ("nth-last-child", "nth-last-of-type"):
        fits = _nth(argument)
        return lambda n: fits(len(_siblings(n, same)) - _siblings(n, same).index(n))
    if name == "empty":
        return lambda n: not any(c.tag or c.text for c in n.children)
    if name == "root":
        return lambda n: n.parent is not None and n.parent.tag == "#document"
    if name == "not":
        inner = _group(argument)
        return lambda n: not inner(n)
    if name in ("is", "where", "matches"):
        return _group(argument)
    if name == "has":
        inner = _group(argument)
        return lambda n: any(c.tag and inner(c) for c in n.walk())
    if name in ("contains", "containsown"):
        text = argument.strip().strip("\"'")
        if name == "contains":
            return lambda n: text in n.inner_text()
        return lambda n: text in "".join(c.text for c in n.children if not c.tag)
    raise SelectorError(f":{name}")


def _attribute(name: str, op: str | None, value: str) -> Test:
    def test(n: Node) -> bool:
        have = n.attrs.get(name.lower(), n.attrs.get(name))
        if op is None or have is None:
            return have is not None or op == "!="
        return {
            "=": have == value, "!=": have != value, "~=": value in have.split(), "|=": have == value or have.startswith(value + "-"),
            "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "*=": bool(value) and value in have,
        }[op]

    return test


def _compound(text: str, pos: int) -> tuple[Test | None, int]:
    tests: list[Test] = []
    while m := _SIMPLE.match(text, pos):
        pos = m.end()
        if m["tag"]:
            if tests:
                raise SelectorError(text)
            tag = m["tag"].lower()
            tests.append(lambda n, tag=tag: tag == "*" or n.tag.lower() == tag)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["attr"]:
            tests.append(_attribute(m["attr"], m["op"], next((x for x in (m["dq"], m["sq"], m["bare"]) if x is not None), "")))
        else:
            argument = ""
            if m["open"]:
                depth, end = 1, pos
                while end < len(text) and depth:
                    depth += (text[end] == "(") - (text[end] == ")")
                    end += 1
                if depth:
                    raise SelectorError(text)
                argument, pos = text[pos : end - 1], end
            tests.append(_pseudo(m["pseudo"].lower(), argument))
    return (lambda n: all(t(n) for t in tests)) if tests else None, pos


def _related(how: str, n: Node) -> Iterator[Node]:
    if how in (" ", ">"):
        up = n.parent
        while up is not None and up.tag != "#document":
            yield up
            if how == ">":
                return
            up = up.parent
    elif n.parent:
        before = n.parent.elements()
        before = before[: before.index(n)]
        yield from before[-1:] if how == "+" else before


def _chain(left: Test, how: str, right: Test) -> Test:
    return lambda n: right(n) and any(left(x) for x in _related(how, n))


def _group(text: str) -> Test:
    tests: list[Test] = []
    pos, text = 0, text.strip()
    while True:
        test, pos = _compound(text, pos)
        if test is None:
            raise SelectorError(text)
        while m := re.compile(r"\s*([>+~])\s*|\s+(?=[^\s,])").match(text, pos):
            right, pos = _compound(text, m.end())
            if right is None:
                raise SelectorError(text)
            test = _chain(test, m.group(1) or " ", right)
        tests.append(test)
        m = re.compile(r"\s*,\s*").match(text, pos)
        if not m:
            break
        pos = m.end()
    if pos != len(text):
        raise SelectorError(text)
    return lambda n: any(t(n) for t in tests)


@lru_cache(maxsize=256)
def compile_css(selector: str) -> Test:
    return _group(selector)


def css_texts(root: Node, selector: str, most: int = 0) -> list[str]:
    """Trimmed non-empty texts of the matches in document order; no selector, no matches."""
    try:
        test = compile_css(selector)
    except SelectorError:
        return []
    out: list[str] = []
    for n in root.walk():
        if n.tag and test(n) and (t := n.inner_text().strip()):
            out.append(t)
            if most and len(out) >= most:
                break
    return out


# -- XPath --------------------------------------------------------------------


class XPathError(ValueError):
    """No XPath expression, or one this evaluator does not know."""


class Attr:
    """An attribute as a node."""

    def __init__(self, owner: Node, name: str, value: str):
        self.owner, self.name, self.text = owner, name, value

    def inner_text(self) -> str:
        return self.text


_XLEX = re.compile(r"""\s*(?:(\d+(?:\.\d+)?|\.\d+)|("[^"]*"|'[^']*')|(//|::|\.\.|!=|<=|>=|[/@.()\[\],|+=<>*$-])|([A-Za-z_][\w.-]*(?::[A-Za-z_*][\w.-]*)?(?!:))|([A-Za-z_][\w-]*(?=::)))""")
_AXES = "child descendant descendant-or-self self parent ancestor ancestor-or-self following-sibling preceding-sibling attribute following preceding".split()


def _xtokens(text: str) -> list[tuple[str, str]]:
    out, pos = [], 0
    while pos < len(text.rstrip()):
        m = _XLEX.match(text, pos)
        if not m or m.end() == pos:
            raise XPathError(f"unexpected {text[pos]!r} at position {pos}")
        pos = m.end()
        kind = "num str op name axis".split()[m.lastindex - 1]
        out.append((kind, m.group(m.lastindex)))
    return out


def _axis(node: Node | Attr, axis: str) -> Iterator:
    if isinstance(node, Attr):
        if axis == "parent":
            yield node.owner
        elif axis in ("self", "ancestor-or-self", "descendant-or-self"):
            yield node
        return
    if axis == "child":
        yield from node.children
    elif axis in ("descendant", "descendant-or-self"):
        if axis != "descendant":
            yield node
        yield from node.walk()
    elif axis == "self":
        yield node
    elif axis == "attribute":
        yield from (Attr(node, k, v) for k, v in node.attrs.items())
    elif axis == "parent":
        if node.parent:
            yield node.parent
    elif axis in ("ancestor", "ancestor-or-self"):
        if axis != "ancestor":
            yield node
        up = node.parent
        while up is not None:
            yield up
            up = up.parent
    elif axis in ("following-sibling", "preceding-sibling") and node.parent:
        all_ = node.parent.children
        at = all_.index(node)
        yield from all_[at + 1 :] if axis[0] == "f" else all_[:at][::-1]
    elif axis in ("following", "preceding"):
        for up in _axis(node, "ancestor-or-self"):
            for s in _axis(up, f"{axis}-sibling"):
                yield from _axis(s, "descendant-or-self")


def _string(v: object) -> str:
    if isinstance(v, list):
        return v[0].inner_text() if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else "NaN" if v != v else str(v)
    return str(v)


def _num(v: object) -> float:
    if isinstance(v, (bool, float, int)):
        return float(v)
    try:
        return float(_string(v).strip())
    except ValueError:
        return math.nan


def _bool(v: object) -> bool:
    return bool(v) and v == v if isinstance(v, (float, int)) and not isinstance(v, bool) else bool(v)


def _compare(op: str, a: object, b: object) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        if isinstance(a, bool) or isinstance(b, bool):
            a, b = _bool(a), _bool(b)
        else:
            left = [x.inner_text() for x in a] if isinstance(a, list) else [a]
            right = [x.inner_text() for x in b] if isinstance(b, list) else [b]
            return any(_compare(op, x, y) for x in left for y in right)
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = _bool(a) == _bool(b)
        elif isinstance(a, (int, float)) or isinstance(b, (int, float)):
            same = _num(a) == _num(b)
        else:
            same = _string(a) == _string(b)
        return same == (op == "=")
    x, y = _num(a), _num(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


class _XParser:
    """Recursive descent; every method returns a function of (node, position, size)."""

    def __init__(self, text: str):
        self.t, self.at = _xtokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.t[self.at + ahead] if self.at + ahead < len(self.t) else ("", "")

    def accept(self, *ops: str, kind: str = "op") -> str | None:
        k, v = self.peek()
        if k == kind and v in ops:
            self.at += 1
            return v
        return None

    def expect(self, op: str) -> None:
        if not self.accept(op):
            raise XPathError(f"expected {op!r}, found {self.peek()[1]!r}")

    def whole(self) -> Callable:
        e = self.level(0)
        if self.at < len(self.t):
            raise XPathError(f"unexpected {self.peek()[1]!r}")
        return e

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def level(self, i: int) -> Callable:
        if i == len(self.LEVELS):
            if self.accept("-"):
                inner = self.level(i)
                return lambda n, p, s: -_num(inner(n, p, s))
            return self.union()
        left = self.level(i + 1)
        while True:
            k, v = self.peek()
            if k not in ("op", "name") or v not in self.LEVELS[i]:
                return left
            self.at += 1
            left = self.operation(v, left, self.level(i + 1))

    @staticmethod
    def operation(op: str, a: Callable, b: Callable) -> Callable:
        if op == "or":
            return lambda n, p, s: _bool(a(n, p, s)) or _bool(b(n, p, s))
        if op == "and":
            return lambda n, p, s: _bool(a(n, p, s)) and _bool(b(n, p, s))
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return lambda n, p, s: _compare(op, a(n, p, s), b(n, p, s))
        calc = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "div": lambda x, y: x / y if y else math.nan, "mod": lambda x, y: math.fmod(x, y) if y else math.nan}[op]
        return lambda n, p, s: calc(_num(a(n, p, s)), _num(b(n, p, s)))

    def union(self) -> Callable:
        parts = [self.path()]
        while self.accept("|"):
            parts.append(self.path())
        if len(parts) == 1:
            return parts[0]

        def run(n: Node, p: int, s: int) -> list:
            found = [x for e in parts for x in e(n, p, s)]
            top = n if isinstance(n, Node) else n.owner
            while top.parent is not None:
                top = top.parent
            rank = {id(x): i for i, x in enumerate([top, *top.walk()])}
            seen: dict[int, object] = {id(x): x for x in found}
            return sorted(seen.values(), key=lambda x: rank.get(id(x), 0))

        return run

    def path(self) -> Callable:
        k, v = self.peek()
        if k in ("num", "str") or (k == "op" and v == "(") or (k == "name" and self.peek(1) == ("op", "(") and v not in ("text", "node", "comment")):
            start = self.primary()
            while self.accept("["):
                start = self.filtered(start)
            steps = []
            if self.peek() in (("op", "/"), ("op", "//")):
                steps = self.steps()
            return self.follow(start, steps) if steps else start
        if v == "/" and self.peek(1)[0] not in ("name", "axis") and self.peek(1)[1] not in ("@", ".", "..", "*"):
            self.at += 1
            return lambda n, p, s: [self.top(n)]
        if v in ("/", "//"):
            return self.follow(lambda n, p, s: [self.top(n)], self.steps())
        return self.follow(lambda n, p, s: [n], [self.step(), *self.steps()])

    @staticmethod
    def top(n: Node | Attr) -> Node:
        n = n.owner if isinstance(n, Attr) else n
        while n.parent is not None:
            n = n.parent
        return n

    def steps(self) -> list:
        out = []
        while op := self.accept("/", "//"):
            if op == "//":
                out.append(("descendant-or-self", lambda n: True, []))
            out.append(self.step())
        return out

    def step(self) -> tuple:
        if self.accept(".."):
            return "parent", (lambda n: True), []
        if self.accept("."):
            return "self", (lambda n: True), []
        axis = "child"
        if self.accept("@"):
            axis = "attribute"
        elif self.peek()[0] in ("axis", "name") and self.peek(1) == ("op", "::"):
            axis = self.peek()[1]
            if axis not in _AXES:
                raise XPathError(f"unknown axis {axis}")
            self.at += 2
        k, v = self.peek()
        if k == "name" and v in ("text", "node", "comment") and self.peek(1) == ("op", "("):
            self.at += 2
            self.expect(")")
            test = {"text": lambda n: isinstance(n, Node) and not n.tag, "node": lambda n: True, "comment": lambda n: False}[v]
        elif k == "name":
            self.at += 1
            local = v.rpartition(":")[2]
            test = (lambda n: isinstance(n, Attr) and n.name == v) if axis == "attribute" else (lambda n: isinstance(n, Node) and (n.tag == v or (":" not in v and n.tag.rpartition(":")[2] == local and ":" not in n.tag)))
        elif self.accept("*"):
            test = (lambda n: isinstance(n, Attr)) if axis == "attribute" else (lambda n: isinstance(n, Node) and bool(n.tag) and n.tag != "#document")
        else:
            raise XPathError(f"expected a node test, found {v!r}")
        tests = []
        while self.accept("["):
            tests.append(self.level(0))
            self.expect("]")
        return axis, test, tests

    @staticmethod
    def keep(nodes: list, test: Callable) -> list:
        out = []
        for i, x in enumerate(nodes):
            v = test(x, i + 1, len(nodes))
            if (v == i + 1) if isinstance(v, (int, float)) and not isinstance(v, bool) else _bool(v):
                out.append(x)
        return out

    def follow(self, start: Callable, steps: list) -> Callable:
        def run(n: Node, p: int, s: int) -> list:
            nodes = start(n, p, s)
            for axis, test, predicates in steps:
                found: dict = {}
                for x in nodes:
                    hits = [y for y in _axis(x, axis) if test(y)]
                    for predicate in predicates:
                        hits = self.keep(hits, predicate)
                    for y in hits[::-1] if axis.startswith(("ancestor", "preceding")) else hits:
                        found.setdefault((id(y.owner), y.name) if isinstance(y, Attr) else id(y), y)
                nodes = list(found.values())
            return nodes

        return run

    def filtered(self, start: Callable) -> Callable:
        test = self.level(0)
        self.expect("]")
        return lambda n, p, s: self.keep(start(n, p, s), test)

    def primary(self) -> Callable:
        k, v = self.peek()
        self.at += 1
        if k == "num":
            return lambda n, p, s: float(v)
        if k == "str":
            return lambda n, p, s: v[1:-1]
        if v == "(":
            inner = self.level(0)
            self.expect(")")
            return inner
        self.expect("(")
        args = []
        while not self.accept(")"):
            args.append(self.level(0))
            self.accept(",")
        return _xfunction(v, args)


def _xfunction(name: str, args: list[Callable]) -> Callable:
    def own(n: object) -> str:
        return n.inner_text()  # type: ignore[attr-defined]

    def label(n: object) -> str:
        return n.name if isinstance(n, Attr) else n.tag  # type: ignore[attr-defined]

    simple: dict[tuple[str, int], Callable] = {
        ("contains", 2): lambda a, b: _string(b) in _string(a),
        ("starts-with", 2): lambda a, b: _string(a).startswith(_string(b)),
        ("ends-with", 2): lambda a, b: _string(a).endswith(_string(b)),
        ("substring-before", 2): lambda a, b: _string(a).partition(_string(b))[0] if _string(b) in _string(a) else "",
        ("substring-after", 2): lambda a, b: _string(a).partition(_string(b))[2],
        ("substring", 2): lambda a, b: _string(a)[max(0, round(_num(b)) - 1) :],
        ("substring", 3): lambda a, b, c: _string(a)[max(0, round(_num(b)) - 1) : max(0, round(_num(b)) - 1 + round(_num(c)))],
        ("translate", 3): lambda a, b, c: _string(a).translate({ord(x): (_string(c)[i] if i < len(_string(c)) else None) for i, x in reversed(list(enumerate(_string(b))))}),
        ("normalize-space", 1): lambda a: " ".join(_string(a).split()),
        ("string-length", 1): lambda a: float(len(_string(a))),
        ("lower-case", 1): lambda a: _string(a).lower(),
        ("string", 1): _string,
        ("number", 1): _num,
        ("boolean", 1): _bool,
        ("not", 1): lambda a: not _bool(a),
        ("count", 1): lambda a: float(len(a)),
        ("sum", 1): lambda a: float(sum(_num([x]) for x in a)),
        ("floor", 1): lambda a: float(math.floor(_num(a))),
        ("ceiling", 1): lambda a: float(math.ceil(_num(a))),
        ("round", 1): lambda a: float(math.floor(_num(a) + 0.5)),
        ("true", 0): lambda: True,
        ("false", 0): lambda: False,
        ("name", 1): lambda a: label(a[0]) if a else "",
        ("local-name", 1): lambda a: label(a[0]).rpartition(":")[2] if a else "",
    }
    if name == "concat" and len(args) > 1:
        return lambda n, p, s: "".join(_string(a(n, p, s)) for a in args)
    if name == "position" and not args:
        return lambda n, p, s: float(p)
    if name == "last" and not args:
        return lambda n, p, s: float(s)
    if not args and (name, 1) in simple and name in ("string", "normalize-space", "string-length", "number", "name", "local-name"):
        return lambda n, p, s: simple[name, 1]([n] if name.endswith("name") else own(n))
    if (name, len(args)) not in simple:
        raise XPathError(f"unknown function {name}/{len(args)}")
    f = simple[name, len(args)]
    return lambda n, p, s: f(*[a(n, p, s) for a in args])


@lru_cache(maxsize=256)
def compile_xpath(expression: str) -> Callable:
    return _XParser(expression).whole()


def xpath_texts(root: Node, expression: str, most: int = 0) -> list[str]:
    """Trimmed non-empty texts of the nodes; ``XPathError`` for an expression that selects none by its kind."""
    found = compile_xpath(expression)(root, 1, 1)
    if not isinstance(found, list):
        raise XPathError("the expression does not select nodes")
    texts = [t for n in found if (t := n.inner_text().strip())]
    return texts[:most] if most else texts
