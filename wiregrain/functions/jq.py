"""A jq evaluator: expressions are compiled once on the driver and run over parsed JSON in the tasks.

Covered: paths, slices, iteration, ``?``, ``..``, pipes, commas, literals,
string interpolation, formats, arrays, objects, arithmetic, comparison,
``and`` ``or`` ``not``, ``//``, ``if``, ``try``/``catch``, ``reduce``,
``foreach``, variables with destructuring, ``def``, assignment operators and
the builtins listed in ``BUILTINS``. Everything else is a ``JqSyntaxError``.

A compiled node is a function from (path, value, environment) to an iterator
of (path, value): values carry the path they were taken from as long as the
expression is a path, which is what ``path``, ``del`` and the assignments use.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import math
import re
import urllib.parse
from collections.abc import Callable, Iterator
from typing import Any

from .jsonkit import canonical

Path = tuple | None
Emit = Iterator[tuple[Path, Any]]
Node = Callable[[Path, Any, dict], Emit]


class JqSyntaxError(ValueError):
    """The expression is no jq this evaluator knows."""


class JqError(ValueError):
    """An error while running; ``value`` is what ``catch`` receives."""

    def __init__(self, value: Any):
        super().__init__(value if isinstance(value, str) else json.dumps(value))
        self.value = value


class _Break(Exception):
    def __init__(self, label: object):
        self.label = label


_LEX = re.compile(
    r"""\s+|\#[^\n]*|(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<field>\.[A-Za-z_]\w*)|(?P<var>\$(?:__loc__|[A-Za-z_]\w*))|(?P<fmt>@\w+)
    |(?P<word>[A-Za-z_]\w*(?:::\w+)*)|(?P<op>\?//=?|//=|\|=|\+=|-=|\*=|/=|%=|==|!=|<=|>=|//|\.\.|and\b|or\b|[.\[\]{}()|,:;=<>+\-*/%?])|(?P<str>")""",
    re.VERBOSE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"'}


def _tokens(text: str) -> list[tuple[str, Any]]:
    out, pos = [], 0
    while pos < len(text):
        m = _LEX.match(text, pos)
        if not m:
            raise JqSyntaxError(f"unexpected {text[pos]!r} at position {pos}")
        pos = m.end()
        if m.lastgroup == "str":
            parts, pos = _string(text, pos)
            out.append(("str", parts))
        elif m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return out


def _string(text: str, pos: int) -> tuple[list, int]:
    """Literal parts and interpolated token lists of a string that began before ``pos``."""
    parts: list = [""]
    while True:
        if pos >= len(text):
            raise JqSyntaxError("unclosed string")
        c = text[pos]
        if c == '"':
            return parts, pos + 1
        if c != "\\":
            parts[-1] += c
            pos += 1
            continue
        e = text[pos + 1 : pos + 2]
        if e == "(":
            depth, end, quoted = 1, pos + 2, False
            while end < len(text) and depth:
                ch = text[end]
                if quoted and ch == "\\" and text[end + 1 : end + 2] != "(":
                    end += 1
                elif ch == '"':
                    quoted = not quoted
                elif not quoted:
                    depth += (ch == "(") - (ch == ")")
                end += 1
            if depth:
                raise JqSyntaxError("unclosed interpolation")
            parts += [_tokens(text[pos + 2 : end - 1]), ""]
            pos = end
        elif e == "u":
            parts[-1] += json.loads(f'"{text[pos : pos + 6]}"')
            pos += 6
        elif e in _ESCAPES:
            parts[-1] += _ESCAPES[e]
            pos += 2
        else:
            raise JqSyntaxError(f"unknown escape at position {pos}")


# -- values -------------------------------------------------------------------

_RANK = {type(None): 0, bool: 1, int: 3, float: 3, str: 4, list: 5, dict: 6}


def kind(v: Any) -> str:
    return {0: "null", 1: "boolean", 3: "number", 4: "string", 5: "array", 6: "object"}[_RANK[type(v)]]


def compare(a: Any, b: Any) -> int:
    """Total order of JSON values: null, false, true, numbers, strings, arrays, objects."""
    ra, rb = _RANK[type(a)] + (a is True), _RANK[type(b)] + (b is True)
    if ra != rb:
        return -1 if ra < rb else 1
    if isinstance(a, list):
        for x, y in zip(a, b, strict=False):
            if c := compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    if isinstance(a, dict):
        ka, kb = sorted(a), sorted(b)
        if c := compare(ka, kb):
            return c
        for k in ka:
            if c := compare(a[k], b[k]):
                return c
        return 0
    return 0 if a is None or a == b else (-1 if a < b else 1)


_order = functools.cmp_to_key(compare)


def _shown(v: Any) -> str:
    text = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return text if len(text) <= 40 else text[:37] + "..."


def _number(v: float) -> Any:
    return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e17 else v


def truth(v: Any) -> bool:
    return v is not None and v is not False


def get(v: Any, k: Any) -> Any:
    """``v[k]`` by the rules of jq."""
    if isinstance(k, str) and (v is None or isinstance(v, dict)):
        return None if v is None else v.get(k)
    if isinstance(k, (int, float)) and not isinstance(k, bool) and (v is None or isinstance(v, list)):
        i = math.floor(k)
        return v[i] if v is not None and -len(v) <= i < len(v) else None
    if isinstance(k, dict) and (v is None or isinstance(v, (list, str))):
        return None if v is None else v[_bound(k.get("start"), math.floor) : _bound(k.get("end"), math.ceil)]
    if isinstance(k, list) and isinstance(v, list):
        return [i for i in range(len(v) - len(k) + 1) if k and v[i : i + len(k)] == k]
    what = f'"{k}"' if isinstance(k, str) else kind(k)
    raise JqError(f"cannot index {kind(v)} with {what}")


def _bound(v: Any, whole: Callable) -> Any:
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise JqError("start and end of a slice must be numbers")
    return whole(v)


def put(v: Any, path: tuple, new: Callable[[Any], Any]) -> Any:
    """``v`` with the value at ``path`` replaced by ``new(value)``."""
    if not path:
        return new(v)
    k, rest = path[0], path[1:]
    if isinstance(k, str):
        if v is not None and not isinstance(v, dict):
            raise JqError(f'cannot index {kind(v)} with "{k}"')
        return {**(v or {}), k: put((v or {}).get(k), rest, new)}
    if v is not None and not isinstance(v, list):
        raise JqError(f"cannot index {kind(v)} with {kind(k)}")
    out = list(v or [])
    if isinstance(k, dict):
        part = slice(_bound(k.get("start"), math.floor), _bound(k.get("end"), math.ceil))
        made = put(out[part], rest, new)
        if not isinstance(made, list):
            raise JqError("a slice can only be set to an array")
        out[part] = made
        return out
    i = math.floor(k)
    if i < 0:
        i += len(out)
        if i < 0:
            raise JqError("out of bounds negative array index")
    out += [None] * (i + 1 - len(out))
    out[i] = put(out[i], rest, new)
    return out


def drop(v: Any, paths: list[tuple]) -> Any:
    """``v`` without what is at the paths."""
    for path in sorted((list(p) for p in paths), key=_order, reverse=True):
        if not path:
            return None
        try:
            parent = functools.reduce(get, path[:-1], v)
        except JqError:
            continue
        k = path[-1]
        if isinstance(parent, dict) and isinstance(k, str):
            v = put(v, tuple(path[:-1]), lambda d, k=k: {x: y for x, y in d.items() if x != k})
        elif isinstance(parent, list):
            def without(xs: list, k: Any = k) -> list:
                xs = list(xs)
                if isinstance(k, dict):
                    del xs[_bound(k.get("start"), math.floor) : _bound(k.get("end"), math.ceil)]
                elif -len(xs) <= math.floor(k) < len(xs):
                    del xs[math.floor(k)]
                return xs

            v = put(v, tuple(path[:-1]), without)
    return v


def _merge(a: dict, b: dict) -> dict:
    return {**a, **{k: _merge(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}}


def arithmetic(op: str, a: Any, b: Any) -> Any:
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
    if op == "+":
        if a is None or b is None:
            return b if a is None else a
        if numbers or (type(a) is type(b) and isinstance(a, (str, list))):
            return a + b
        if isinstance(a, dict) and isinstance(b, dict):
            return {**a, **b}
        raise JqError(f"{kind(a)} ({_shown(a)}) and {kind(b)} ({_shown(b)}) cannot be added")
    if op == "-":
        if numbers:
            return a - b
        if isinstance(a, list) and isinstance(b, list):
            return [x for x in a if all(compare(x, y) for y in b)]
        raise JqError(f"{kind(a)} ({_shown(a)}) and {kind(b)} ({_shown(b)}) cannot be subtracted")
    if op == "*":
        if numbers:
            return a * b
        if isinstance(b, str) and not isinstance(a, str):
            a, b = b, a
        if isinstance(a, str) and isinstance(b, (int, float)) and not isinstance(b, bool):
            return a * max(1, int(b)) if b > 0 else None
        if isinstance(a, dict) and isinstance(b, dict):
            return _merge(a, b)
        raise JqError(f"{kind(a)} ({_shown(a)}) and {kind(b)} ({_shown(b)}) cannot be multiplied")
    if op == "/":
        if isinstance(a, str) and isinstance(b, str):
            return a.split(b) if b else list(a)
        if numbers and b != 0:
            return _number(a / b)
    elif numbers and int(b) != 0:
        return int(math.fmod(int(a), int(b)))
    why = "divided because the divisor is zero" if numbers else "divided"
    raise JqError(f"{kind(a)} ({_shown(a)}) and {kind(b)} ({_shown(b)}) cannot be {why}")


def as_text(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _row(v: Any, cell: Callable[[Any], str], glue: str) -> str:
    if not isinstance(v, list):
        raise JqError(f"{kind(v)} ({_shown(v)}) cannot be formatted as a row")
    return glue.join(cell(x) for x in v)


FORMATS: dict[str, Callable[[Any], str]] = {
    "@text": as_text,
    "@json": lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":")),
    "@csv": lambda v: _row(v, lambda x: '"' + x.replace('"', '""') + '"' if isinstance(x, str) else "" if x is None else as_text(x), ","),
    "@tsv": lambda v: _row(v, lambda x: "" if x is None else as_text(x).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n"), "\t"),
    "@html": lambda v: as_text(v).translate({60: "&lt;", 62: "&gt;", 38: "&amp;", 39: "&#39;", 34: "&quot;"}),
    "@uri": lambda v: urllib.parse.quote(as_text(v), safe="-_.~"),
    "@sh": lambda v: " ".join("'" + x.replace("'", "'\\''") + "'" if isinstance(x, str) else as_text(x) for x in (v if isinstance(v, list) else [v])),
    "@base64": lambda v: base64.b64encode(as_text(v).encode()).decode(),
    "@base64d": lambda v: base64.b64decode(as_text(v) + "=" * (-len(as_text(v)) % 4)).decode("utf-8", "replace"),
}


# -- builtins -----------------------------------------------------------------


def _need(v: Any, *types: type) -> Any:
    if not isinstance(v, types) or isinstance(v, bool) and bool not in types:
        raise JqError(f"{kind(v)} ({_shown(v)}) has the wrong type")
    return v


def _items(v: Any) -> list:
    if isinstance(v, dict):
        return list(v.values())
    if isinstance(v, list):
        return v
    raise JqError(f"cannot iterate over: {kind(v)}" + ("" if v is None else f" ({_shown(v)})"))


def _length(v: Any) -> Any:
    if isinstance(v, bool):
        raise JqError(f"boolean ({_shown(v)}) has no length")
    return 0 if v is None else abs(v) if isinstance(v, (int, float)) else len(v)


def _keys(v: Any) -> list:
    return sorted(v) if isinstance(v, dict) else list(range(len(_need(v, list))))


def _to_number(v: Any) -> Any:
    try:
        return v if isinstance(v, (int, float)) and not isinstance(v, bool) else json.loads(v) if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", _need(v, str)) else float("x")
    except (ValueError, TypeError):
        raise JqError(f"{kind(v)} ({_shown(v)}) cannot be parsed as a number") from None


def _contains(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_contains(x, y) for x in a) for y in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    if _RANK[type(a)] != _RANK[type(b)]:
        raise JqError(f"{kind(a)} and {kind(b)} cannot have their containment checked")
    return compare(a, b) == 0


def _flatten(v: list, depth: float) -> list:
    out: list = []
    for x in _need(v, list):
        out += _flatten(x, depth - 1) if isinstance(x, list) and depth > 0 else [x]
    return out


def _unique(v: list) -> list:
    return [next(g) for _, g in itertools.groupby(sorted(_need(v, list), key=_order), key=_order)]


def _has(v: Any, k: Any) -> bool:
    return k in v if isinstance(v, dict) and isinstance(k, str) else 0 <= k < len(_need(v, list)) if not isinstance(k, str) else _need(v, dict)


def _from_json(v: Any) -> Any:
    try:
        return json.loads(_need(v, str))
    except ValueError:
        raise JqError(f"{_shown(v)} is not valid JSON") from None


def _entries(v: Any) -> list:
    return [{"key": k, "value": x} for k, x in _need(v, dict).items()]


def _from_entries(v: Any) -> dict:
    out = {}
    for e in _items(v):
        k = next((e[n] for n in ("key", "k", "name", "Name", "Key", "K") if e.get(n) is not None), None)
        out[as_text(k) if not isinstance(k, str) else k] = next((e[n] for n in ("value", "v", "Value", "V") if n in e), None)
    return out


def _math(f: Callable[[float], float]) -> Callable[[Any], Any]:
    return lambda v: _number(float(f(_need(v, int, float))))


def _matches(v: Any, pattern: str, flags: Any) -> list[re.Match]:
    how = 0
    for c in flags or "":
        how |= {"i": re.IGNORECASE, "x": re.VERBOSE, "s": re.DOTALL, "n": 0, "g": 0, "l": 0}.get(c, 0)
    try:
        found = list(re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern), how).finditer(_need(v, str)))
    except re.error as e:
        raise JqError(f"{pattern} is not a valid regular expression: {e}") from None
    return found if "g" in (flags or "") else found[:1]


def _match_value(m: re.Match) -> dict:
    names = {i: n for n, i in m.re.groupindex.items()}
    return {"offset": m.start(), "length": m.end() - m.start(), "string": m.group(), "captures": [{"offset": m.start(i), "length": max(m.end(i) - m.start(i), 0), "string": m.group(i), "name": names.get(i)} for i in range(1, m.re.groups + 1)]}


#: functions of the input alone
PLAIN: dict[str, Callable[[Any], Any]] = {
    "not": lambda v: not truth(v),
    "length": _length,
    "utf8bytelength": lambda v: len(_need(v, str).encode()),
    "keys": _keys,
    "keys_unsorted": lambda v: list(v) if isinstance(v, dict) else _keys(v),
    "add": lambda v: functools.reduce(lambda a, b: arithmetic("+", a, b), _items(v), None),
    "any": lambda v: any(map(truth, _items(v))),
    "all": lambda v: all(map(truth, _items(v))),
    "flatten": lambda v: _flatten(v, math.inf),
    "floor": _math(math.floor),
    "ceil": _math(math.ceil),
    "round": _math(lambda x: math.floor(x + 0.5)),
    "sqrt": _math(math.sqrt),
    "fabs": _math(abs),
    "abs": lambda v: abs(_need(v, int, float)),
    "exp": _math(math.exp),
    "log": _math(math.log),
    "log2": _math(math.log2),
    "log10": _math(math.log10),
    "tostring": as_text,
    "tonumber": _to_number,
    "type": kind,
    "sort": lambda v: sorted(_need(v, list), key=_order),
    "unique": _unique,
    "reverse": lambda v: [] if v is None else v[::-1] if isinstance(v, (str, list)) else _need(v, list),
    "min": lambda v: min(_need(v, list), key=_order, default=None),
    "max": lambda v: max(reversed(_need(v, list)), key=_order, default=None),
    "to_entries": _entries,
    "from_entries": _from_entries,
    "ascii_downcase": lambda v: "".join(c.lower() if c.isascii() else c for c in _need(v, str)),
    "ascii_upcase": lambda v: "".join(c.upper() if c.isascii() else c for c in _need(v, str)),
    "explode": lambda v: [ord(c) for c in _need(v, str)],
    "implode": lambda v: "".join(map(chr, _need(v, list))),
    "trim": lambda v: _need(v, str).strip(),
    "ltrim": lambda v: _need(v, str).lstrip(),
    "rtrim": lambda v: _need(v, str).rstrip(),
    "tojson": lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":")),
    "fromjson": _from_json,
    "transpose": lambda v: [list(r) for r in itertools.zip_longest(*_need(v, list))],
    "isnan": lambda v: v != v,
    "isinfinite": lambda v: math.isinf(_need(v, int, float)),
    "isnormal": lambda v: math.isfinite(_need(v, int, float)) and v != 0,
    "first": lambda v: get(v, 0),
    "last": lambda v: get(v, -1),
    "ascii": lambda v: chr(_need(v, int)),
    "tojson_canonical": canonical,
}
#: functions of the input and of the values of their arguments (all combinations)
VALUED: dict[tuple[str, int], Callable[..., Any]] = {
    ("has", 1): _has,
    ("in", 1): lambda v, o: _has(o, v),
    ("contains", 1): _contains,
    ("inside", 1): lambda v, o: _contains(o, v),
    ("startswith", 1): lambda v, s: _need(v, str).startswith(_need(s, str)),
    ("endswith", 1): lambda v, s: _need(v, str).endswith(_need(s, str)),
    ("ltrimstr", 1): lambda v, s: v[len(s) :] if isinstance(v, str) and isinstance(s, str) and v.startswith(s) else v,
    ("rtrimstr", 1): lambda v, s: v[: len(v) - len(s)] if isinstance(v, str) and isinstance(s, str) and s and v.endswith(s) else v,
    ("split", 1): lambda v, s: arithmetic("/", _need(v, str), _need(s, str)),
    ("split", 2): lambda v, s, f: re.split(s, _need(v, str)),
    ("join", 1): lambda v, s: s.join("" if x is None else as_text(x) for x in _items(v)),
    ("flatten", 1): _flatten,
    ("test", 1): lambda v, r: bool(_matches(v, *(r if isinstance(r, list) else [r]), *([None] if not isinstance(r, list) or len(r) < 2 else []))),
    ("test", 2): lambda v, r, f: bool(_matches(v, r, f)),
    ("capture", 1): lambda v, r: (lambda m: m[0].groupdict() if m else None)(_matches(v, r, None)),
    ("sub", 2): lambda v, r, s: re.sub(r, s.replace("\\", "\\\\"), _need(v, str), count=1),
    ("gsub", 2): lambda v, r, s: re.sub(r, s.replace("\\", "\\\\"), _need(v, str)),
    ("index", 1): lambda v, s: None if _need(v, str, list) is None or (i := (_indices(v, s) or [None])[0]) is None else i,
    ("rindex", 1): lambda v, s: (_indices(v, s) or [None])[-1],
    ("indices", 1): lambda v, s: _indices(v, s),
    ("getpath", 1): lambda v, p: _getpath(v, p),
    ("setpath", 2): lambda v, p, x: put(v, tuple(p), lambda _: x),
    ("delpaths", 1): lambda v, ps: drop(v, [tuple(p) for p in ps]),
    ("pow", 2): lambda v, a, b: _number(float(a) ** b),
    ("splits", 1): lambda v, s: re.split(s, _need(v, str)),
    ("tojson", 0): PLAIN["tojson"],
    ("bsearch", 1): lambda v, x: next((i for i, y in enumerate(v) if compare(y, x) == 0), -1 - sum(compare(y, x) < 0 for y in v)),
    ("ltrimstr_all", 1): lambda v, s: _need(v, str).lstrip(s),
}


def _indices(v: Any, s: Any) -> list:
    if v is None:
        return []
    if isinstance(v, str):
        return [m.start() for m in re.finditer(f"(?={re.escape(_need(s, str))})", v)] if s else []
    return get(v, s) if isinstance(s, list) else [i for i, x in enumerate(_need(v, list)) if compare(x, s) == 0]


def _getpath(v: Any, path: list) -> Any:
    for k in path:
        if v is None:
            return None
        v = get(v, k)
    return v


def _all_paths(v: Any, at: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    if at:
        yield at, v
    pairs = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
    for k, x in pairs:
        yield from _all_paths(x, (*at, k))


# -- parser -------------------------------------------------------------------

_BINARY = {"==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
_ASSIGN = ("=", "|=", "+=", "-=", "*=", "/=", "%=", "//=")
_KEYWORDS = {"if", "then", "elif", "else", "end", "as", "def", "reduce", "foreach", "try", "catch", "and", "or", "label", "import", "include", "__loc__"}


class _Parser:
    def __init__(self, tokens: list[tuple[str, Any]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> Any:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def next(self) -> Any:
        if self.at >= len(self.tokens):
            raise JqSyntaxError("unexpected end of expression")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, *what: str) -> str | None:
        if self.kind() in ("op", "word") and self.peek() in what:
            return self.next()
        return None

    def expect(self, what: str) -> None:
        if not self.accept(what):
            raise JqSyntaxError(f"expected {what!r}, found {self.peek()!r}")

    def pipe(self) -> Node:
        if self.accept("def"):
            return self.define()
        left = self.comma()
        if self.accept("as"):
            patterns = [self.pattern()]
            while self.accept("?//"):
                patterns.append(self.pattern())
            self.expect("|")
            return _bind(left, patterns, self.pipe())
        if self.accept("|"):
            return _pipe(left, self.pipe())
        return left

    def define(self) -> Node:
        name, params = self.next(), []
        if self.accept("("):
            params.append(self.next())
            while self.accept(";"):
                params.append(self.next())
            self.expect(")")
        self.expect(":")
        body = self.pipe()
        self.expect(";")
        return _define(name, params, body, self.pipe())

    def comma(self) -> Node:
        parts = [self.assign()]
        while self.accept(","):
            parts.append(self.assign())
        return parts[0] if len(parts) == 1 else _comma(parts)

    def assign(self) -> Node:
        left = self.alternative()
        if self.kind() == "op" and self.peek() in _ASSIGN:
            return _assign(self.next(), left, self.alternative())
        return left

    def alternative(self) -> Node:
        left = self.either()
        return _alternative(left, self.alternative()) if self.accept("//") else left

    def either(self) -> Node:
        left = self.both()
        while self.accept("or"):
            left = _logic(left, self.both(), True)
        return left

    def both(self) -> Node:
        left = self.binary(4)
        while self.accept("and"):
            left = _logic(left, self.binary(4), False)
        return left

    def binary(self, level: int) -> Node:
        if level > 6:
            return self.unary()
        left = self.binary(level + 1)
        while self.kind() == "op" and _BINARY.get(self.peek()) == level:
            left = _binary(self.next(), left, self.binary(level + 1))
        return left

    def unary(self) -> Node:
        if self.accept("-"):
            return _binary("-", _constant(0), self.unary())
        return self.postfix()

    def postfix(self) -> Node:
        node = self.term()
        while True:
            if self.kind() == "field":
                node = _index(node, _constant(self.next()[1:]))
            elif self.kind() == "op" and self.peek() == "." and self.at + 1 < len(self.tokens) and (self.tokens[self.at + 1][0] == "str" or self.tokens[self.at + 1][1] == "["):
                self.next()
                if self.kind() == "str":
                    node = _index(node, self.text(self.next()))
            elif self.accept("["):
                node = self.bracket(node)
            elif self.accept("?"):
                node = _try(node, None)
            elif self.kind() == "word" and self.peek() == "as":
                return node
            else:
                return node

    def bracket(self, node: Node) -> Node:
        if self.accept("]"):
            return _iterate(node)
        if self.accept(":"):
            end = self.pipe()
            self.expect("]")
            return _slice(node, None, end)
        inner = self.pipe()
        if self.accept(":"):
            end = None if self.peek() == "]" else self.pipe()
            self.expect("]")
            return _slice(node, inner, end)
        self.expect("]")
        return _index(node, inner)

    def text(self, parts: list, how: Callable[[Any], str] = as_text) -> Node:
        if len(parts) == 1:
            return _constant(parts[0])
        return _interpolate([p if isinstance(p, str) else _Parser(p).whole() for p in parts], how)

    def term(self) -> Node:
        k, v = self.kind(), self.next()
        if k == "num":
            return _constant(_number(float(v)) if not v.isdigit() else int(v))
        if k == "str":
            return self.text(v)
        if k == "fmt":
            if v not in FORMATS:
                raise JqSyntaxError(f"unknown format {v}")
            return self.text(self.next(), FORMATS[v]) if self.kind() == "str" else _plain(FORMATS[v])
        if k == "field":
            return _index(_identity, _constant(v[1:]))
        if k == "var":
            return _variable(v)
        if k == "op":
            if v == ".":
                if self.kind() == "str":
                    return _index(_identity, self.text(self.next()))
                if self.accept("["):
                    return self.bracket(_identity)
                return _identity
            if v == "..":
                return _recurse(_iterate(_identity))
            if v == "(":
                inner = self.pipe()
                self.expect(")")
                return inner
            if v == "[":
                if self.accept("]"):
                    return _constant([])
                inner = self.pipe()
                self.expect("]")
                return _collect(inner)
            if v == "{":
                return self.object()
        if k == "word":
            return self.word(v)
        raise JqSyntaxError(f"unexpected {v!r}")

    def word(self, v: str) -> Node:
        if v in ("true", "false", "null"):
            return _constant({"true": True, "false": False, "null": None}[v])
        if v == "if":
            test = self.pipe()
            self.expect("then")
            cases, other = [(test, self.pipe())], _identity
            while self.accept("elif"):
                test = self.pipe()
                self.expect("then")
                cases.append((test, self.pipe()))
            if self.accept("else"):
                other = self.pipe()
            self.expect("end")
            return _if(cases, other)
        if v == "try":
            body = self.postfix()
            return _try(body, self.postfix() if self.accept("catch") else None)
        if v in ("reduce", "foreach"):
            source = self.postfix()
            self.expect("as")
            pattern = self.pattern()
            self.expect("(")
            parts = [self.pipe()]
            while self.accept(";"):
                parts.append(self.pipe())
            self.expect(")")
            if len(parts) not in ((2,) if v == "reduce" else (2, 3)):
                raise JqSyntaxError(f"{v} takes other arguments")
            return _fold(source, pattern, parts, v == "foreach")
        if v == "label":
            name = self.next()
            self.expect("|")
            return _label(name, self.pipe())
        if v == "break":
            return _break(self.next())
        if v == "def":
            return self.define()
        if v in _KEYWORDS:
            raise JqSyntaxError(f"unexpected {v!r}")
        args = []
        if self.accept("("):
            args.append(self.pipe())
            while self.accept(";"):
                args.append(self.pipe())
            self.expect(")")
        return _call(v, args)

    def object(self) -> Node:
        pairs: list[tuple[Node, Node]] = []
        while not self.accept("}"):
            k, v = self.kind(), self.next()
            if k == "var":
                key, value = _constant(v[1:]), _variable(v)
            elif k == "op" and v == "(":
                key = self.pipe()
                self.expect(")")
                value = None
            elif k == "str":
                key = self.text(v)
                value = _index(_identity, key)
            elif k in ("word", "num", "fmt"):
                key = _constant(v) if k != "fmt" else _plain(FORMATS[v])
                value = _index(_identity, _constant(v))
            else:
                raise JqSyntaxError(f"unexpected {v!r} in an object")
            if self.accept(":"):
                value = self.alternative()
                while self.accept("|"):
                    value = _pipe(value, self.alternative())
            if value is None:
                raise JqSyntaxError("a computed key needs a value")
            pairs.append((key, value))
            if not self.accept(",") and self.peek() != "}":
                raise JqSyntaxError(f"unexpected {self.peek()!r} in an object")
        return _object(pairs)

    def pattern(self) -> Any:
        if self.kind() == "var":
            return self.next()
        if self.accept("["):
            parts = [self.pattern()]
            while self.accept(","):
                parts.append(self.pattern())
            self.expect("]")
            return parts
        self.expect("{")
        out: dict = {}
        while not self.accept("}"):
            k, v = self.kind(), self.next()
            name = v[1:] if k == "var" else v[0] if k == "str" else v
            out[name] = self.pattern() if self.accept(":") else v
            self.accept(",")
        return out

    def whole(self) -> Node:
        node = self.pipe()
        if self.at < len(self.tokens):
            raise JqSyntaxError(f"unexpected {self.peek()!r}")
        return node


# -- nodes --------------------------------------------------------------------


def _identity(p: Path, v: Any, env: dict) -> Emit:
    yield p, v


def _constant(x: Any) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        yield None, x

    return run


def _plain(f: Callable[[Any], Any]) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        yield None, f(v)

    return run


def _variable(name: str) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        if name not in env:
            raise JqError(f"{name} is not defined")
        yield None, env[name]

    return run


def _pipe(a: Node, b: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        for q, x in a(p, v, env):
            yield from b(q, x, env)

    return run


def _comma(parts: list[Node]) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        for n in parts:
            yield from n(p, v, env)

    return run


def _index(node: Node, key: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        for q, x in node(p, v, env):
            for _, k in key(None, v, env):
                yield None if q is None else (*q, k), get(x, k)

    return run


def _slice(node: Node, start: Node | None, end: Node | None) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        for q, x in node(p, v, env):
            for _, a in start(None, v, env) if start else [(None, None)]:
                for _, b in end(None, v, env) if end else [(None, None)]:
                    k = {"start": a, "end": b}
                    yield None if q is None else (*q, k), get(x, k)

    return run


def _iterate(node: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        for q, x in node(p, v, env):
            items = _items(x)
            for k, y in x.items() if isinstance(x, dict) else enumerate(items):
                yield None if q is None else (*q, k), y

    return run


def _recurse(step: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        yield p, v
        if isinstance(v, (list, dict)) or step is not _children:
            try:
                inner = list(step(p, v, env))
            except JqError:
                return
            for q, x in inner:
                yield from run(q, x, env)

    return run


_children = _iterate(_identity)


def _try(body: Node, handler: Node | None) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        try:
            yield from body(p, v, env)
        except JqError as e:
            if handler is not None:
                yield from handler(None, e.value, env)

    return run


def _collect(node: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        yield None, [x for _, x in node(None, v, env)]

    return run


def _object(pairs: list[tuple[Node, Node]]) -> Node:
    def build(i: int, v: Any, env: dict, made: dict) -> Iterator[dict]:
        if i == len(pairs):
            yield made
            return
        for _, k in pairs[i][0](None, v, env):
            if not isinstance(k, str):
                raise JqError(f"object key must be a string, not {kind(k)}")
            for _, x in pairs[i][1](None, v, env):
                yield from build(i + 1, v, env, {**made, k: x})

    def run(p: Path, v: Any, env: dict) -> Emit:
        for made in build(0, v, env, {}):
            yield None, made

    return run


def _interpolate(parts: list, how: Callable[[Any], str]) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        choices = [[x] if isinstance(x, str) else [how(y) for _, y in x(None, v, env)] for x in parts]
        for row in itertools.product(*choices):
            yield None, "".join(row)

    return run


def _binary(op: str, a: Node, b: Node) -> Node:
    tests = {"==": lambda c: c == 0, "!=": lambda c: c != 0, "<": lambda c: c < 0, "<=": lambda c: c <= 0, ">": lambda c: c > 0, ">=": lambda c: c >= 0}

    def run(p: Path, v: Any, env: dict) -> Emit:
        for _, y in b(None, v, env):
            for _, x in a(None, v, env):
                yield None, tests[op](compare(x, y)) if op in tests else arithmetic(op, x, y)

    return run


def _logic(a: Node, b: Node, either: bool) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        for _, x in a(None, v, env):
            if truth(x) == either:
                yield None, either
            else:
                for _, y in b(None, v, env):
                    yield None, truth(y)

    return run


def _alternative(a: Node, b: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        some = False
        try:
            for q, x in a(p, v, env):
                if truth(x):
                    some = True
                    yield q, x
        except JqError:
            pass
        if not some:
            yield from b(p, v, env)

    return run


def _if(cases: list[tuple[Node, Node]], other: Node) -> Node:
    def choose(i: int, p: Path, v: Any, env: dict) -> Emit:
        if i == len(cases):
            yield from other(p, v, env)
            return
        for _, t in cases[i][0](None, v, env):
            yield from cases[i][1](p, v, env) if truth(t) else choose(i + 1, p, v, env)

    return lambda p, v, env: choose(0, p, v, env)


def _names(pattern: Any) -> list[str]:
    if isinstance(pattern, str):
        return [pattern]
    return [n for x in (pattern if isinstance(pattern, list) else pattern.values()) for n in _names(x)]


def _match(pattern: Any, v: Any) -> dict:
    if isinstance(pattern, str):
        return {pattern: v}
    out: dict = {}
    for k, x in enumerate(pattern) if isinstance(pattern, list) else pattern.items():
        out.update(_match(x, get(v, k)))
    return out


def _bind(source: Node, patterns: list, body: Node) -> Node:
    blank = {n: None for p in patterns for n in _names(p)} if len(patterns) > 1 else {}

    def run(p: Path, v: Any, env: dict) -> Emit:
        for _, x in source(None, v, env):
            for i, pattern in enumerate(patterns):
                try:
                    yield from body(p, v, {**env, **blank, **_match(pattern, x)})
                    break
                except JqError:
                    if i == len(patterns) - 1:
                        raise

    return run


def _fold(source: Node, pattern: Any, parts: list[Node], each: bool) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        for _, start in parts[0](None, v, env):
            state = start
            for _, x in source(None, v, env):
                inner = {**env, **_match(pattern, x)}
                made = [y for _, y in parts[1](None, state, inner)]
                if not each:
                    state = made[-1] if made else None
                    continue
                for state in made:  # noqa: B020
                    yield from parts[2](None, state, inner) if len(parts) == 3 else [(None, state)]
            if not each:
                yield None, state

    return run


def _label(name: str, body: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        mark = object()
        try:
            yield from body(p, v, {**env, ("label", name): mark})
        except _Break as b:
            if b.label is not mark:
                raise

    return run


def _break(name: str) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        raise _Break(env.get(("label", name)))
        yield

    return run


def _define(name: str, params: list[str], body: Node, rest: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        yield from rest(p, v, {**env, (name, len(params)): (params, body, env)})

    return run


def _paths(node: Node, v: Any, env: dict) -> list[tuple]:
    out = []
    for p, _ in node((), v, env):
        if p is None:
            raise JqError("invalid path expression")
        out.append(p)
    return out


def _assign(op: str, target: Node, source: Node) -> Node:
    def run(p: Path, v: Any, env: dict) -> Emit:
        if op == "|=":
            out, gone = v, []
            for path in _paths(target, v, env):
                made = list(itertools.islice(source(None, _getpath(out, list(path)), env), 1))
                if made:
                    out = put(out, path, lambda _, x=made[0][1]: x)
                else:
                    gone.append(path)
            yield None, drop(out, gone)
            return
        for _, x in source(None, v, env):
            out = v
            for path in _paths(target, v, env):
                if op == "=":
                    new = lambda old: x  # noqa: E731, B023
                elif op == "//=":
                    new = lambda old: old if truth(old) else x  # noqa: E731, B023
                else:
                    new = lambda old: arithmetic(op[0], old, x)  # noqa: E731, B023
                out = put(out, path, new)
            yield None, out

    return run


def _by(node: Node, v: Any, env: dict) -> list[tuple[Any, Any]]:
    return sorted((([y for _, y in node(None, x, env)], x) for x in _need(v, list)), key=lambda t: _order(t[0]))


def _limited(node: Node, n: Any, p: Path, v: Any, env: dict) -> Emit:
    return itertools.islice(node(p, v, env), max(0, int(n))) if n > 0 else iter(())


def _special(name: str, a: list[Node]) -> Node | None:
    """Builtins that take expressions, not values."""
    key = (name, len(a))

    def gen(f: Callable[..., Emit]) -> Node:
        return lambda p, v, env: f(p, v, env)

    def one(f: Callable[[Any, dict], Any]) -> Node:
        def run(p: Path, v: Any, env: dict) -> Emit:
            yield None, f(v, env)

        return run

    def every(p: Path, v: Any, env: dict) -> Emit:
        return ((q, x) for q, x in _children(p, v, env))

    def until(p: Path, v: Any, env: dict) -> Emit:
        while not truth(next(a[0](None, v, env))[1]):
            p, v = None, next(a[1](None, v, env))[1]
        yield p, v

    def while_(p: Path, v: Any, env: dict) -> Emit:
        for _, t in a[0](None, v, env):
            if truth(t):
                yield p, v
                for _, x in a[1](None, v, env):
                    yield from while_(None, x, env)

    def select(p: Path, v: Any, env: dict) -> Emit:
        for _, t in a[0](None, v, env):
            if truth(t):
                yield p, v

    def map_values(v: Any, env: dict) -> Any:
        made = [(k, [y for _, y in itertools.islice(a[0](None, x, env), 1)]) for k, x in (v.items() if isinstance(v, dict) else enumerate(_items(v)))]
        kept = [(k, y[0]) for k, y in made if y]
        return dict(kept) if isinstance(v, dict) else [y for _, y in kept]

    def with_entries(v: Any, env: dict) -> Any:
        return _from_entries([y for e in _entries(v) for _, y in a[0](None, e, env)])

    def grouped(v: Any, env: dict) -> list:
        return [[x for _, x in g] for _, g in itertools.groupby(_by(a[0], v, env), key=lambda t: _order(t[0]))]

    def range_(p: Path, v: Any, env: dict) -> Emit:
        lists = [[x for _, x in n(None, v, env)] for n in a]
        for args in itertools.product(*lists):
            lo, hi, step = (0, *args, 1) if len(args) == 1 else (*args, 1) if len(args) == 2 else args
            x = lo
            while step and (x < hi if step > 0 else x > hi):
                yield None, x
                x += step

    def walk(v: Any, env: dict) -> Any:
        inner = {k: walk(x, env) for k, x in v.items()} if isinstance(v, dict) else [walk(x, env) for x in v] if isinstance(v, list) else v
        return next(a[0](None, inner, env))[1]

    def found(p: Path, v: Any, env: dict) -> Emit:
        for args in itertools.product(*[[x for _, x in n(None, v, env)] for n in a]):
            flags = (args[1] if len(args) > 1 else "") or ""
            for m in _matches(v, args[0], flags + "g" if name == "scan" else flags):
                if name == "match":
                    yield None, _match_value(m)
                else:
                    yield None, list(m.groups()) if m.re.groups else m.group()

    def error(p: Path, v: Any, env: dict) -> Emit:
        raise JqError(next(a[0](None, v, env))[1] if a else v)
        yield

    def tested(p: Path, v: Any, env: dict) -> Emit:
        source, test = (a[0], a[1]) if len(a) == 2 else (_children, a[0])
        hits = (truth(t) for _, x in source(None, v, env) for _, t in test(None, x, env))
        yield None, any(hits) if name == "any" else all(hits)

    def limit(p: Path, v: Any, env: dict) -> Emit:
        for _, n in a[0](None, v, env):
            yield from _limited(a[1], n, p, v, env)

    def nth(p: Path, v: Any, env: dict) -> Emit:
        for _, n in a[0](None, v, env):
            yield from itertools.islice(a[1](p, v, env), int(n), int(n) + 1) if len(a) > 1 else iter([(None, get(v, n))])

    def last(p: Path, v: Any, env: dict) -> Emit:
        end = None
        for end in a[0](p, v, env):  # noqa: B007
            pass
        if end is not None:
            yield end

    def paths(p: Path, v: Any, env: dict) -> Emit:
        for q, x in _all_paths(v):
            if not a or any(truth(t) for _, t in a[0](None, x, env)):
                yield None, list(q)

    def to_stream(p: Path, v: Any, env: dict) -> Emit:
        for q, x in _all_paths(v):
            if not isinstance(x, (list, dict)) or not x:
                yield None, [list(q), x]

    table: dict[tuple[str, int], Callable[[], Node]] = {
        ("empty", 0): lambda: gen(lambda p, v, env: iter(())),
        ("error", 0): lambda: gen(error),
        ("error", 1): lambda: gen(error),
        ("select", 1): lambda: gen(select),
        ("map", 1): lambda: _collect(_pipe(_children, a[0])),
        ("map_values", 1): lambda: one(map_values),
        ("recurse", 0): lambda: _recurse(_children),
        ("recurse", 1): lambda: _recurse(a[0]),
        ("path", 1): lambda: gen(lambda p, v, env: ((None, list(q)) for q in _paths(a[0], v, env))),
        ("paths", 0): lambda: gen(paths),
        ("paths", 1): lambda: gen(paths),
        ("leaf_paths", 0): lambda: gen(lambda p, v, env: ((None, list(q)) for q, x in _all_paths(v) if not isinstance(x, (list, dict)))),
        ("del", 1): lambda: one(lambda v, env: drop(v, _paths(a[0], v, env))),
        ("with_entries", 1): lambda: one(with_entries),
        ("sort_by", 1): lambda: one(lambda v, env: [x for _, x in _by(a[0], v, env)]),
        ("group_by", 1): lambda: one(grouped),
        ("unique_by", 1): lambda: one(lambda v, env: [g[0] for g in grouped(v, env)]),
        ("min_by", 1): lambda: one(lambda v, env: (_by(a[0], v, env) or [(None, None)])[0][1]),
        ("max_by", 1): lambda: one(lambda v, env: (_by(a[0], v, env) or [(None, None)])[-1][1]),
        ("any", 1): lambda: gen(tested),
        ("any", 2): lambda: gen(tested),
        ("all", 1): lambda: gen(tested),
        ("all", 2): lambda: gen(tested),
        ("add", 1): lambda: one(lambda v, env: functools.reduce(lambda s, x: arithmetic("+", s, x), [x for _, x in a[0](None, v, env)], None)),
        ("range", 1): lambda: gen(range_),
        ("range", 2): lambda: gen(range_),
        ("range", 3): lambda: gen(range_),
        ("first", 1): lambda: gen(lambda p, v, env: _limited(a[0], 1, p, v, env)),
        ("last", 1): lambda: gen(last),
        ("limit", 2): lambda: gen(limit),
        ("nth", 1): lambda: gen(nth),
        ("nth", 2): lambda: gen(nth),
        ("until", 2): lambda: gen(until),
        ("while", 2): lambda: gen(while_),
        ("repeat", 1): lambda: gen(lambda p, v, env: _recurse(a[0])(p, v, env)),
        ("isempty", 1): lambda: one(lambda v, env: next(iter(a[0](None, v, env)), None) is None),
        ("walk", 1): lambda: one(walk),
        ("env", 0): lambda: _constant({}),
        ("input", 0): lambda: gen(error),
        ("scan", 1): lambda: gen(found),
        ("match", 1): lambda: gen(found),
        ("match", 2): lambda: gen(found),
        ("tostream", 0): lambda: gen(to_stream),
        ("values", 0): lambda: gen(lambda p, v, env: iter([(p, v)] if v is not None else [])),
        ("nulls", 0): lambda: gen(lambda p, v, env: iter([(p, v)] if v is None else [])),
        ("scalars", 0): lambda: gen(lambda p, v, env: iter([] if isinstance(v, (list, dict)) else [(p, v)])),
        ("iterables", 0): lambda: gen(lambda p, v, env: iter([(p, v)] if isinstance(v, (list, dict)) else [])),
        ("infinite", 0): lambda: _constant(math.inf),
        ("nan", 0): lambda: _constant(math.nan),
        ("each", 0): lambda: gen(every),
    }
    for what in ("string", "number", "boolean", "array", "object"):
        table[what + "s", 0] = lambda what=what: gen(lambda p, v, env: iter([(p, v)] if kind(v) == what else []))
    return table[key]() if key in table else None


def _call(name: str, args: list[Node]) -> Node:
    special = _special(name, args)
    builtin: Node | None = special
    if builtin is None and not args and name in PLAIN:
        builtin = _plain(PLAIN[name])
    if builtin is None and (name, len(args)) in VALUED:
        f = VALUED[name, len(args)]

        def builtin(p: Path, v: Any, env: dict) -> Emit:
            for row in itertools.product(*[[x for _, x in n(None, v, env)] for n in args]):
                made = f(v, *row)
                q = (*p, *row[0]) if name == "getpath" and p is not None else None
                if name == "splits":
                    yield from ((None, x) for x in made)
                else:
                    yield q, made

    def run(p: Path, v: Any, env: dict) -> Emit:
        own = env.get((name, len(args)))
        if own is None:
            if builtin is None:
                raise JqError(f"{name}/{len(args)} is not defined")
            yield from builtin(p, v, env)
            return
        params, body, scope = own
        if params is None:  # a closure parameter
            yield from body(p, v, scope)
            return
        inner = {**scope, (name, len(params)): own}
        plain_args = []
        for param, arg in zip(params, args, strict=True):
            if param.startswith("$"):
                plain_args.append((param, arg))
            inner[param.lstrip("$"), 0] = (None, arg, env)
        for row in itertools.product(*[[x for _, x in arg(None, v, env)] for _, arg in plain_args]):
            yield from body(p, v, {**inner, **{param: x for (param, _), x in zip(plain_args, row, strict=True)}})

    run.known = builtin is not None or name  # type: ignore[attr-defined]
    return run


def _defined(tokens: list[tuple[str, Any]]) -> set[str]:
    """Names that ``def`` introduces anywhere, with their parameters."""
    out = set()
    for i, (k, v) in enumerate(tokens):
        if k == "word" and v == "def":
            for kk, vv in tokens[i + 1 :]:
                if vv == ":":
                    break
                if kk in ("word", "var"):
                    out.add(vv.lstrip("$"))
        if k == "str":
            for part in v:
                if not isinstance(part, str):
                    out |= _defined(part)
    return out


#: names of all builtins
BUILTINS = sorted({*PLAIN, *(n for n, _ in VALUED)})


def _check(tokens: list[tuple[str, Any]], own: set[str]) -> None:
    for i, (k, v) in enumerate(tokens):
        if k == "str":
            for part in v:
                if not isinstance(part, str):
                    _check(part, own)
        if k != "word" or v in _KEYWORDS or v in own or v in ("true", "false", "null", "break", "then"):
            continue
        before = tokens[i - 1][1] if i else None
        after = tokens[i + 1][1] if i + 1 < len(tokens) else None
        if before in ("{", ",") and after in (":", ",", "}") or before in (".", "def"):
            continue
        if v in PLAIN or any(n == v for n, _ in VALUED) or any(_special(v, [_identity] * n) for n in range(4)):
            continue
        raise JqSyntaxError(f"function {v} is not defined")


def compile_jq(expression: str) -> Node:
    """The program of an expression; ``JqSyntaxError`` where it is none."""
    tokens = _tokens(expression)
    node = _Parser(tokens).whole() if tokens else _identity
    _check(tokens, _defined(tokens))
    return node


_HINTS = (
    ("cannot iterate over: null", " (nothing stands at this path)"),
    ("cannot index", " (no such member, or a value of another type)"),
)


def run_jq(program: Node, value: Any, most: int | None = None) -> tuple[list[Any], list[str]]:
    """Non-null results in order, and errors with a hint. ``most`` ends the run after so many results."""
    out: list[Any] = []
    try:
        for _, x in program((), value, {}):
            if x is not None:
                out.append(x)
                if most and len(out) >= most:
                    break
    except JqError as e:
        text = str(e)
        return out, [text + next((h for part, h in _HINTS if part in text), "")]
    except (RecursionError, _Break, StopIteration, RuntimeError) as e:
        return out, [f"the query broke off: {type(e).__name__}"]
    return out, []
