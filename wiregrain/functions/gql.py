"""GraphQL requests: operations, top-level fields and fragments, read from a token stream."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from . import jsonkit

_TOKEN = re.compile(r'"""(?:[^"]|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|#[^\n]*|\.\.\.|@\s*\w+|\$\w+|[A-Za-z_]\w*|[{}()\[\]:=!|&]|-?\d[\w.+-]*')
_NAME = re.compile(r"[A-Za-z_]\w*\Z", re.ASCII)
#: words that are no fields wherever they stand
_RESERVED = ("fragment", "on", "true", "false", "null")


@dataclass
class Operation:
    """One operation of a request body."""

    batch_index: int = 0
    name: str = "anonymous"
    type: str = "query"
    fields: list[str] = field(default_factory=list)
    raw_query: str = ""
    variables: Any = None
    parse_failed: bool = False


@dataclass
class Fragment:
    """A named or inline fragment with the fields it selects."""

    name: str
    on_type: str
    is_inline: bool
    fields: list[str]


def _significant(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text) if t[0] != "#"]


def top_fields(tokens: list[str]) -> list[str]:
    """Distinct names at depth one of the first selection set; arguments, directives and spreads do not count, aliases do."""
    out: dict[str, None] = {}
    depth = round_ = 0
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            if depth <= 0:
                break
        elif depth == 0:
            pass
        elif t in "()":
            round_ = max(0, round_ + (1 if t == "(" else -1))
        elif t == "...":
            i += 1
            if i < len(tokens) and tokens[i] == "on":
                i += 1
            if i < len(tokens) and not _NAME.match(tokens[i]):
                i -= 1
        elif depth == 1 and not round_ and _NAME.match(t) and t.lower() not in _RESERVED:
            out[t] = None
        i += 1
    return list(out)


def scan(query: str) -> tuple[str, str, list[str]] | None:
    """Type, name and fields of a query text; nothing for a blank one.

    The first word decides: it may begin with a keyword without a break after it.
    """
    text = query.strip()
    if not text:
        return None
    tokens = _significant(text)
    if text[0] == "{":
        return "query", "", top_fields(tokens)
    m = re.match(r"(?i)(subscription|mutation|query)", text)
    kind, rest = (m.group().lower(), text[m.end() :]) if m else ("query", text)
    name = re.match(r"\s*(\w*)", rest)
    # a default value that is an object opens the selection set as far as this scan is concerned
    return kind, name.group(1) if name else "", top_fields(_significant(rest[rest.find("{") :] if "{" in rest else ""))


def fragments(query: str) -> list[Fragment]:
    """All fragments in order of appearance; those inside a fragment follow it."""
    tokens = _significant(query)
    out: list[Fragment] = []
    for i, t in enumerate(tokens):
        named = t == "fragment" and i + 3 < len(tokens) and tokens[i + 1] != "on" and tokens[i + 2] == "on"
        inline = t == "..." and i + 2 < len(tokens) and tokens[i + 1] == "on"
        if named or inline:
            at = i + (3 if named else 2)
            body = tokens[at + 1 :]
            while body and body[0].startswith("@"):
                body = body[1:]
            if _NAME.match(tokens[at]):
                out.append(Fragment(tokens[i + 1] if named else "", tokens[at], inline, top_fields(body) if body[:1] == ["{"] else []))
    return out


def is_graphql(value: Any) -> bool:
    """Whether a parsed body is a request: a non-empty text ``query`` on the object, or on the first of a batch."""
    first = value[0] if isinstance(value, list) and value else value
    return isinstance(first, dict) and isinstance(first.get("query"), str) and first["query"] != ""


def operations(value: Any) -> tuple[list[Operation], bool] | None:
    """Operations of a parsed body and whether it is a batch; nothing where it is no GraphQL request."""
    batch = isinstance(value, list)
    items = value if batch else [value]
    if not is_graphql(value) or not all(isinstance(x, dict) for x in items):
        return None
    out = []
    for i, item in enumerate(items):
        query, name = item.get("query"), item.get("operationName")
        if not isinstance(query, (str, type(None))) or not isinstance(name, (str, type(None))):
            return None
        op = Operation(batch_index=i, raw_query=query or "", variables=item.get("variables"))
        found = scan(op.raw_query)
        if found:
            op.type, op.name, op.fields = found[0], found[1], found[2]
        else:
            op.parse_failed = op.raw_query != ""
            op.name = ""
        op.name = name or op.name or "anonymous"
        out.append(op)
    return out, batch


def error_flags(value: Any) -> list[bool]:
    """Per response of a batch (or for the one response) whether it carries errors."""
    return [isinstance(x, dict) and isinstance(x.get("errors"), list) and bool(x["errors"]) for x in (value if isinstance(value, list) else [value])]


def typed_objects(value: Any) -> list[tuple[str, str, bool]]:
    """(path, type name, selects nothing else) of objects with a ``__typename``; an outer ``data`` is not part of the path."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[Any, str]] = [(value, "data")]
    while stack:
        v, at = stack.pop()
        if isinstance(v, dict):
            while at == "data" and isinstance(v, dict) and "data" in v:
                v = v["data"]
            if not isinstance(v, dict):
                stack.append((v, at))
                continue
            name = v.get("__typename")
            if isinstance(name, str) and name:
                out.append((at, name, all(x is None for k, x in v.items() if k != "__typename")))
            stack += [(x, f"{at}.{k}") for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(x, f"{at}[{i}]") for i, x in reversed(list(enumerate(v)))]
    return out


def response_shape(value: Any, levels: int = 3) -> list[str]:
    """Sorted key paths below ``data``, ``levels`` deep; ``__typename`` counts only at the top."""
    if not isinstance(value, dict) or not isinstance(value.get("data"), dict):
        return []
    out: list[str] = []
    todo = [(k, v, 1) for k, v in value["data"].items()]
    while todo:
        at, v, level = todo.pop()
        out.append(at)
        if isinstance(v, dict) and level < levels:
            todo += [(f"{at}.{k}", x, level + 1) for k, x in v.items() if k != "__typename"]
    return sorted(out)


def parse_request(text: str) -> tuple[list[Operation], bool] | None:
    """``operations`` of a JSON text."""
    try:
        return operations(jsonkit.parse_json(text))
    except ValueError:
        return None
