"""Strict JSON for Arrow batches: parsing, typed walks, canonical hashes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import xxhash

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.ASCII | re.DOTALL)


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_quoted = json.encoder.encode_basestring_ascii
_decoder = json.JSONDecoder(parse_constant=_no_constant)


def _iterative(text: str) -> Any:
    """Parse without recursion, for documents nested deeper than the C scanner goes."""
    holder: list[Any] = []
    stack: list[tuple[Any, Any]] = [(holder, None)]
    pos, end, key, want = 0, len(text), None, "value"
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            if text[pos:].strip(" \t\n\r") == "" and len(stack) == 1 and want == "end":
                return holder[0]
            raise ValueError("not JSON")
        pos, (mark, string, scalar) = m.end(), m.groups()
        box = stack[-1][0]
        if want == "end" and len(stack) == 1:
            raise ValueError("text after the value")
        if want in ("key", "key_or_close") and string is not None:
            key, want = json.loads(string), "colon"
            continue
        if want == "colon" and mark == ":":
            want = "value"
            continue
        if mark in ("}", "]") and want in ("comma", "key_or_close", "value_or_close"):
            if (mark == "}") != isinstance(box, dict) or (want == "value_or_close") != (mark == "]" and want != "comma"):
                raise ValueError("unbalanced")
            stack.pop()
            want = "end" if len(stack) == 1 else "comma"
            continue
        if want == "comma" and mark == ",":
            want = "key" if isinstance(box, dict) else "value"
            continue
        if want not in ("value", "value_or_close") or mark in ("}", "]", ",", ":"):
            raise ValueError("not JSON")
        new: Any = {} if mark == "{" else [] if mark == "[" else json.loads(string or scalar)
        if isinstance(box, dict):
            box[key] = new
        else:
            box.append(new)
        if mark:
            stack.append((new, None))
            want = "key_or_close" if mark == "{" else "value_or_close"
        else:
            want = "end" if len(stack) == 1 else "comma"
        if pos > end:
            raise ValueError("not JSON")


def parse_json(text: str) -> Any:
    """The value of a JSON text; ``ValueError`` for anything that is not valid JSON.

    Of members with the same name the last counts. Depth is not limited.
    """
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _iterative(text)


def parse_bytes(raw: bytes | None) -> Any:
    """Like ``parse_json`` for UTF-8 bytes; ``ValueError`` for null."""
    if raw is None:
        raise ValueError("no body")
    return parse_json(raw.decode("utf-8"))


def unfold(value: Any) -> Any:
    """A text that itself is a JSON object or array, as that object or array; else the value."""
    if type(value) is str and value.lstrip(" \t\n\r")[:1] in ("{", "["):
        try:
            return parse_json(value)
        except ValueError:
            return value
    return value


def clean(text: str) -> str:
    """Text that can be encoded: lone surrogates become the replacement character."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def pointer_token(name: str) -> str:
    """One reference token of a JSON Pointer."""
    if "~" in name or "/" in name:
        name = name.replace("~", "~0").replace("/", "~1")
    return name


def kind(value: Any) -> str:
    """string, number, boolean, object, array or null."""
    t = type(value)
    if t is str:
        return "string"
    if t is bool:
        return "boolean"
    if t is int or t is float:
        return "number"
    if t is dict:
        return "object"
    return "array" if t is list else "null"


def canonical(value: Any) -> str:
    """A text equal for equal JSON values: members sorted, 1.0 as 1."""
    t = type(value)
    if t is str:
        return _quoted(value)
    if t is dict:
        return "{" + ",".join([_quoted(k) + ":" + canonical(value[k]) for k in sorted(value)]) + "}"
    if t is list:
        return "[" + ",".join([canonical(x) for x in value]) + "]"
    if t is float:
        return repr(int(value)) if value.is_integer() and abs(value) < 2**53 else repr(value)
    if t is int:
        return repr(value)
    return "null" if value is None else "true" if value else "false"


def canonical_text(value: Any) -> str:
    """``canonical`` of a value of any depth."""
    try:
        return canonical(value)
    except RecursionError:
        return _flat(value)


def value_hash(value: Any) -> int:
    """Signed 64-bit hash of ``canonical``."""
    h = xxhash.xxh64_intdigest(canonical_text(value).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def _flat(value: Any) -> str:
    """Like ``canonical``, without recursion."""
    out: list[str] = []
    stack: list[tuple[bool, Any]] = [(False, value)]
    while stack:
        literal, v = stack.pop()
        if literal:
            out.append(v)
        elif type(v) is dict:
            out.append("{")
            stack.append((True, "}"))
            for i, k in enumerate(sorted(v, reverse=True), 1):
                stack += [(False, v[k]), (True, _quoted(k) + ":")]
                if i < len(v):
                    stack.append((True, ","))
        elif type(v) is list:
            out.append("[")
            stack.append((True, "]"))
            for i, x in enumerate(reversed(v), 1):
                stack.append((False, x))
                if i < len(v):
                    stack.append((True, ","))
        else:
            out.append(canonical(v))
    return "".join(out)


def walk(root: Any) -> Iterator[tuple[str, str, str, tuple[int, ...], str, Any]]:
    """Every node of a document in document order, as path-value-ordinal records.

    Yields pointer, pointer of the nearest enclosing object, path with array
    places left open (``items/*/tags/*``), the ordinals of these places, kind
    and value. Text that is itself JSON is walked in its place. Of the root
    only containers are yielded, with an empty pointer.
    """
    stack: list[tuple[Any, str, str, str, tuple[int, ...]]] = [(unfold(root), "", "", "", ())]
    while stack:
        value, at, owner, group, places = stack.pop()
        t = type(value)
        if t is dict:
            yield at, owner, group, places, "object", None
            for name, child in reversed(value.items()):
                token = "/" + pointer_token(name)
                stack.append((unfold(child) if type(child) is str else child, at + token, at, group + token, places))
        elif t is list:
            yield at, owner, group, places, "array", None
            for i in range(len(value) - 1, -1, -1):
                child = value[i]
                stack.append((unfold(child) if type(child) is str else child, f"{at}/{i}", owner, group + "/*", (*places, i)))
        elif at:
            yield at, owner, group, places, kind(value), value
