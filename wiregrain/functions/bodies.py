"""Extraction from one decoded body in any of the five languages; runs in the tasks."""

from __future__ import annotations

import json
import re
import urllib.parse
from typing import Any

from . import dom, jq, jsonkit
from .text import ask as tokens

MODES = ("css", "xpath", "regex", "form", "jq")
_ALIKE = {"json": "jq", "yaml": "jq", "html": "css", "xml": "xpath", "form": "form"}


def category(content_type: str) -> str:
    """Category of a content type, as ``content.classify`` gives it in a plan."""
    m = content_type.split(";")[0].strip().lower()
    if "json" in m:
        return "json"
    if m in ("text/html", "application/xhtml+xml"):
        return "html"
    if "xml" in m:
        return "xml"
    if "yaml" in m:
        return "yaml"
    if m in ("text/csv", "text/tab-separated-values"):
        return "csv"
    if m == "application/x-www-form-urlencoded":
        return "form"
    return "text" if m.startswith("text/") else "binary"


def is_binary(content_type: str, body: bytes) -> bool:
    c = content_type.lower()
    if c.startswith("text/") or re.search("json|xml|javascript|html|css|yaml|form-urlencoded", c):
        return False
    if re.match("(image|audio|video)/", c) or re.search("octet-stream|gzip|zip|pdf", c):
        return True
    try:
        body.decode("utf-8")
        return False
    except UnicodeDecodeError:
        return True


def default_mode(content_type: str) -> str:
    return _ALIKE.get(category(content_type), "regex")


def parse_yaml(text: str) -> Any:
    """A YAML text as JSON values; keys become text."""
    import yaml

    def plain(v: Any) -> Any:
        if isinstance(v, dict):
            return {k if isinstance(k, str) else json.dumps(k) if isinstance(k, (bool, type(None))) else str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple, set)):
            return [plain(x) for x in v]
        return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)

    try:
        return plain(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise ValueError(f"no YAML: {e}") from None


def parse_form(text: str) -> dict[str, list[str]]:
    """Values per key of a urlencoded body; pairs with a semicolon or a broken escape are an error."""
    out: dict[str, list[str]] = {}
    for pair in filter(None, text.split("&")):
        if ";" in pair or re.search("%(?![0-9A-Fa-f]{2})", pair):
            raise ValueError(f"no form data: {pair[:40]}")
        key, _, value = pair.partition("=")
        out.setdefault(urllib.parse.unquote_plus(key), []).append(urllib.parse.unquote_plus(value))
    return out


class Extractor:
    """An expression compiled once, applied to many bodies."""

    def __init__(self, expression: str, mode: str = "", most: int = 1000):
        if mode and mode not in MODES:
            raise ValueError(f"unknown mode: {mode!r} (valid: {', '.join(MODES)})")
        if not expression:
            raise ValueError("an expression is required")
        self.expression, self.mode, self.most = expression, mode, most
        self.programs: dict[str, Any] = {}
        if mode:
            self.program(mode)

    def program(self, mode: str) -> Any:
        """What the expression compiles to; ``ValueError`` where it is none of the mode."""
        if mode not in self.programs:
            if mode == "jq":
                self.programs[mode] = jq.compile_jq(self.expression)
            elif mode == "regex":
                try:
                    self.programs[mode] = re.compile(self.expression)
                except re.error as e:
                    raise ValueError(f"invalid regex: {e}") from None
            elif mode == "xpath":
                self.programs[mode] = dom.compile_xpath(self.expression)
            else:
                self.programs[mode] = self.expression
        return self.programs[mode]

    def __call__(self, body: bytes, content_type: str) -> tuple[str, list[Any], list[str]]:
        """Mode, values and run-time errors; ``ValueError`` where nothing could be run."""
        mode = self.mode or default_mode(content_type)
        program = self.program(mode)
        text = body.decode("utf-8", "replace")
        if mode == "jq":
            value = jsonkit.parse_json(text) if "json" in content_type.lower() else parse_yaml(text)
            return mode, *jq.run_jq(program, value, self.most)
        if mode == "css":
            return mode, dom.css_texts(dom.parse_html(text), self.expression, self.most), []
        if mode == "xpath":
            root = dom.parse_html(text) if category(content_type) == "html" else dom.parse_xml(text)
            return mode, dom.xpath_texts(root, self.expression, self.most), []
        if mode == "regex":
            found = [m.group(1) if program.groups else m.group() for m in program.finditer(text)]
            return mode, [x or "" for x in found[: self.most or None]], []
        form = parse_form(text)
        if self.expression in ("*", "."):
            return mode, [{k: v[0] if len(v) == 1 else v for k, v in form.items()}], []
        return mode, form.get(self.expression, [])[: self.most or None], []


def body_tokens(body: bytes | None, content_type: str, most: int | None = None) -> list[str]:
    """Search tokens of a body by category; with ``most`` only of its first bytes.

    JSON gives member names and text values (broken JSON its plain text),
    HTML and XML the text outside tags, forms keys and values, text and CSV
    everything; other bodies have none.
    """
    kind = category(content_type)
    if not body or kind == "binary":
        return []
    text = body[:most].decode("utf-8", "replace")
    if kind == "json":
        try:
            parts, stack = [], [jsonkit.parse_json(text)]
            while stack:
                v = stack.pop()
                if isinstance(v, dict):
                    parts += v
                    stack += v.values()
                elif isinstance(v, list):
                    stack += v
                elif isinstance(v, str):
                    parts.append(v)
            text = " ".join(parts)
        except ValueError:
            pass
    elif kind in ("html", "xml"):
        text = re.sub("<[^>]*>", " ", text)
    elif kind == "form":
        try:
            text = " ".join(x for k, vs in parse_form(text).items() for x in (k, *vs))
        except ValueError:
            pass
    elif kind == "yaml":
        return []
    return tokens(text)


def validate_expression(expression: str, mode: str) -> None:
    """``ValueError`` where an expression is none of the mode."""
    Extractor(expression, mode)


def compact(value: Any, items: int = 3, length: int = 500, depth: int = 0, level: int = 0) -> Any:
    """A JSON value with long arrays and texts shortened; ``depth`` 0 is no limit, ``length`` counts bytes."""
    if depth and level >= depth:
        return "[max depth]"
    if isinstance(value, list):
        kept = value if items <= 0 else value[:items]
        out = [compact(v, items, length, depth, level + 1) for v in kept]
        return out if len(kept) == len(value) else [*out, f"... ({len(value) - len(kept)} more items)"]
    if isinstance(value, dict):
        return {k: compact(v, items, length, depth, level + 1) for k, v in value.items()}
    if isinstance(value, str) and 0 < length < len(raw := value.encode("utf-8", "replace")):
        return raw[:length].decode("utf-8", "ignore") + f"... ({len(raw) - length} more chars)"
    return value


def truncate_utf8(text: str, most: int) -> str:
    """At most ``most`` bytes, no character cut."""
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def display(body: bytes | None, content_type: str, mode: str = "compact", max_bytes: int = 0) -> str:
    """A body for display: ``compact``, ``schema`` or ``full``; binary bodies as a placeholder."""
    if not body:
        return ""
    if is_binary(content_type, body):
        return f"[binary content, {len(body)} bytes]"
    text = body.decode("utf-8", "replace")
    if mode != "full" and "json" in content_type.lower():
        try:
            value = jsonkit.parse_json(text)
            if mode == "schema":
                from .schemas import Shape

                return json.dumps(Shape.of(value).schema(), ensure_ascii=False)
            return json.dumps(compact(value), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        except ValueError:
            pass
    if max_bytes and len(body) > max_bytes:
        cut = truncate_utf8(text, max_bytes)
        return f"{cut}\n... [truncated, showing {len(cut.encode())} of {len(body)} bytes]"
    return text
