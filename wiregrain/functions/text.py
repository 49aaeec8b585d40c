"""Search tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

_DELIMITERS = r"[/?&=.\-_:;,@\p{IsWhite_Space}]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens of at least two bytes; repeated tokens stay."""
    return F.filter(F.split(F.lower(text), _DELIMITERS), lambda t: F.octet_length(t) >= 2)


def query_pairs(url: Column) -> Column:
    """(key, value) of a query string, decoded; pairs with a semicolon or a broken escape are dropped."""
    parts = F.filter(F.split(urls.url_query(url), "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")) & ~p.rlike("%(?![0-9A-Fa-f]{2})"))

    def decoded(p: Column) -> Column:
        at = F.instr(p, "=")
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(F.coalesce(F.try_url_decode(key), key).alias("key"), F.coalesce(F.try_url_decode(value), value).alias("value"))

    return F.transform(parts, decoded)


def url_tokens(url: Column) -> Column:
    """Tokens of host, decoded path and decoded query; scheme and fragment do not count."""
    asked = F.flatten(F.transform(query_pairs(url), lambda p: F.array(p["key"], p["value"])))
    return tokens(F.concat_ws(" ", urls.url_host(url), urls.url_path(url), F.array_join(asked, " ")))


def header_tokens(pairs: Column) -> Column:
    """Tokens of ``name: value`` of every header."""
    return tokens(F.array_join(F.transform(pairs, lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), " "))


def hits(asked: list[str], found: Column) -> Column:
    """How many of the asked tokens are among ``found``; each time it is asked counts."""
    total: Column = F.lit(0)
    for t in asked:
        total = total + F.array_contains(found, t).cast("int")
    return total


def ask(text: str) -> list[str]:
    """The tokens of a search text, as ``tokens`` cuts them."""
    import re

    return [t for t in re.split(r"[/?&=.\-_:;,@\s]+", text.lower()) if len(t.encode()) >= 2]
