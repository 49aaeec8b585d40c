"""Ordered header lists (array of [name, value], duplicates and ragged pairs allowed) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cookie names that hold a session, and parts of names that say so.
SESSION_COOKIE_NAMES = ("jsessionid", "phpsessid", "asp.net_sessionid", "connect.sid", "_session", "_session_id")
SESSION_COOKIE_PARTS = ("session", "sid", "auth", "token", "jwt")
# Request headers that hold an API key.
API_KEY_HEADERS = ("x-api-key", "x-auth-token", "x-access-token")

_PAIR = "array<struct<name:string,value:string>>"


def _none() -> Column:
    return F.array().cast(_PAIR)


def pairs(headers: Column) -> Column:
    """(lower-case name, value) of every complete pair, in order; an empty list for null."""
    whole = F.filter(headers, lambda h: F.size(h) >= 2)
    made = F.transform(whole, lambda h: F.struct(F.lower(F.get(h, F.lit(0))).alias("name"), F.get(h, F.lit(1)).alias("value")))
    return F.coalesce(made, _none())


def names(headers: Column) -> Column:
    """Distinct lower-case names in first-seen order, ragged pairs included."""
    named = F.filter(headers, lambda h: F.size(h) >= 1)
    return F.coalesce(F.array_distinct(F.transform(named, lambda h: F.lower(F.get(h, F.lit(0))))), F.array().cast("array<string>"))


def first_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name in any letter case; empty where there is none."""
    fitting = F.filter(pairs(headers), lambda h: h["name"] == name)
    return F.coalesce(F.get(fitting, F.lit(0))["value"], F.lit(""))


def all_values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(pairs(headers), lambda h: h["name"] == name), lambda h: h["value"])


def last_wins(named: Column) -> Column:
    """Of pairs with the same name only the last, in the order of these."""
    later = lambda i: F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0)))
    return F.filter(named, lambda x, i: ~F.exists(later(i), lambda y: y["name"] == x["name"]))


def is_session_cookie(name: Column) -> Column:
    low = F.lower(name)
    test = low.isin(*SESSION_COOKIE_NAMES)
    for part in SESSION_COOKIE_PARTS:
        test = test | F.contains(low, F.lit(part))
    return test


def _cookie(text: Column) -> Column:
    """name and value around the first ``=``; a null name where there is none before it."""
    at = F.instr(text, "=")
    return F.struct(
        F.when(at > 1, F.trim(F.substring(text, F.lit(1), at - 1))).alias("name"),
        F.trim(F.substring(text, at + 1, F.length(text))).alias("value"),
    )


def session_cookies(cookie_header: Column) -> Column:
    """Session cookies of a ``Cookie`` header as (name, value), the last of a name."""
    found = F.transform(F.split(cookie_header, ";", -1), lambda p: _cookie(F.trim(p)))
    return last_wins(F.filter(F.coalesce(found, _none()), lambda c: c["name"].isNotNull() & is_session_cookie(c["name"])))


def set_cookies(headers: Column) -> Column:
    """Session cookies set by a response as (name, value up to the first semicolon)."""

    def parsed(text: Column) -> Column:
        at = F.instr(text, "=")
        value = F.split_part(F.substring(text, at + 1, F.length(text)), F.lit(";"), F.lit(1))
        return F.struct(F.when(at > 1, F.trim(F.substring(text, F.lit(1), at - 1))).alias("name"), F.trim(value).alias("value"))

    found = F.transform(all_values(headers, "set-cookie"), parsed)
    return last_wins(F.filter(found, lambda c: c["name"].isNotNull() & is_session_cookie(c["name"])))


def api_keys(headers: Column) -> Column:
    return last_wins(F.filter(pairs(headers), lambda h: h["name"].isin(*API_KEY_HEADERS)))


def media_type(content_type: Column) -> Column:
    """Content type without parameters, lower case."""
    return F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))


def body_bytes(encoded: Column) -> Column:
    """Decoded size of a base64 body; an estimate where it cannot be decoded, 0 for none."""
    n = F.length(encoded)
    padding = F.when(encoded.endswith("=="), 2).when(encoded.endswith("="), 1).otherwise(0)
    estimate = F.floor(n * 3 / 4) - padding
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.coalesce(F.octet_length(F.try_to_binary(encoded, F.lit("base64"))), estimate)).cast("bigint")
