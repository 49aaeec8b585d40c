"""URL parts and endpoint templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path of an absolute URL
_PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def _usable(url: Column) -> Column:
    """False where the path holds a broken percent escape: such a URL has neither host nor path."""
    return ~F.coalesce(raw_path(url).rlike(_BAD_ESCAPE), F.lit(True))


def url_host(url: Column) -> Column:
    """Lower-case authority without user info, port kept; empty for what is no absolute URL."""
    authority = F.regexp_replace(F.regexp_extract(url, _PARTS, 1), "^.*@", "")
    return F.when(_usable(url), F.lower(authority)).otherwise(F.lit(""))


def percent_decode(text: Column) -> Column:
    """Percent escapes undone, ``+`` kept; undecodable text is left as it is."""
    return F.when(
        F.contains(text, F.lit("%")),
        F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text),
    ).otherwise(text)


def url_path(url: Column) -> Column:
    """Decoded path; empty for what is no absolute URL."""
    return F.when(_usable(url), percent_decode(raw_path(url))).otherwise(F.lit(""))


def url_query(url: Column) -> Column:
    """The text between ``?`` and ``#``, undecoded."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_segment(segment: Column) -> Column:
    """A segment that is an identifier becomes the name of its kind: uuid, then id, then hex."""
    return (
        F.when(segment.rlike(_UUID), F.lit("{uuid}"))
        .when(segment.rlike(r"^[0-9]+\z"), F.lit("{id}"))
        .when(segment.rlike(r"(?i)^[0-9a-f]{8,}\z"), F.lit("{hex}"))
        .otherwise(segment)
    )


def path_template(path: Column) -> Column:
    """The path without query, each identifying segment replaced."""
    bare = F.split_part(path, F.lit("?"), F.lit(1))
    return F.array_join(F.transform(F.split(bare, "/", -1), path_segment), "/")


def cluster_key(session: Column, host: Column, method: Column, template: Column) -> Column:
    """Identifier of an endpoint cluster within a session: 16 hex digits of a SHA-256."""
    zero = F.lit("\0")
    parts = [F.coalesce(c, F.lit("")) for c in (session, host, method, template)]
    return F.substring(F.sha2(F.concat(parts[0], zero, parts[1], zero, parts[2], zero, parts[3]), 256), 1, 16)


def entry_cluster_key() -> Column:
    """``cluster_key`` of a row of ``entries``."""
    url = F.col("url")
    return cluster_key(F.col("session_id"), url_host(url), F.col("request.method"), path_template(url_path(url)))
