"""Captured entries as flat rows: the columns everything else filters, searches and groups by."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content, headers, text, urls
from ..sources.tables import latest_entries


def _or_empty(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(name), F.lit(""))


def _or_zero(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(name), F.lit(0))


#: column name to expression over a row of ``entries``
META: dict[str, Callable[[], Column]] = {
    "session_id": lambda: F.col("session_id"),
    "ts_ms": _or_zero("timings.started_at"),
    "method": _or_empty("request.method"),
    "url": _or_empty("url"),
    "host": lambda: urls.url_host(F.coalesce(F.col("url"), F.lit(""))),
    "path": lambda: urls.url_path(F.coalesce(F.col("url"), F.lit(""))),
    "path_template": lambda: urls.path_template(urls.url_path(F.coalesce(F.col("url"), F.lit("")))),
    "status": _or_zero("response.status_code"),
    "http_version": _or_empty("http_version"),
    "process_name": _or_empty("process.name"),
    "pid": _or_zero("process.pid"),
    "header_names": lambda: F.concat(headers.names(F.col("request.headers")), headers.names(F.col("response.headers"))),
    "header_pairs": lambda: F.concat(headers.pairs(F.col("request.headers")), headers.pairs(F.col("response.headers"))),
    "request_pairs": lambda: headers.pairs(F.col("request.headers")),
    "tls_connection_id": _or_empty("tls.connection_id"),
    "tls_version": _or_zero("tls.tls_version"),
    "ja3": _or_empty("tls.ja3_hash"),
    "ja4": _or_empty("tls.ja4_hashed"),
    "h2_connection_id": _or_empty("http2.connection_id"),
    "h2_stream_id": _or_zero("http2.stream_id"),
    "is_http2": lambda: F.col("http2").isNotNull(),
    "req_body_bytes": lambda: headers.body_bytes(F.col("request.body")),
    "resp_body_bytes": lambda: headers.body_bytes(F.col("response.body")),
    "req_content_type": lambda: headers.first_value(F.col("request.headers"), "content-type"),
    "resp_content_type": lambda: headers.media_type(headers.first_value(F.col("response.headers"), "content-type")),
    "auth_header": lambda: headers.first_value(F.col("request.headers"), "authorization"),
    "cookies": lambda: headers.session_cookies(headers.first_value(F.col("request.headers"), "cookie")),
    "api_keys": lambda: headers.api_keys(F.col("request.headers")),
    "set_cookies": lambda: headers.set_cookies(F.col("response.headers")),
    "req_body": lambda: F.expr("try_to_binary(request.body, 'base64')"),
    "resp_body": lambda: F.expr("try_to_binary(response.body, 'base64')"),
    "has_response": lambda: F.col("response").isNotNull(),
}

SUMMARY = (
    "session_id ts_ms method url host path status http_version process_name pid tls_connection_id ja3 ja4 "
    "h2_connection_id h2_stream_id req_body_bytes resp_body_bytes resp_content_type"
).split()


def with_meta(entries: DataFrame, columns: Sequence[str], *others: str) -> DataFrame:
    """Every delivery with the named columns and ``others`` as they are. What is computed of them in the payload of ``latest_entries`` is not shuffled itself."""
    return entries.select("entry_id", "ingested_at", *[META[c]().alias(c) for c in columns], *others)


def entries_meta(entries: DataFrame, columns: Sequence[str] = SUMMARY) -> DataFrame:
    """``entry_id`` and the named columns of each entry's latest delivery; only these are read and shuffled."""
    return latest_entries(entries, {c: META[c]() for c in columns})


def header_rows(entries: DataFrame) -> DataFrame:
    """One row per complete header: entry_id, side, pos, name, value."""
    kept = latest_entries(entries, {"request": headers.pairs(F.col("request.headers")), "response": headers.pairs(F.col("response.headers"))})

    def side(name: str) -> DataFrame:
        return kept.select("entry_id", F.lit(name).alias("side"), F.posexplode(name).alias("pos", "h")).select("entry_id", "side", "pos", "h.name", "h.value")

    return side("request").unionByName(side("response"))


def credentials(entries: DataFrame) -> DataFrame:
    """Session cookies, API keys and session cookies set: entry_id, kind, name, value."""
    kept = entries_meta(entries, ("cookies", "api_keys", "set_cookies"))

    def of(column: str, kind: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), x["value"].alias("value")))

    every = F.concat(of("cookies", "cookie"), of("api_keys", "api_key"), of("set_cookies", "set_cookie"))
    return kept.select("entry_id", F.explode(every).alias("c")).select("entry_id", "c.kind", "c.name", "c.value")


def content_kinds(entries: DataFrame) -> DataFrame:
    """Entries per media type of the response, with its category."""
    kept = entries_meta(entries, ("resp_content_type",))
    return kept.groupBy("resp_content_type").agg(F.count(F.lit(1)).alias("n")).select("resp_content_type", content.classify(F.col("resp_content_type")).alias("category"), "n")


def url_token_counts(entries: DataFrame) -> DataFrame:
    """How often each token occurs in URLs, over all latest entries."""
    kept = entries_meta(entries, ("url",))
    return kept.select(F.explode(text.url_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def header_token_counts(entries: DataFrame) -> DataFrame:
    kept = entries_meta(entries, ("header_pairs",))
    return kept.select(F.explode(text.header_tokens(F.col("header_pairs"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def sessions_list(sessions: DataFrame) -> DataFrame:
    """Sessions with the number of their listed entries (0 for a null list)."""
    return sessions.select("session_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.size("entry_ids"), F.lit(0)).alias("entry_count"))


def session_entries(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """The listed entries of each session in list order, as far as they exist."""
    listed = sessions.select("session_id", F.posexplode("entry_ids").alias("pos", "entry_id"))
    known = entries_meta(entries, ("url", "status"))
    return listed.join(known, "entry_id").select("session_id", "pos", "entry_id", "url", "status")
