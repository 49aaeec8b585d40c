"""Filters, free-text search and weighted ranking over entries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bodies import body_tokens
from ..sources.tables import latest_entries, stage
from .meta import SUMMARY, entries_meta, with_meta


@dataclass(frozen=True)
class Filters:
    """What entries must meet; an unset field is no condition."""

    host: str = ""
    method: str = ""
    status: int = 0
    http_version: str = ""
    process_name: str = ""
    pid: int = 0
    header_name: str = ""
    header_value: tuple[str, str] | None = None
    tls_connection_id: str = ""
    h2_connection_id: str = ""
    ja3: str = ""
    ja4: str = ""
    since_ms: int = 0
    until_ms: int = 0
    time_window_ms: int = 0
    now_ms: int = 0
    path_contains: str = ""
    url_contains: str = ""
    header_contains: str = ""
    body_contains: str = ""
    session_id: str = ""


def host_is(host: str) -> Column:
    """A host by name, or ``*.base`` for a host and all below it; ``*.`` alone is none."""
    low = host.lower()
    if low.startswith("*."):
        base = low[2:]
        return (F.col("host") == base) | F.col("host").endswith("." + base) if base else F.lit(False)
    return F.col("host") == low


def needed_columns(f: Filters) -> set[str]:
    """Columns of ``entries_meta`` that the filters read."""
    out = {c for c in ("host", "method", "status", "http_version", "process_name", "pid", "tls_connection_id", "h2_connection_id", "ja3", "ja4", "session_id") if getattr(f, c)}
    if f.header_name:
        out.add("header_names")
    if f.header_contains or f.header_value:
        out.add("header_pairs")
    if f.since_ms or f.until_ms or f.time_window_ms:
        out.add("ts_ms")
    if f.path_contains:
        out.add("path")
    if f.url_contains:
        out.add("url")
    if f.body_contains:
        out |= {"req_body", "resp_body"}
    return out


def body_text(body: Column) -> Column:
    return F.lower(F.make_valid_utf8(body.cast("string")))


def condition(f: Filters) -> Column:
    """The conjunction of all set filters over columns of ``entries_meta``."""
    tests: list[Column] = []
    if f.host:
        tests.append(host_is(f.host))
    for name in ("method", "status", "http_version", "process_name", "pid", "tls_connection_id", "h2_connection_id", "ja3", "ja4", "session_id"):
        if getattr(f, name):
            tests.append(F.col(name) == getattr(f, name))
    if f.header_name:
        tests.append(F.array_contains("header_names", f.header_name.lower()))
    if f.header_value:
        tests.append(F.exists("header_pairs", lambda h: (h["name"] == f.header_value[0].lower()) & (h["value"] == f.header_value[1])))
    since, until = (f.now_ms - f.time_window_ms, f.now_ms) if f.time_window_ms > 0 else (f.since_ms, f.until_ms)
    if since > 0:
        tests.append(F.col("ts_ms") >= since)
    if until > 0:
        tests.append(F.col("ts_ms") <= until)
    if f.path_contains:
        tests.append(F.contains(F.lower("path"), F.lit(f.path_contains.lower())))
    if f.url_contains:
        tests.append(F.contains(F.lower("url"), F.lit(f.url_contains.lower())))
    if f.header_contains:
        tests.append(F.exists("header_pairs", lambda h: F.contains(F.lower(F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), F.lit(f.header_contains.lower()))))
    if f.body_contains:
        low = F.lit(f.body_contains.lower())
        tests.append(F.coalesce(F.contains(body_text(F.col("req_body")), low), F.lit(False)) | F.coalesce(F.contains(body_text(F.col("resp_body")), low), F.lit(False)))
    out: Column = F.lit(True)
    for t in tests:
        out = out & t
    return out


def filtered(entries: DataFrame, f: Filters, columns: tuple[str, ...] = ("url", "ts_ms")) -> DataFrame:
    """entry_id and ``columns`` of the entries that meet the filters."""
    wanted = [c for c in columns if c != "entry_id"]
    flat = with_meta(entries, sorted({*wanted, *needed_columns(f)}))
    # the filters are decided before the shuffle, so bodies and headers that they read are not moved
    kept = latest_entries(flat, {**{c: F.col(c) for c in wanted}, "_meets": condition(f)})
    return kept.where("_meets").select("entry_id", *wanted)


def _body_tokens(most: int | None) -> Callable[..., pd.Series]:
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([sorted({*body_tokens(y, w, most), *body_tokens(z, x, most)}) for w, y, x, z in zip(a, b, c, d, strict=True)])

    return run


def body_token_counts(entries: DataFrame, most: int | None = None) -> DataFrame:
    """In how many entries each token occurs in a body."""
    kept = entries_meta(entries, ("req_content_type", "req_body", "resp_content_type", "resp_body"))
    split = F.pandas_udf(_body_tokens(most), "array<string>")
    found = kept.select(F.explode(split("req_content_type", "req_body", "resp_content_type", "resp_body")).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n_entries"))


def search(entries: DataFrame, query: str = "", f: Filters = Filters(), limit: int | None = 20, offset: int = 0, body_index: bool = False, body_index_bytes: int | None = None) -> DataFrame:  # noqa: B008
    """Ranked entries: every token of ``query`` must occur in URL, headers or (with ``body_index``) bodies.

    The score adds 0.4, 0.3 and 0.2 times the share of asked tokens found in
    URL, headers and bodies, 0.1 for a method filter, 0.3 times the recency
    among the hits, 0.2 for a header-name filter, and 0.1. Ties go to the
    smaller entry id. ``limit=None`` ranks all. ``body_index_bytes`` cuts
    each body before it is indexed.
    """
    asked = text.ask(query)
    extra = {"ts_ms", "url", "header_pairs"} | ({"req_body", "resp_body", "req_content_type"} if body_index else set())
    kept = entries_meta(entries, sorted({*SUMMARY, *extra, *needed_columns(f)})).where(condition(f))
    kept = kept.withColumn("_url", text.url_tokens(F.col("url"))).withColumn("_head", text.header_tokens(F.col("header_pairs")))
    none = F.array().cast("array<string>")
    if body_index:
        split = F.pandas_udf(_body_tokens(body_index_bytes), "array<string>")
        kept = kept.withColumn("_body", split("req_content_type", "req_body", "resp_content_type", "resp_body"))
    else:
        kept = kept.withColumn("_body", none)
    for t in dict.fromkeys(asked):
        kept = kept.where(F.array_contains("_url", t) | F.array_contains("_head", t) | F.array_contains("_body", t))
    n = max(len(asked), 1)
    marks = F.array_compact(F.array(*[F.when(F.array_contains("_url", t), F.lit(t)) for t in asked])) if asked else none
    parts = (("url", "_url"), ("header", "_head"), ("body", "_body"))
    # the hits are found once; the span of their times is read from what was written
    kept = stage(kept.select("entry_id", *SUMMARY, marks.alias("_marks"), *[text.hits(asked, F.col(c)).alias(f"_n{k}") for k, c in parts]), "hits")
    lo, hi = kept.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    found = {k: F.col(f"_n{k}") for k, _ in parts}
    recency = (F.col("ts_ms") - (lo or 0)) / F.lit(max((hi or 0) - (lo or 0), 1))
    score = found["url"] / n * 0.4 + found["header"] / n * 0.3 + found["body"] / n * 0.2 + recency * 0.3
    score = score + F.lit((0.1 if f.method else 0.0) + (0.2 if f.header_name else 0.0) + 0.1)
    where = F.array_compact(F.array(*[F.when(v > 0, F.lit(k)) for k, v in found.items()]))
    ranked = kept.select(
        "entry_id", *SUMMARY, F.round(score, 6).alias("score"), F.array_join("_marks", ",").alias("highlights"), F.array_join(where, ",").alias("matched_in")
    )
    ranked = ranked.orderBy(F.desc("score"), "entry_id")
    if offset:
        ranked = ranked.offset(offset)
    return ranked.limit(limit) if limit is not None else ranked


def body_matches(entries: DataFrame, needle: str, context: int = 50, limit: int | None = None) -> DataFrame:
    """Where a text occurs in bodies: the request first, then the response, with the text around the first hit."""
    low = needle.lower()
    flat = with_meta(entries, ("url", "req_body", "resp_body"))
    req, resp = (F.make_valid_utf8(F.col(c).cast("string")) for c in ("req_body", "resp_body"))
    in_req = F.coalesce(F.contains(F.lower(req), F.lit(low)), F.lit(False))
    in_resp = F.coalesce(F.contains(F.lower(resp), F.lit(low)), F.lit(False))
    body = F.when(in_req, req).otherwise(resp)
    at = F.instr(F.lower(body), low)
    start = F.greatest(at - context, F.lit(1))
    snippet = F.substring(body, start, at - start + len(needle) + context)
    target = F.when(in_req, "request").when(in_resp, "response")
    # only the text around a hit is shuffled
    kept = latest_entries(flat, {"url": F.col("url"), "target": target, "snippet": F.when(target.isNotNull(), snippet)})
    out = kept.where("target is not null").select("entry_id", "url", "target", "snippet").orderBy("entry_id")
    return out if limit is None else out.limit(limit)
