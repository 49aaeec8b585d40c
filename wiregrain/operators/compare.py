"""Fingerprints of entries and differences between two."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers
from ..sources.tables import latest_entries, places
from .meta import META, entries_meta

# Headers and query keys that differ between any two requests.
IGNORED_HEADERS = (
    "date", "x-request-id", "x-correlation-id", "x-trace-id", "x-amzn-requestid", "x-amzn-trace-id",
    "cf-ray", "x-cache", "age", "expires", "last-modified", "etag",
)
IGNORED_QUERY_KEYS = ("_", "t", "ts", "timestamp", "time", "rand", "random", "nonce", "cb", "cachebuster")


def client_versions(hellos: DataFrame) -> DataFrame:
    """TLS version each connection's last ClientHello offers: connection_id, client_tls."""
    return hellos.where("side = 'client' and connection_id is not null").groupBy(F.col("connection_id").alias("tls_connection_id")).agg(F.max_by("version.name", F.struct("seen_at", "version.name")).alias("client_tls"))


def fingerprints(entries: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """Canonical form of each entry: ordered and normalised header names, pseudo headers, body sizes and hashes."""

    def body_hash(column: str, size: str) -> Column:
        raw = F.expr(f"try_to_binary({column}, 'base64')")
        n = META[size]()
        return F.coalesce(F.when((n > 0) & (n <= max_bytes), F.sha2(raw, 256)), F.lit(""))

    pair = lambda h: F.concat(h["name"], F.lit("="), F.coalesce(h["value"], F.lit("")))
    request = headers.pairs(F.col("request.headers"))
    kept = latest_entries(
        entries,
        {
            "headers_ordered": F.array_join(F.transform(request, lambda h: h["name"]), ","),
            "headers_normalized": F.array_join(F.array_sort(F.array_distinct(F.transform(request, lambda h: h["name"]))), ","),
            "pseudo_headers": F.when(F.col("http2").isNotNull(), F.array_join(F.transform(F.filter(request, lambda h: h["name"].startswith(":")), pair), ",")).otherwise(""),
            "req_bytes": META["req_body_bytes"](),
            "req_hash": body_hash("request.body", "req_body_bytes"),
            "resp_bytes": META["resp_body_bytes"](),
            "resp_hash": body_hash("response.body", "resp_body_bytes"),
            "ja3": META["ja3"](),
            "ja4": META["ja4"](),
        },
    )
    return kept


_SIDE = ("request_pairs", "http_version", "ja3", "ja4", "tls_connection_id", "is_http2", "h2_stream_id")


def neighbour_pairs(entries: DataFrame) -> DataFrame:
    """Each entry with the next one of the same session, host, method and path template: baseline_id, candidate_id."""
    keys = ["session_id", "host", "method", "path_template"]
    ranked = places(entries_meta(entries, (*keys, "ts_ms")), keys, ["ts_ms", "entry_id"]).select(*keys, "place", "entry_id")
    nxt = ranked.select(*keys, (F.col("place") - 1).alias("place"), F.col("entry_id").alias("candidate_id"))
    return ranked.join(nxt, [*keys, "place"]).select(F.col("entry_id").alias("baseline_id"), "candidate_id")


def _sides(entries: DataFrame, pairs: DataFrame, hellos: DataFrame | None) -> DataFrame:
    kept = entries_meta(entries, _SIDE)
    if hellos is not None:
        kept = kept.join(client_versions(hellos), "tls_connection_id", "left")
    else:
        kept = kept.withColumn("client_tls", F.lit(None).cast("string"))
    kept = kept.withColumn("client_tls", F.coalesce("client_tls", F.lit("")))
    cols = [*_SIDE, "client_tls"]
    a = kept.select(F.col("entry_id").alias("baseline_id"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = kept.select(F.col("entry_id").alias("candidate_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return pairs.join(a, "baseline_id").join(b, "candidate_id")


def _names(side: str) -> Column:
    return F.transform(F.filter(f"{side}_request_pairs", lambda h: ~h["name"].startswith(":")), lambda h: h["name"])


def diffs(entries: DataFrame, pairs: DataFrame, hellos: DataFrame | None = None, ignore: Sequence[str] = IGNORED_HEADERS) -> DataFrame:
    """One row per pair: header names missing, extra, changed and ignored, changes of order, protocol, TLS and HTTP/2, and severity.

    High: another JA4 or protocol, or three and more headers missing or extra.
    Medium: any other header difference or another HTTP/2 stream. Low: only
    ignored headers are on both sides. Another JA3 alone changes nothing.
    """
    two = _sides(entries, pairs, hellos)
    noisy = F.array(*[F.lit(i.lower()) for i in ignore]) if ignore else F.array().cast("array<string>")
    all_a, all_b = (F.array_distinct(F.transform(f"{s}_request_pairs", lambda h: h["name"])) for s in "ab")
    common = F.array_intersect(all_a, all_b)

    def of(side: str, name: Column) -> Column:
        return F.transform(F.filter(f"{side}_request_pairs", lambda h: h["name"] == name), lambda h: F.coalesce(h["value"], F.lit("")))

    changed = F.filter(F.array_except(common, noisy), lambda n: of("a", n) != of("b", n))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    pseudo = [F.when(F.col(f"{s}_is_http2"), F.filter(f"{s}_request_pairs", lambda h: h["name"].startswith(":"))).otherwise(F.array().cast("array<struct<name:string,value:string>>")) for s in "ab"]
    stream = [F.when(F.col(f"{s}_is_http2"), F.col(f"{s}_h2_stream_id")).otherwise(0) for s in "ab"]
    out = two.select(
        "baseline_id",
        "candidate_id",
        F.array_except(F.array_except(all_a, all_b), noisy).alias("_missing"),
        F.array_except(F.array_except(all_b, all_a), noisy).alias("_extra"),
        changed.alias("_changed"),
        F.array_intersect(common, noisy).alias("_ignored"),
        (_names("a") != _names("b")).alias("order_changed"),
        (a("http_version") != b("http_version")).alias("protocol_changed"),
        (a("ja3") != b("ja3")).alias("ja3_changed"),
        (a("ja4") != b("ja4")).alias("ja4_changed"),
        (a("client_tls") != b("client_tls")).alias("tls_version_changed"),
        ((F.col("a_is_http2") | F.col("b_is_http2")) & ((pseudo[0] != pseudo[1]) | (stream[0] != stream[1]))).alias("http2_changed"),
    )
    moved = F.size("_missing") + F.size("_extra")
    severity = (
        F.when(F.col("ja4_changed") | F.col("protocol_changed") | (moved >= 3), "high")
        .when(F.col("order_changed") | (moved > 0) | (F.size("_changed") > 0) | F.col("http2_changed"), "medium")
        .when(F.size("_ignored") > 0, "low")
        .otherwise("none")
    )
    return out.select(
        "baseline_id", "candidate_id", text("_missing").alias("headers_missing"), text("_extra").alias("headers_extra"), text("_changed").alias("headers_changed"), text("_ignored").alias("headers_ignored"),
        "order_changed", "protocol_changed", "ja3_changed", "ja4_changed", "tls_version_changed", "http2_changed", severity.alias("severity"),
    )


def common_order(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence of two lists of header names."""
    width = len(b) + 1
    best = [[0] * width for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def moved_headers(a: list[str], b: list[str]) -> list[str]:
    """``name:from>to`` of headers in both lists that are not in their common order; sorted by name."""
    kept = set(common_order(a, b))
    return [f"{n}:{a.index(n)}>{b.index(n)}" for n in sorted(set(a) & set(b)) if n not in kept]


def _moves(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([",".join(moved_headers(list(x), list(y))) for x, y in zip(a, b, strict=True)])


def header_moves(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose header order differs, with the headers that moved (the subsequence itself needs Python)."""
    two = _sides(entries, pairs, None).select("baseline_id", "candidate_id", _names("a").alias("a"), _names("b").alias("b")).where("a <> b")
    return two.select("baseline_id", "candidate_id", F.array_join("a", ",").alias("baseline_order"), F.array_join("b", ",").alias("candidate_order"), F.pandas_udf(_moves, "string")("a", "b").alias("moves"))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
