"""Endpoint clusters: entries grouped by host, method and path template, with statistics and descriptions."""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import content, text
from ..sources.tables import places, stage
from .meta import entries_meta
from .search import Filters, condition, needed_columns

KEY = ("host", "method", "path_template")
_INPUT = ("host", "method", "path_template", "path", "ts_ms", "status", "resp_content_type", "resp_body_bytes", "auth_header", "cookies", "api_keys")


@dataclass(frozen=True)
class Scope:
    """Which entries are clustered."""

    host: str = ""
    method: str = ""
    process_name: str = ""
    pid: int = 0
    since_ms: int = 0
    until_ms: int = 0
    time_window_ms: int = 0
    now_ms: int = 0

    def filters(self) -> Filters:
        return Filters(host=self.host, method=self.method.upper(), process_name=self.process_name, pid=self.pid, since_ms=self.since_ms, until_ms=self.until_ms, time_window_ms=self.time_window_ms, now_ms=self.now_ms)


def cluster_id() -> Column:
    """12 hex digits of a SHA-256 of the key."""
    zero = F.lit("\0")
    return F.substring(F.sha2(F.concat(F.col("host"), zero, F.col("method"), zero, F.col("path_template")), 256), 1, 12)


def scope_hash(scope: Scope | None = None, min_count: int = 0, category: str = "") -> str:
    """16 hex digits that name a scope; ``default`` where nothing is restricted."""
    if (scope is None or scope == Scope()) and not min_count and not category:
        return "default"
    parts = [*(str(v) for v in astuple(scope or Scope())[:7]), str(min_count), category]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def scoped_entries(entries: DataFrame, scope: Scope | None = None, normalize_ids: bool = True) -> DataFrame:
    """The columns clustering reads, of the entries in scope."""
    f = (scope or Scope()).filters()
    kept = entries_meta(entries, sorted({*_INPUT, *needed_columns(f)})).where(condition(f))
    return kept if normalize_ids else kept.withColumn("path_template", F.split_part("path", F.lit("?"), F.lit(1)))


def endpoint_clusters(entries: DataFrame, scope: Scope | None = None, min_count: int = 0, category: str = "", normalize_ids: bool = True) -> DataFrame:
    """All clusters with statistics, without a cut.

    One shuffle: entries are reduced to counts per (key, status, content type)
    on the map side, and these small rows give all statistics. Of content
    types that are equally frequent the first by name is the dominant one.
    """
    kept = scoped_entries(entries, scope, normalize_ids)
    has_auth = (F.col("auth_header") != "") | (F.size("cookies") > 0) | (F.size("api_keys") > 0)
    fine = kept.groupBy(*KEY, "status", "resp_content_type").agg(F.count(F.lit(1)).alias("n"), F.sum("resp_body_bytes").alias("bytes"), F.max(has_auth).alias("auth"))
    typed = fine.groupBy(*KEY, "resp_content_type").agg(
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.max("auth").alias("auth"),
        *[F.sum(F.when((F.col("status") != 0) & (content.status_class(F.col("status")) == c), F.col("n")).otherwise(0)).alias(c) for c in ("1xx", "2xx", "3xx", "4xx", "5xx", "other")],
    )
    clusters = typed.groupBy(*KEY).agg(
        F.sum("n").alias("count"),
        F.sum("bytes").alias("bytes"),
        F.max("auth").alias("has_auth"),
        *[F.sum(c).alias(c) for c in ("1xx", "2xx", "3xx", "4xx", "5xx", "other")],
        F.min(F.when(F.col("resp_content_type") != "", F.struct((-F.col("n")).alias("rank"), "resp_content_type"))).alias("top"),
    )
    errors = F.col("1xx") + F.col("3xx") + F.col("4xx") + F.col("5xx") + F.col("other")
    profile = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in ("1xx", "2xx", "3xx", "4xx", "5xx", "other")])), ",")
    hint = F.coalesce("top.resp_content_type", F.lit(""))
    out = clusters.select(
        cluster_id().alias("cluster_id"), *KEY, "count", content.endpoint_category(F.col("path_template"), hint).alias("category"), profile.alias("status_profile"),
        F.round(errors / F.col("count"), 6).alias("error_rate"), F.expr("bytes div count").alias("avg_resp_bytes"), "has_auth", hint.alias("content_type_hint"),
    )
    if min_count > 0:
        out = out.where(F.col("count") >= min_count)
    return out.where(F.col("category") == category) if category else out


def endpoint_page(clusters: DataFrame, max_clusters: int = 200, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the largest clusters, ``total_count`` included; ties by key."""
    top = stage(clusters.orderBy(F.desc("count"), *KEY).limit(min(max_clusters, 2000)), "endpoint-page")
    return top.withColumn("total_count", F.lit(top.count()).cast("bigint")).orderBy(F.desc("count"), *KEY).offset(offset).limit(limit)


def cluster_members(entries: DataFrame, scope: Scope | None = None, only: str = "") -> DataFrame:
    """cluster_id, place and entry_id of every member, or of the members of one cluster; the place is by time, then id."""
    kept = scoped_entries(entries, scope).select(cluster_id().alias("cluster_id"), "ts_ms", "entry_id")
    if only:
        kept = kept.where(F.col("cluster_id") == only)
    return places(kept, ["cluster_id"], ["ts_ms", "entry_id"]).select("cluster_id", "place", "entry_id")


def cluster_examples(entries: DataFrame, examples: int = 3) -> DataFrame:
    """Evenly spread members: places 0, step, 2 step ... with step = n div examples; all where there are no more."""
    members = cluster_members(entries)
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    k = min(examples, 10)
    step = F.greatest(F.expr(f"n div {k}"), F.lit(1))
    chosen = members.join(sizes, "cluster_id").where(F.when(F.col("n") <= k, F.lit(True)).otherwise((F.col("place") % step == 0) & (F.expr("place div greatest(n div %d, 1)" % k) < k)))
    return chosen.select("cluster_id", "place", "entry_id")


def _first_members(entries: DataFrame, columns: tuple[str, ...], most: int) -> DataFrame:
    """The first members of each cluster (a description samples these), with ``n_sample``.

    ``row_number() <= most`` is pushed below the shuffle, so a cluster that
    holds most entries sends only ``most`` rows per task.
    """
    kept = entries_meta(entries, sorted({*KEY, "ts_ms", *columns})).withColumn("cluster_id", cluster_id())
    w = Window.partitionBy("cluster_id").orderBy("ts_ms", "entry_id")
    first = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return first.withColumn("n_sample", F.count(F.lit(1)).over(Window.partitionBy("cluster_id")))


def header_frequency(entries: DataFrame, sample: int = 5, top: int = 20) -> DataFrame:
    """The most frequent request headers among the first members of each cluster; ties by first appearance."""
    first = _first_members(entries, ("request_pairs",), sample)
    seen = first.select("cluster_id", "n_sample", "place", F.posexplode(F.array_distinct(F.transform("request_pairs", lambda h: h["name"]))).alias("pos", "name"))
    counted = seen.groupBy("cluster_id", "n_sample", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "pos")).alias("first"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("cluster_id", "rank", "name", F.round(F.col("n") / F.col("n_sample"), 6).alias("frequency"))


def auth_signals(entries: DataFrame, sample: int = 5) -> DataFrame:
    """Whether the first members of a cluster carry cookies, bearer tokens or API-key headers."""
    first = _first_members(entries, ("request_pairs", "api_keys"), sample)
    has = lambda test: F.exists("request_pairs", test)
    flat = first.select(
        "cluster_id",
        has(lambda h: h["name"] == "cookie").alias("cookie"),
        has(lambda h: (h["name"] == "authorization") & F.lower(h["value"]).startswith("bearer ")).alias("bearer"),
        F.transform("api_keys", lambda k: k["name"]).alias("keys"),
    )
    return flat.groupBy("cluster_id").agg(
        F.max("cookie").alias("cookies_present"),
        F.max("bearer").alias("bearer_present"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))), ",").alias("custom_auth_headers"),
    )


# Beginnings of query keys whose values change with every request.
VOLATILE_KEYS = ("timestamp", "ts", "t", "time", "nonce", "rand", "random", "_")


def query_keys(entries: DataFrame, sample: int = 5) -> DataFrame:
    """Query keys of a cluster's first members, marked stable or volatile; others are left out."""
    first = _first_members(entries, ("url",), sample)
    asked = first.select("cluster_id", "n_sample", "entry_id", F.explode(text.query_pairs(F.col("url"))).alias("p")).select("cluster_id", "n_sample", "entry_id", "p.*")
    counted = asked.groupBy("cluster_id", "n_sample", "key").agg(F.countDistinct("entry_id").alias("n"), F.countDistinct("value").alias("values"))
    low = F.lower("key")
    volatile = F.lit(False)
    for v in VOLATILE_KEYS:
        volatile = volatile | low.startswith(v)
    volatile = volatile | (F.col("values") / F.col("n") > 0.8)
    mark = F.when(volatile, "volatile").when(F.col("n") / F.col("n_sample") >= 0.5, "stable")
    return counted.select("cluster_id", F.col("key").alias("query_key"), mark.alias("mark")).where("mark is not null")


def path_templates(entries: DataFrame) -> DataFrame:
    """Entries per path template."""
    return entries_meta(entries, ("path_template",)).groupBy("path_template").agg(F.count(F.lit(1)).alias("n"))


def status_classes(entries: DataFrame) -> DataFrame:
    """Entries per class of status; entries without a status have none."""
    return entries_meta(entries, ("status",)).where("status <> 0").groupBy(content.status_class(F.col("status")).alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


def category_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("category").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("count").alias("n_entries"))


def graphql_endpoints(entries: DataFrame, marked: DataFrame) -> DataFrame:
    """POST clusters that hold GraphQL requests. ``marked``: entry_id of those."""
    kept = entries_meta(entries, KEY).where("method = 'POST'").join(marked.select("entry_id").distinct(), "entry_id", "left_semi")
    return kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).select(cluster_id().alias("cluster_id"), *KEY, "n")


