"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are aggregated by the join key before they meet, so a
key that holds a third of all rows is one compact state per task when it is
shuffled and one row when it is joined. Sums and counts of the joined rows
follow from the states: a count is the product of both counts, a sum is one
side's sum times the other side's count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.tables import latest_entries


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    rollup: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """count and sums of ``left join right using (keys)`` grouped by ``rollup`` (default: the keys), without forming the joined rows.

    Gives ``n_joined`` and a column per summed name. Null keys join nothing,
    as in SQL; with ``how='left'`` a left key without partner counts its own
    rows once. ``rollup`` names keys or further columns of the left input,
    by which its states are kept apart.
    """
    keys, rollup = list(keys), list(rollup if rollup is not None else keys)
    known = [F.col(k).isNotNull() for k in keys]
    a = left.groupBy(*dict.fromkeys([*keys, *rollup])).agg(F.count(F.lit(1)).alias("_na"), *[F.sum(c).alias(f"_a_{c}") for c in left_sums])
    b = right
    for test in known:
        b = b.where(test)
    b = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"), *[F.sum(c).alias(f"_b_{c}") for c in right_sums])
    states = a.join(b, keys, how)
    times = F.coalesce(F.col("_nb"), F.lit(1))
    return states.groupBy(*rollup).agg(
        F.sum(F.col("_na") * times).alias("n_joined"),
        *[F.sum(F.col(f"_a_{c}") * times).alias(c) for c in left_sums],
        *[F.sum(F.col(f"_b_{c}") * F.col("_na")).alias(c) for c in right_sums],
    )


def entry_counts(entries: DataFrame) -> DataFrame:
    """True number of entries per session, host, method and path template.

    Copies of an entry are combined on the map side, then each task counts its
    entries per endpoint before the counts are shuffled.
    """
    url = F.col("url")
    keys = {
        "session_id": F.col("session_id"),
        "host": urls.url_host(url),
        "method": F.col("request.method"),
        "path_template": urls.path_template(urls.url_path(url)),
    }
    return latest_entries(entries, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entries"))


def _tidy_host() -> Column:
    return F.lower(F.trim(F.col("host")))


def cluster_states(clusters: DataFrame) -> DataFrame:
    """Clusters with their copies combined: least and greatest stated count per cluster."""
    return clusters.groupBy(
        "cluster_id", "session_id", _tidy_host().alias("host"), "method", "path_template"
    ).agg(F.min("count").alias("least"), F.max("count").alias("most"), F.count(F.lit(1)).alias("n_copies"))


def cluster_entry_counts(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster its true entry count beside the stated ones; clusters without entries count 0."""
    counts = entry_counts(entries)
    return cluster_states(clusters).join(counts, ["session_id", "host", "method", "path_template"], "left").select(
        "cluster_id", "session_id", "host", "method", "path_template", "least", "most", F.coalesce("n_entries", F.lit(0)).alias("n_entries")
    )


def wrong_counts(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters with a non-null count that is not the number of their entries.

    A copy with null says nothing; copies that disagree with each other are
    wrong in at least one row, so the cluster is listed.
    """
    known = cluster_entry_counts(entries, clusters)
    return known.where("cluster_id is not null and (least <> n_entries or most <> n_entries)").select("cluster_id").distinct()


def host_header_sums(clusters: DataFrame, header_frequencies: DataFrame) -> DataFrame:
    """Per host the header rows of its clusters and the sum of their frequencies, copies of either included.

    A hot host has most clusters and so most joined rows; neither side sends
    more than a state per cluster (and host).
    """
    left = clusters.select("cluster_id", _tidy_host().alias("host"))
    found = eager_join_aggregate(left, header_frequencies.select("cluster_id", "frequency"), ["cluster_id"], right_sums=["frequency"], rollup=["host"])
    return found.select("host", F.col("n_joined").alias("n_rows"), F.round("frequency", 3).alias("frequency"))


def host_entry_counts(entries: DataFrame) -> DataFrame:
    """Entries, sessions and endpoints per host, rolled up from the endpoint states."""
    return (
        entry_counts(entries)
        .groupBy("host")
        .agg(
            F.sum("n_entries").alias("n_entries"),
            F.countDistinct("session_id").alias("n_sessions"),
            F.count(F.lit(1)).alias("n_endpoints"),
        )
    )
