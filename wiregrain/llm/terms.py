"""Frequency of every distinct term: occurrences and records, by burst-trie counting.

A burst trie routes a term by its first characters to a container of suffixes;
a container that grows beyond ``burst`` entries becomes an inner node with one
container per next character, so prefixes are as long as the data require.
Each task counts into tries of its own, in which a term is one entry however
often it occurs, and emits their containers. The prefixes that hold many terms
in all tries together are the routes; containers are cut at the routes,
shuffled by route, and matching subtrees are merged. Where a route keeps many
terms that no longer route takes (vocabularies of many scripts have no common
prefixes), its terms are dealt into buckets by a hash of their suffix, so no
group grows with the vocabulary.

Defined results: null and empty terms are no terms; outer white space never
counts; a record with the same term in several rows counts once as a record
and each time as an occurrence; a null record adds occurrences only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage

_CONTAINER = "field string, prefix string, bucket int, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_TERM = "field string, term string, occurrences bigint, records bigint"


@dataclass
class BurstTrie:
    """Counts per term. Inner nodes are dicts by character, containers dicts by suffix."""

    burst: int = 512
    size: int = 0
    nodes: dict[str, dict] = field(default_factory=dict)
    containers: dict[str, dict[str, list[int]]] = field(default_factory=lambda: {"": {}})

    def _home(self, term: str) -> str:
        """The prefix of the container a term belongs to."""
        end = 0
        while term[:end] in self.nodes:
            if end == len(term):
                break
            end += 1
        return term[:end]

    def add(self, term: str, occurrences: int, records: int) -> None:
        home = self._home(term)
        if home in self.nodes:  # the term ends at an inner node
            box, suffix = self.nodes[home], ""
        else:
            box, suffix = self.containers.setdefault(home, {}), term[len(home) :]
        entry = box.get(suffix)
        if entry is None:
            box[suffix] = [occurrences, records]
            self.size += 1
            if len(box) > self.burst and home not in self.nodes:
                self._split(home)
        else:
            entry[0] += occurrences
            entry[1] += records

    def _split(self, prefix: str) -> None:
        box = self.containers.pop(prefix)
        self.nodes[prefix] = {"": box.pop("")} if "" in box else {}
        for suffix, entry in box.items():
            self.containers.setdefault(prefix + suffix[0], {})[suffix[1:]] = entry

    def subtrees(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """Prefix and entries of every container and of terms that end at inner nodes."""
        for prefix, box in self.containers.items():
            if box:
                yield prefix, box
        for prefix, box in self.nodes.items():
            if box:
                yield prefix, box


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64()))],
        names=["field", "prefix", "bucket", "suffixes", "occurrences", "records"],
    )


def _emit(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for name, trie in tries.items():
        for prefix, box in trie.subtrees():
            rows.append((name, prefix, 0, list(box), [e[0] for e in box.values()], [e[1] for e in box.values()]))
            held += len(box)
            if held > 50_000:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _accumulate(burst: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}
        for batch in batches:
            for name, term, occurrences, records in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                trie = tries.get(name)
                if trie is None:
                    trie = tries[name] = BurstTrie(burst)
                trie.add(term, occurrences, records)
            if sum(t.size for t in tries.values()) > most:  # memory is bounded; the merge adds the parts up
                yield from _emit(tries)
                tries = {}
        yield from _emit(tries)

    return run


def _reroute(routes: dict[tuple[str, str], int], depth: int):
    """Cut containers so that each lies below one route, and in one of its buckets.

    The route of a term is the longest one that is a prefix of it; ``routes``
    gives the buckets of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, prefix, _, suffixes, occurrences, records in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts: dict[tuple[str, int], tuple[list, list, list]] = {}
                for suffix, o, r in zip(suffixes, occurrences, records, strict=True):
                    term = prefix + suffix
                    route = next((term[:n] for n in range(min(depth, len(term)), 0, -1) if (name, term[:n]) in routes), "")
                    rest = term[len(route) :]
                    buckets = routes.get((name, route), 1)
                    part = parts.setdefault((route, xxhash.xxh64_intdigest(rest.encode("utf-8", "surrogatepass")) % buckets if buckets > 1 else 0), ([], [], []))
                    part[0].append(rest)
                    part[1].append(o)
                    part[2].append(r)
                rows.extend((name, route, bucket, *part) for (route, bucket), part in parts.items())
            if rows:
                yield _batch(rows)

    return run


def buckets_of(sizes: dict[tuple[str, str], int], share: float) -> dict[tuple[str, str], int]:
    """Buckets per route: what it keeps for itself, less the routes right below it, in parts of ``share`` entries."""
    kept = dict(sizes)
    for (name, route), n in sizes.items():
        if route:
            above = next((route[:k] for k in range(len(route) - 1, -1, -1) if (name, route[:k]) in sizes), None)
            if above is not None:
                kept[name, above] -= n
    return {k: max(1, math.ceil(n / share)) for k, n in kept.items()}


def _merge(burst: int):
    def run(table: pa.Table) -> pa.Table:
        trie = BurstTrie(burst)
        name, route = table.column(0)[0].as_py(), table.column(1)[0].as_py()
        for batch in table.to_batches():
            for suffixes, occurrences, records in zip(*[batch.column(i).to_pylist() for i in (3, 4, 5)], strict=True):
                for suffix, o, r in zip(suffixes, occurrences, records, strict=True):
                    trie.add(suffix, o, r)
        terms, occ, rec = [], [], []
        for prefix, box in trie.subtrees():
            for suffix, (o, r) in box.items():
                terms.append(route + prefix + suffix)
                occ.append(o)
                rec.append(r)
        return pa.table({"field": pa.array([name] * len(terms), pa.string()), "term": pa.array(terms, pa.string()), "occurrences": pa.array(occ, pa.int64()), "records": pa.array(rec, pa.int64())})

    return run


def term_counts(rows: DataFrame, burst: int = 512, most: int = 200_000) -> DataFrame:
    """Occurrences and records of every term of ``rows`` (field, term, record).

    ``most`` bounds the terms a task holds at once. The routes are the
    prefixes below which at least one part in four per shuffle partition of
    all counted entries lie, so their number and that of all buckets are
    bounded by the number of partitions and the length of shared prefixes,
    not by the data; a group holds about such a part.
    """
    spark = rows.sparkSession
    tidy = rows.select("field", F.trim(F.col("term")).alias("term"), F.col("record").cast("string").alias("record")).where("term <> ''")
    once = tidy.groupBy("field", "term", "record").agg(F.count(F.lit(1)).alias("occurrences")).select(
        "field", "term", "occurrences", F.when(F.col("record").isNotNull(), 1).otherwise(0).cast("bigint").alias("records")
    )
    containers = stage(once.mapInArrow(_accumulate(burst, most), _CONTAINER), "term-containers")
    sizes = containers.select("field", "prefix", F.size("suffixes").alias("n"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n)))
    per = sizes.select("field", ahead.alias("route"), "n").groupBy("field", "route").agg(F.sum("n").alias("n"))
    per = stage(per, "term-prefixes")
    total = per.where("route = ''").agg(F.sum("n")).first()[0] or 0
    share = max(total / parts, 1.0)
    found = {(r["field"], r["route"]): r["n"] for r in per.where((F.col("n") >= share) | (F.col("route") == "")).collect()}
    table = buckets_of(found, share)
    depth = max((len(route) for _, route in table), default=0)
    routed = containers.mapInArrow(_reroute(table, depth), _CONTAINER)
    return routed.groupBy("field", "prefix", "bucket").applyInArrow(_merge(burst), _TERM)


def marked_terms(counts: DataFrame, totals: dict[str, int], rare: int = 2, common: float = 0.04) -> DataFrame:
    """``counts`` with ``mark``: rare in at most ``rare`` records, else common in at least the share ``common`` of all."""
    most = F.lit(None).cast("double")
    for name, n in totals.items():
        most = F.when(F.col("field") == name, F.lit(float(n))).otherwise(most)
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") >= most * common, "common").otherwise("useful"))


def _field(df: DataFrame, name: str, term: Column) -> DataFrame:
    return df.select(F.lit(name).alias("field"), term.alias("term"), F.col("cluster_id").alias("record"))


def capture_terms(header_frequencies: DataFrame, clusters: DataFrame) -> DataFrame:
    """Counts and marks of header names, hosts and path templates."""
    rows = (
        _field(header_frequencies, "header_name", F.lower(F.trim("name")))
        .unionByName(_field(clusters, "host", F.lower(F.trim("host"))))
        .unionByName(_field(clusters, "path_template", F.trim("path_template")))
    )
    n_headers = header_frequencies.agg(F.countDistinct("cluster_id")).first()[0]
    n_clusters = clusters.agg(F.countDistinct("cluster_id")).first()[0]
    return marked_terms(term_counts(rows), {"header_name": n_headers, "host": n_clusters, "path_template": n_clusters})


def found_terms(header_frequencies: DataFrame, clusters: DataFrame) -> DataFrame:
    """The terms too rare or too common to tell clusters apart."""
    return capture_terms(header_frequencies, clusters).where("mark <> 'useful'").select("field", "term", "mark")
