"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

An item has three demands: tokens, segments (1) and loss-bearing tokens. A
container has a limit on each. Containers are filled one after the other: of
all items that still fit, the one whose demands have the greatest dot product
with the free room goes in, until none fits. Items with equal demands are one
type, so a choice costs as much as there are types, not items.

Items are dealt into shards of bounded size by a hash of their key and each
shard is packed by one task. What a shard leaves in badly filled containers is
dealt out and packed again, so shards cost almost nothing. Pieces of
exactly the capacity are containers of their own and are not shuffled.

Defined results: null and empty texts are left out, and so are rows without an
id; rows with the same id are one item, of the longest text; a text longer
than the capacity is cut into full pieces and one rest; ties between types go
to the larger one, within a type to the smaller id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage

SHARD_ITEMS = 20_000
_ITEM = "container_kind string, doc_id bigint, piece_no int, n_pieces int, tokens bigint, loss bigint, most_tokens bigint, most_segments bigint, most_loss bigint"
_PACKED = _ITEM + ", bin string, fill double"


def byte_tokens(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer without special tokens: one per UTF-8 byte."""
    return F.octet_length(text).cast("bigint")


def fill_containers(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Container number per item. Every item must fit into an empty container.

    The plain dot product prefers large items; where several limits bind at
    once that leaves small ones that use up segments. So where it needs over
    2 % more containers than the sums allow, the dot product is also taken
    with the direction of the demands alone, and the better filling is kept.
    """
    plain = _filled(tokens, loss, limits, False)
    if not len(tokens):
        return plain
    least = max(math.ceil(total / limit) for total, limit in zip((tokens.sum(), len(tokens), loss.sum()), limits, strict=True))
    if plain.max() + 1 <= 1.02 * least + 1:
        return plain
    even = _filled(tokens, loss, limits, True)
    return min(plain, even, key=lambda bins: bins.max())


def _filled(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], even: bool) -> np.ndarray:
    """One filling; ``even``: only the direction of an item's demands counts, not their size."""
    n = len(tokens)
    out = np.full(n, -1, dtype=np.int64)
    if not n:
        return out
    order = np.lexsort((-loss, -tokens))
    types, first, counts = np.unique(np.stack([-tokens[order], -loss[order]], axis=1), axis=0, return_index=True, return_counts=True)
    need = np.stack([-types[:, 0], np.ones(len(types), dtype=np.int64), -types[:, 1]], axis=1).astype(np.float64)
    limit = np.asarray(limits, dtype=np.float64)
    share = need / limit
    worth = share / np.linalg.norm(share, axis=1)[:, None] if even else share
    left, nxt = counts.astype(np.int64).copy(), first.copy()
    alive = np.arange(len(types))
    bin_no, remaining = -1, n
    while remaining:
        bin_no += 1
        room = limit.copy()
        candidates = alive
        while len(candidates):
            candidates = candidates[(need[candidates] <= room).all(axis=1) & (left[candidates] > 0)]
            if not len(candidates):
                break
            best = candidates[int(np.argmax(worth[candidates] @ (room / limit)))]
            # several of the same type may follow each other as long as it stays the best fit
            out[order[nxt[best]]] = bin_no
            nxt[best] += 1
            left[best] -= 1
            remaining -= 1
            room -= need[best]
        if bin_no % 64 == 0:
            alive = alive[left[alive] > 0]
    return out


def pieces(items: DataFrame, kinds: list[tuple[str, int, int, int]]) -> DataFrame:
    """One row per item and container kind, cut into the fewest pieces: full ones and one rest.

    ``items``: doc_id, tokens, loss. ``kinds``: name, and limits on tokens,
    segments and loss-bearing tokens. A piece bears loss in proportion to its
    share of the tokens (rounded up), at most the limit.
    """
    if not kinds:
        return items.sparkSession.createDataFrame([], _ITEM)
    table = F.array(*[F.struct(F.lit(k).alias("container_kind"), *[F.lit(v).cast("bigint").alias(c) for c, v in zip(("most_tokens", "most_segments", "most_loss"), limits, strict=True)]) for k, *limits in kinds])
    each = items.select("doc_id", "tokens", "loss", F.explode(table).alias("k")).select("doc_id", "tokens", "loss", "k.*")
    # as many tokens as keep both limits
    dense = F.greatest(F.lit(1), F.expr("least(most_tokens, cast(floor(most_loss * tokens / greatest(loss, 1)) as bigint))")).cast("bigint")
    each = each.withColumn("cap", dense).withColumn("n_pieces", F.expr("cast(ceil(tokens / cap) as int)"))
    cut = each.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"))
    size = F.least(F.col("cap"), F.col("tokens") - F.col("piece_no") * F.col("cap"))
    return cut.select(
        "container_kind", "doc_id", "piece_no", "n_pieces", size.alias("tokens"),
        F.expr("least(most_loss, cast(ceil(loss * (least(cap, tokens - piece_no * cap)) / tokens) as bigint))").alias("loss"),
        "most_tokens", "most_segments", "most_loss",
    )


def _pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
    limits = tuple(int(pdf[c].iloc[0]) for c in ("most_tokens", "most_segments", "most_loss"))
    tokens, loss = pdf["tokens"].to_numpy(np.int64), pdf["loss"].to_numpy(np.int64)
    bins = fill_containers(tokens, loss, limits)
    held = np.bincount(bins, weights=tokens)
    held_loss = np.bincount(bins, weights=loss)
    n = np.bincount(bins)
    fill = np.maximum.reduce([held / limits[0], held_loss / limits[2], n / limits[1]])
    label = f"{key[1]}-"
    pdf["bin"] = [label + str(b) for b in bins]
    pdf["fill"] = fill[bins]
    return pdf.drop(columns=["shard"])


def _dealt(rows: DataFrame, salt: str, shard_items: int) -> tuple[DataFrame, int, int]:
    """``rows`` with a shard, as many per kind as keep shards near ``shard_items``; the most shards of a kind, and the rows."""
    sizes = {r["container_kind"]: r["n"] for r in rows.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {k: max(1, math.ceil(n / shard_items)) for k, n in sizes.items()}
    shards = F.lit(1)
    for kind, n in counts.items():
        shards = F.when(F.col("container_kind") == kind, F.lit(n)).otherwise(shards)
    spark = rows.sparkSession
    # a shard is much work for few bytes, so tasks are counted here and not merged by size
    tasks = min(max(1, sum(counts.values())), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    dealt = rows.withColumn("shard", F.concat(F.lit(salt), F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(salt)), shards).cast("string")))
    return dealt.repartition(tasks, "container_kind", "shard"), max(counts.values(), default=1), sum(sizes.values())


def pack(cut: DataFrame, shard_items: int = SHARD_ITEMS, well_filled: float = 0.98) -> DataFrame:
    """Containers of the pieces ``cut``: container_kind, container_id, doc_id, piece_no, n_pieces, tokens, loss.

    What lies in containers filled below ``well_filled`` is dealt and packed
    again, until one shard holds it all, or a round has left more than half of
    what it was dealt: then the items themselves do not fill containers.
    """
    whole = cut.where("tokens = most_tokens").select("*", F.concat_ws("-", F.lit("f"), "doc_id", "piece_no").alias("bin"), F.lit(1.0).alias("fill"))
    done, left = whole, cut.where("tokens < most_tokens")
    before: int | None = None
    for step in itertools.count():
        dealt, shards, n = _dealt(left, f"r{step}-", shard_items)
        packed = stage(dealt.groupBy("container_kind", "shard").applyInPandas(_pack_shard, _PACKED), "packed")
        if shards == 1 or (before is not None and 2 * n > before):
            done = done.unionByName(packed)
            break
        before = n
        done = done.unionByName(packed.where(F.col("fill") >= well_filled))
        left = packed.where(F.col("fill") < well_filled).drop("bin", "fill")
    return done.select("container_kind", F.col("bin").alias("container_id"), "doc_id", "piece_no", "n_pieces", "tokens", "loss")


def _kinds(container_kinds: DataFrame, segments: int | None = None, loss_share: float = 1.0, most: int = 1000) -> list[tuple[str, int, int, int]]:
    """The kinds as literals. Their number is a property of the job, not of the data; more than ``most`` is an error."""
    rows = container_kinds.where("container_kind is not null and capacity_tokens > 0").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of containers")
    return sorted((r["container_kind"], r["capacity_tokens"], segments or r["capacity_tokens"], max(1, int(r["capacity_tokens"] * loss_share))) for r in rows)


def document_items(documents: DataFrame, loss: Column | None = None) -> DataFrame:
    """doc_id, tokens and loss-bearing tokens of each document with text."""
    size = byte_tokens(F.col("text"))
    sized = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("tokens"), (size if loss is None else loss.cast("bigint")).alias("loss"))
    return sized.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.max(F.struct("tokens", "loss")).alias("s")).select("doc_id", "s.*")


def document_packing(documents: DataFrame, container_kinds: DataFrame) -> DataFrame:
    """The documents in containers of each kind."""
    return pack(stage(pieces(document_items(documents), _kinds(container_kinds)), "pieces"))


def instruction_packing(documents: DataFrame, container_kinds: DataFrame, segments: int = 12, loss_share: float = 0.875) -> DataFrame:
    """The documents as training examples: limits on tokens, on segments, and on loss-bearing tokens (bytes that are not white space)."""
    loss = F.octet_length(F.regexp_replace("text", r"\s+", ""))
    items = document_items(documents, loss).withColumn("loss", F.greatest("loss", F.lit(0)))
    return pack(stage(pieces(items, _kinds(container_kinds, segments, loss_share)), "pieces"))


def cut_pieces(documents: DataFrame, container_kinds: DataFrame) -> DataFrame:
    """The pieces of texts that alone exceed the capacity, as they lie in the containers."""
    return document_packing(documents, container_kinds).where("n_pieces > 1").select("container_kind", "doc_id", "piece_no")


def packing_summary(documents: DataFrame, container_kinds: DataFrame) -> DataFrame:
    """Containers used per kind, against the least number that could hold the tokens."""
    packed = document_packing(documents, container_kinds)
    sizes = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"))
    return sizes.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.sum("segments").alias("n_pieces"), F.max("tokens").alias("fullest"))


def _invariants(packed: DataFrame, items: DataFrame, kinds: list[tuple[str, int, int, int]], slack: float) -> DataFrame:
    """What holds of every right packing, per kind: items and tokens in it, containers over a limit, items not whole, and whether the containers are few.

    Few: at most ``slack`` times the least number that the sums of tokens,
    segments and loss-bearing tokens allow, and one more.
    """
    limit = {k: F.create_map(*[F.lit(x) for kind in kinds for x in (kind[0], kind[i])]) for i, k in ((1, "tokens"), (2, "segments"), (3, "loss"))}
    kind = F.col("container_kind")
    bins = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss").alias("loss"))
    over = F.lit(False)
    for name, m in limit.items():
        over = over | (F.col(name) > m[kind])
    sums = bins.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_containers"), F.count_if(over).alias("n_overfull"), *[F.sum(name).alias(name) for name in limit]
    )
    docs = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("n_pieces"), F.countDistinct("piece_no").alias("n_numbers"))
    met = docs.join(items.select("doc_id", F.col("tokens").alias("size")), "doc_id", "left")
    broken = ~F.col("size").eqNullSafe(F.col("tokens")) | (F.col("n") != F.col("n_pieces")) | (F.col("n_numbers") != F.col("n"))
    whole = met.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(broken).alias("n_broken"))
    least = F.greatest(*[F.ceil(F.col(name) / m[kind]) for name, m in limit.items()])
    return sums.join(whole, "container_kind").select(
        "container_kind", "n_docs", F.col("tokens").alias("n_tokens"), F.col("segments").alias("n_pieces"), "n_overfull", "n_broken", (F.col("n_containers") <= least * slack + 1).alias("few")
    )


def packing_invariants(documents: DataFrame, container_kinds: DataFrame, slack: float = 1.01) -> DataFrame:
    """Invariants of ``document_packing``: at most one container in a hundred more than the tokens need."""
    items, kinds = document_items(documents), _kinds(container_kinds)
    return _invariants(stage(document_packing(documents, container_kinds), "packing"), items, kinds, slack)


def instruction_invariants(documents: DataFrame, container_kinds: DataFrame, slack: float = 1.15) -> DataFrame:
    """Invariants of ``instruction_packing`` under its three limits."""
    items, kinds = document_items(documents), _kinds(container_kinds, 12, 0.875)
    return _invariants(stage(instruction_packing(documents, container_kinds), "packing"), items, kinds, slack)
