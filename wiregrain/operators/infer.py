"""Schema inference per endpoint cluster, with statistics per field.

Shapes merge associatively: each task reduces its bodies to one shape per
cluster, and only these are shuffled. Field statistics are counts per
(cluster, path, type, value), combined before the shuffle, so a cluster that
holds most bodies is spread over its values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonkit, outlines
from ..functions.schemas import Shape, type_of
from ..sources.tables import latest_entries, stage
from .catalog import KEY, cluster_id
from .meta import META

_MOST_GROUPS = 2_000


def cluster_bodies(entries: DataFrame, target: str = "response") -> DataFrame:
    """cluster_id, time, entry_id and decoded JSON body of each entry that has one."""
    from ..functions import headers

    kind = headers.first_value(F.col(f"{target}.headers"), "content-type")
    body = F.when(F.contains(F.lower(kind), F.lit("json")), F.expr(f"try_to_binary({target}.body, 'base64')"))
    kept = latest_entries(entries, {**{k: META[k]() for k in KEY}, "ts_ms": META["ts_ms"](), "body": body}).where("body is not null")
    return kept.select(cluster_id().alias("cluster_id"), "ts_ms", "entry_id", "body")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(k, json.dumps(s.dump()), n, lo, hi) for k, (s, n, lo, hi) in held.items()]
        held.clear()
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
            names=["cluster_id", "state", "n", "least", "most"],
        )

    for batch in batches:
        for cluster, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                shape = Shape.of(jsonkit.parse_bytes(raw))
                mark = xxhash.xxh64_intdigest(json.dumps(shape.schema(required=False))) >> 1
                json.dumps(shape.dump())
            except (ValueError, RecursionError):  # a schema so deep cannot be written down
                continue
            if cluster in held:
                entry = held[cluster]
                entry[0].merge(shape)
                entry[1:] = [entry[1] + 1, min(entry[2], mark), max(entry[3], mark)]
            else:
                held[cluster] = [shape, 1, mark, mark]
        if len(held) >= _MOST_GROUPS:
            yield flush()
    if held:
        yield flush()


def _whole(table: pa.Table) -> pa.Table:
    shape, rows = Shape(), table.to_pylist()
    for r in rows:
        shape.merge(Shape.load(json.loads(r["state"])))
    same = min(r["least"] for r in rows) == max(r["most"] for r in rows)
    return pa.table(
        {
            "cluster_id": pa.array([rows[0]["cluster_id"]], pa.string()),
            "schema": pa.array([json.dumps(shape.schema(), ensure_ascii=True)], pa.string()),
            "sample_count": pa.array([sum(r["n"] for r in rows)], pa.int64()),
            "all_match": pa.array([same], pa.bool_()),
        }
    )


def json_schemas(entries: DataFrame, target: str = "response") -> DataFrame:
    """JSON Schema of all JSON bodies of each cluster: cluster_id, schema, sample_count, all_match."""
    parts = cluster_bodies(entries, target).select("cluster_id", "body").mapInArrow(_partial, "cluster_id string, state string, n bigint, least bigint, most bigint")
    return parts.groupBy("cluster_id").applyInArrow(_whole, "cluster_id string, schema string, sample_count bigint, all_match boolean")


# paths hold these between members and behind arrays, so names with dots or brackets stay names
_STEP, _ITEM = "\x1f", "\x1e"
_NODE = "cluster_id string, path string, type string, value string, first string, n bigint"


def _typed_nodes(root: object) -> Iterator[tuple[str, str, str | None]]:
    """Path, type and value of every node: scalars as text, containers as a digest that tells them apart.

    Digests are made from those of the children, from the last node to the
    first, so a document costs as much as it is long, however deep it is.
    """
    nodes: list[tuple[str, object, str, int, str]] = []  # path, value, type, parent, name
    stack: list[tuple[str, object, int, str]] = [("", root, -1, "")]
    while stack:
        path, v, parent, name = stack.pop()
        t = type_of(v)
        at = len(nodes)
        nodes.append((path, v, t, parent, name))
        if t == "object":
            stack += [(f"{path}{_STEP}{k}", x, at, k) for k, x in v.items()]
        elif t == "array" and path:
            stack += [(path + _ITEM, x, at, "") for x in v]
    parts: list[list[tuple[str, str]] | None] = [[] if t in ("object", "array") else None for _, _, t, _, _ in nodes]
    for at in range(len(nodes) - 1, -1, -1):
        path, v, t, parent, name = nodes[at]
        inside = parts[at]
        if inside is None:
            text = None if t == "null" else jsonkit.canonical(v)
        elif not path:
            text = ""
        else:
            if t == "object":
                inside.sort()
            text = f"#{xxhash.xxh64_hexdigest((t + repr(inside)).encode('utf-8', 'surrogatepass'))}"
            parts[at] = None
        if parent >= 0:
            parts[parent].append((name, text or t))
        yield path, t, text


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (cluster, path, type, value) per batch; elements of arrays have the path of the array and ``_ITEM``."""
    for batch in batches:
        held: dict[tuple, list] = {}
        for cluster, ts, entry, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            try:
                root = jsonkit.parse_bytes(raw)
            except ValueError:
                continue
            order = f"{ts:020d}{entry}"
            for path, t, text in _typed_nodes(root):
                key = (cluster, path, t, text)
                if key in held:
                    held[key][1] += 1
                    held[key][0] = min(held[key][0], order)
                else:
                    held[key] = [order, 1]
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if k[i] is None else jsonkit.clean(k[i]) for k in keys], pa.string()) for i in range(4)]
            + [pa.array([held[k][0] for k in keys], pa.string()), pa.array([held[k][1] for k in keys], pa.int64())],
            names=["cluster_id", "path", "type", "value", "first", "n"],
        )


def field_stats(entries: DataFrame, target: str = "response", examples: int = 3) -> DataFrame:
    """Statistics per cluster and field path.

    ``frequency`` is the share of parent objects that have the field;
    ``required`` fields are in all of them and never null. Fields below mixed
    types (null included) are left out, as are those below an array whose
    elements are not all objects.
    """
    nodes = stage(
        cluster_bodies(entries, target).mapInArrow(_nodes, _NODE).groupBy("cluster_id", "path", "type", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first")),
        "field-nodes",
    )
    per = nodes.groupBy("cluster_id", "path").agg(
        F.sum("n").alias("present"),
        F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_count"),
        F.array_sort(F.collect_set("type")).alias("types"),
        F.sum(F.when(F.col("type") == "string", F.col("n")).otherwise(0)).alias("texts"),
        *[F.min(F.when(F.col("type") == "string", F.rlike(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"), F.lit(p)))).alias(f"is_{name}") for name, p in _java_formats()],
    )
    parent = F.regexp_extract("path", rf"^(?s)(.*){_STEP}[^{_STEP}]*\z", 1)
    fields = per.where(~F.col("path").endswith(_ITEM) & (F.col("path") != "")).withColumn("parent", parent)
    whole = per.where(F.size("types") == 1).select("cluster_id", F.col("path").alias("parent"), F.col("types")[0].alias("parent_type"), F.col("present").alias("parents"))
    fields = fields.join(whole, ["cluster_id", "parent"]).where("parent_type = 'object'")
    # every ancestor must be of one type
    mixed = per.where(F.size("types") > 1).select("cluster_id", F.col("path").alias("above"))
    cuts = F.filter(F.sequence(F.lit(1), F.length("parent")), lambda i: F.substring(F.concat(F.col("parent"), F.lit(_STEP)), i + 1, F.lit(1)).isin(_STEP, _ITEM))
    ancestors = F.explode(F.when(F.length("parent") > 0, F.concat(F.array(F.lit("")), F.transform(cuts, lambda i: F.substring(F.col("parent"), F.lit(1), i)), F.array("parent"))).otherwise(F.array(F.lit(""))))
    below = fields.select("cluster_id", "path", ancestors.alias("above")).join(mixed, ["cluster_id", "above"], "left_semi").select("cluster_id", "path").distinct()
    fields = fields.join(below, ["cluster_id", "path"], "left_anti")
    seen = nodes.where("type not in ('object', 'array', 'null')")
    w = Window.partitionBy("cluster_id", "path")
    shown = seen.withColumn("r", F.row_number().over(w.orderBy("first", "value"))).where(F.col("r") <= examples).groupBy("cluster_id", "path").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"])).alias("examples"))
    few = (
        nodes.where("type = 'string'").withColumn("r", F.row_number().over(w.orderBy("value"))).where(F.col("r") <= outlines.MAX_ENUM + 1)
        .groupBy("cluster_id", "path").agg(F.count(F.lit(1)).alias("n_few"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("few"))
    )
    joined = fields.join(shown, ["cluster_id", "path"], "left").join(few, ["cluster_id", "path"], "left")
    only_text = (F.size("types") == 1) & (F.col("types")[0] == "string") & (F.col("texts") >= outlines.MIN_SAMPLES)
    kind = F.lit(None).cast("string")
    for name, _ in reversed(outlines.FORMATS):
        kind = F.when(F.col(f"is_{name}"), name).otherwise(F.when(kind.isNotNull(), kind).otherwise(F.when(F.col("n_few") <= outlines.MAX_ENUM, "enum"))) if name == outlines.FORMATS[-1][0] else F.when(F.col(f"is_{name}"), name).otherwise(kind)
    shown_path = F.replace(F.replace(F.substr("path", F.lit(2)), F.lit(_ITEM), F.lit("[]")), F.lit(_STEP), F.lit("."))
    return joined.select(
        "cluster_id", shown_path.alias("path"), F.array_join("types", "|").alias("type"), F.round(F.col("present") / F.col("parents"), 6).alias("frequency"),
        ((F.col("present") == F.col("parents")) & (F.col("nulls") == 0)).alias("required"), (F.col("nulls") > 0).alias("nullable"), "distinct_count",
        F.coalesce("examples", F.lit("[]")).alias("examples"), F.coalesce(F.when(only_text, kind), F.lit("")).alias("format"),
        F.when(only_text & (kind == "enum"), F.col("few")).otherwise("").alias("enum_values"),
    )


def _java_formats() -> list[tuple[str, str]]:
    return [(n, p.replace(r"\Z", r"\z")) for n, p in outlines.FORMATS]
