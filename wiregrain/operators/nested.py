"""Deeply nested records into related flat tables.

Each record is parsed once and turned into path-value-ordinal records
(``nested_records``); paths are grouped by their repeated ancestor, the path
with all array places left open (``group_path``); each group is one table
(``pivot_group``) whose rows carry their own pointer and that of the parent.
``group_rows`` gives all groups at once, the members of a row as a list.

Defined results: null, empty and invalid texts give no rows; a root that is a
scalar gives none; of members with one name the last counts; copies of a
record (same id and text) count once; further columns of the input are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonkit
from ..sources.tables import latest_entries, spread

RECORD_SCHEMA = (
    "record_id string, node_path string, parent_path string, group_path string, "
    "ordinals array<int>, kind string, value string"
)
_FLUSH = 20_000


def text_of(value: object) -> str | None:
    if value is None:
        return None
    if value is True:
        return "true"
    if value is False:
        return "false"
    return jsonkit.clean(value) if type(value) is str else repr(value)


def _records(kinds: frozenset[str] | None, binary: bool):
    schema = pa.schema(
        [
            ("record_id", pa.string()),
            ("node_path", pa.string()),
            ("parent_path", pa.string()),
            ("group_path", pa.string()),
            ("ordinals", pa.list_(pa.int32())),
            ("kind", pa.string()),
            ("value", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        for batch in batches:
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                try:
                    root = jsonkit.parse_bytes(raw) if binary else jsonkit.parse_json(raw)
                except ValueError:
                    continue
                for path, owner, group, places, kind, value in jsonkit.walk(root):
                    if kinds is not None and kind not in kinds:
                        continue
                    out[0].append(rid)
                    out[1].append(path if path.isascii() else jsonkit.clean(path))
                    out[2].append(owner if owner.isascii() else jsonkit.clean(owner))
                    out[3].append(group if group.isascii() else jsonkit.clean(group))
                    out[4].append(places)
                    out[5].append(kind)
                    out[6].append(text_of(value))
                if len(out[0]) >= _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out = [[] for _ in schema]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def nested_records(df: DataFrame, record_id: Column, text: Column, kinds: Sequence[str] | None = None) -> DataFrame:
    """Path-value-ordinal records of the JSON documents in ``text`` (string or UTF-8 binary).

    ``kinds`` keeps only nodes of these kinds (object, array, string, number,
    boolean, null); the others are then not sent out of the parser.
    """
    two = df.select(record_id.cast("string").alias("record_id"), text.alias("text")).where("record_id is not null and text is not null")
    binary = dict(two.dtypes)["text"] == "binary"
    return two.mapInArrow(_records(frozenset(kinds) if kinds else None, binary), RECORD_SCHEMA)


def group_tables(records: DataFrame) -> DataFrame:
    """The tables of a set of records: group path, parent's group path, rows, member names and their kinds."""
    objects = records.where("kind = 'object'").groupBy("group_path").agg(F.count(F.lit(1)).alias("n_rows"))
    members = (
        records.where("kind not in ('object', 'array') and node_path <> ''")
        .select(
            F.regexp_extract("group_path", r"^(.*)/[^/]*\z", 1).alias("group_path"),
            F.concat_ws(":", F.regexp_extract("group_path", r"/([^/]*)\z", 1), "kind").alias("member"),
        )
        .distinct()
        .groupBy("group_path")
        .agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members"))
    )
    return objects.join(members, "group_path", "left").select(
        "group_path", F.regexp_replace("group_path", r"(/[^/*]+(/\*)*|(/\*)+)\z", "").alias("parent_group"), "n_rows", "members"
    )


def pivot_group(records: DataFrame, group_path: str, members: Sequence[str]) -> DataFrame:
    """The flat table of one group: a row per object, its scalar ``members`` as columns.

    Names that clash with the key columns get the suffix ``_value``.
    """
    keys = ("record_id", "node_path", "parent_path")
    inside = records.where(
        ((F.col("group_path") == group_path) & (F.col("kind") == "object"))
        | F.col("group_path").isin([f"{group_path}/{jsonkit.pointer_token(m)}" for m in members])
    )
    own = F.col("kind").eqNullSafe("object") & (F.col("group_path") == group_path)
    node = F.when(own, F.col("node_path")).otherwise(F.col("parent_path"))
    columns = [
        F.max(F.when(F.col("group_path") == f"{group_path}/{jsonkit.pointer_token(m)}", F.col("value"))).alias(f"{m}_value" if m in keys else m)
        for m in members
    ]
    return (
        inside.select("record_id", node.alias("node_path"), F.when(own, F.col("parent_path")).alias("parent_path"), "group_path", "value")
        .groupBy("record_id", "node_path")
        .agg(F.max("parent_path").alias("parent_path"), *columns)
        .where("parent_path is not null")
        .select(*keys, *[f"{m}_value" if m in keys else m for m in members])
    )


GROUP_SCHEMA = (
    "record_id string, group_path string, parent_group string, node_path string, parent_path string, "
    "ordinals array<int>, kind string, members array<struct<name:string,kind:string,value:string>>"
)


def _group_rows(binary: bool):
    member = pa.struct([("name", pa.string()), ("kind", pa.string()), ("value", pa.string())])
    types = [pa.string()] * 5 + [pa.list_(pa.int32()), pa.string(), pa.list_(member)]
    names = ["record_id", "group_path", "parent_group", "node_path", "parent_path", "ordinals", "kind", "members"]

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for batch in batches:
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root = jsonkit.parse_bytes(raw) if binary else jsonkit.parse_json(raw)
                except ValueError:
                    continue
                # groups and members by pointer of the object; an object comes before all below it
                objects: dict[str, tuple[str, list]] = {}
                for path, owner, group, places, kind, value in jsonkit.walk(root):
                    item = group.endswith("/*") and not path.endswith("/*")
                    if kind == "object":
                        members: list = []
                    elif item:
                        members = [("*", kind, text_of(value))]
                    else:
                        if path:
                            name = path.rpartition("/")[2].replace("~1", "/").replace("~0", "~")
                            objects[owner][1].append((jsonkit.clean(name), kind, text_of(value)))
                        continue
                    above = objects[owner][0] if path and owner in objects else ""
                    if kind == "object":
                        objects[path] = (group, members)
                    out.append([rid, *map(jsonkit.clean, (group, above, path, owner)), places, kind, members])
                if len(out) >= _FLUSH:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return run


def group_rows(df: DataFrame, record_id: Column, text: Column) -> DataFrame:
    """Every group of the documents in ``text`` pivoted: a row per object with its scalar members.

    The path-value-ordinal records of a document are grouped by their
    repeated ancestor, and each group is pivoted: one row per object, its
    members as columns of that row. ``kind`` is the kind of the row's node.
    Array elements that are not objects are rows of the group of their array,
    with one member ``*``. Arrays are members of kind ``array`` without value.
    """
    two = df.select(record_id.cast("string").alias("record_id"), text.alias("text")).where("record_id is not null and text is not null")
    return two.mapInArrow(_group_rows(dict(two.dtypes)["text"] == "binary"), GROUP_SCHEMA)


def capture_groups(entries: DataFrame, operations: DataFrame, hellos: DataFrame) -> DataFrame:
    """``group_rows`` of response bodies, operation variables and ClientHello extensions, with ``source``.

    Operations and ClientHellos come more than once; their rows are made
    distinct after parsing, so no JSON text is shuffled.
    """
    found = {
        source: group_rows(df, F.col("record_id"), F.col("text")).select(F.lit(source).alias("source"), "*")
        for source, df in capture_sources(entries, operations, hellos).items()
    }
    return found["body"].unionByName(found["variables"].unionByName(found["extensions"]).distinct())


def capture_tables(entries: DataFrame, operations: DataFrame, hellos: DataFrame) -> DataFrame:
    """The tables of all three sources: source, group path, parent's group path, rows, member names and their kinds."""
    key = ["source", "group_path", "parent_group"]
    kinds = F.transform("members", lambda m: F.concat_ws(":", m["name"], m["kind"]))
    shapes = capture_groups(entries, operations, hellos).groupBy(*key, kinds.alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return shapes.groupBy(*key).agg(
        F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("shape")))), ",").alias("members")
    )


def capture_sources(entries: DataFrame, operations: DataFrame, hellos: DataFrame) -> dict[str, DataFrame]:
    """The three nested sources of a capture as (record_id, text); each body once, the others as often as they come."""
    bodies = latest_entries(entries, {"text": F.expr("try_to_binary(response.body, 'base64')")}).select(
        F.col("entry_id").alias("record_id"), "text"
    )
    variables = operations.select(F.col("op_id").alias("record_id"), F.col("variables").alias("text")).where("text is not null")
    extensions = hellos.select(F.col("connection_id").alias("record_id"), F.col("extensions").alias("text")).where("text is not null")
    return {"body": bodies, "variables": spread(variables), "extensions": spread(extensions)}


def capture_records(entries: DataFrame, operations: DataFrame, hellos: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """``nested_records`` of response bodies, operation variables and ClientHello extensions, with ``source``."""
    parts = [
        nested_records(df, F.col("record_id"), F.col("text"), kinds).withColumn("source", F.lit(source))
        for source, df in capture_sources(entries, operations, hellos).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def object_nodes(entries: DataFrame, operations: DataFrame, hellos: DataFrame) -> DataFrame:
    """Every object below a root: source, record_id, node_path, parent_path.

    These are the rows of all group tables, with their keys and the link to
    the parent's row.
    """
    found = {source: group_rows(df, F.col("record_id"), F.col("text")) for source, df in capture_sources(entries, operations, hellos).items()}
    keys = {
        source: rows.where("kind = 'object' and node_path <> ''").select(F.lit(source).alias("source"), "record_id", "node_path", "parent_path")
        for source, rows in found.items()
    }
    return keys["body"].unionByName(keys["variables"].unionByName(keys["extensions"]).distinct())
