"""Schemas that drift between files: tagged-union inference and a change report.

Each JSON body becomes one record: its id, its shape (every field path with
the tag of its type) and a hash per field. Shapes of one cluster and file are
fused; a path keeps all its alternative types as a set of tags (the tagged
union). Neighbouring files are compared path by path. A type conflict stays
visible as typed branches with one canonical conversion (``unified_records``).

Names are matched by value: where one field vanishes and one of the same type
appears in the same parent, the hashes of both are joined over the records of
equal id in both files, and the pair is a rename if all of them agree.

Defined results: bodies that are not JSON objects with an ``id``, or whose
status is not 200, are not usable; null members occur but have no type; equal
ids within one file count once, and if their values differ the field agrees
with nothing; of several fitting names the one with most agreeing records is
taken, then the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonkit, urls
from ..sources.tables import latest_entries, stage

#: type tags, one bit each; the least bit has the least conversion effort
TAGS = {"string": 1, "number": 2, "boolean": 4, "object": 8, "array": 16, "null": 0}
_ITEM, _STEP, _NEXT = "\x1e", "\x1f", "\x1d"
_FLUSH = 8_000_000

RECORD_SCHEMA = "cluster_id string, file_no int, rec_id string, shape string, hashes array<bigint>"


def fields_of(body: dict) -> dict[str, tuple[int, list[str]]]:
    """Tags and canonical values per field path; a path below an array has one value per element that holds it."""
    out: dict[str, tuple[int, list[str]]] = {}
    stack: list[tuple[str, dict]] = [("", body)]
    while stack:
        parent, record = stack.pop()
        for name, value in record.items():
            path = parent + name if not parent else parent + _STEP + name
            tag, seen = out.get(path, (0, []))
            t = jsonkit.kind(value)
            seen.append(value)
            out[path] = (tag | TAGS[t], seen)
            if t == "object":
                stack.append((path, value))
            elif t == "array":
                stack.extend((path + _ITEM, v) for v in reversed(value) if type(v) is dict)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for cluster, file_no, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            try:
                body = jsonkit.parse_bytes(raw)
            except ValueError:
                continue
            if type(body) is not dict or "id" not in body:
                continue
            fields = sorted(fields_of(body).items())
            out[0].append(cluster)
            out[1].append(file_no)
            out[2].append(jsonkit.clean(jsonkit.canonical_text(body["id"])))
            out[3].append(jsonkit.clean(_NEXT.join(f"{tag}{path}" if tag > 9 else f"0{tag}{path}" for path, (tag, _) in fields)))
            out[4].append([jsonkit.value_hash(values) for _, (_, values) in fields])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int64()))],
            names=["cluster_id", "file_no", "rec_id", "shape", "hashes"],
        )


def usable_bodies(entries: DataFrame) -> DataFrame:
    """cluster_id, file_no and decoded body of each entry with status 200; entries of no file are left out."""
    body = F.when(F.col("response.status_code") == 200, F.expr("try_to_binary(response.body, 'base64')"))
    kept = latest_entries(entries, {"cluster_id": F.when(body.isNotNull(), urls.entry_cluster_key()), "file_no": F.col("file_no"), "body": body})
    return kept.where("body is not null and file_no is not null").select("cluster_id", "file_no", "body")


def shape_records(entries: DataFrame) -> DataFrame:
    """One record per usable body: cluster, file, id, shape and a hash per field of the shape."""
    return usable_bodies(entries).mapInArrow(_parse, RECORD_SCHEMA)


def file_fields(records: DataFrame) -> DataFrame:
    """The fused schema per cluster and file: path and set of type tags."""
    field = F.explode(F.split("shape", _NEXT)).alias("field")
    return (
        records.select("cluster_id", "file_no", "shape")
        .distinct()
        .select("cluster_id", "file_no", field)
        .groupBy("cluster_id", "file_no", F.expr("substr(field, 3)").alias("path"))
        .agg(F.bit_or(F.expr("cast(substr(field, 1, 2) as int)")).alias("tags"))
    )


def file_order(fields: DataFrame) -> DataFrame:
    """Each file of a cluster with the one before and after it."""
    w = Window.partitionBy("cluster_id").orderBy("file_no")
    return fields.select("cluster_id", "file_no").distinct().select(
        "*", F.lag("file_no").over(w).alias("prev_no"), F.lead("file_no").over(w).alias("next_no")
    )


def _parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(_STEP)), F.regexp_replace(path, f"{_STEP}[^{_STEP}]*\\z", "")).otherwise(F.lit(""))


def _ancestors(path: Column) -> Column:
    """Paths of the proper ancestors, without the mark of array elements."""
    parts = F.split(path, _STEP)
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n), _STEP), f"{_ITEM}+\\z", "")),
    )


def raw_changes(fields: DataFrame, order: DataFrame) -> DataFrame:
    """Topmost changed paths per cluster and file: tags before and now, null where absent."""
    known = fields.join(order, ["cluster_id", "file_no"])
    now = known.where("prev_no is not null").select("cluster_id", "file_no", "path", F.lit(None).cast("int").alias("before"), F.col("tags").alias("now"))
    then = known.where("next_no is not null").select("cluster_id", F.col("next_no").alias("file_no"), "path", F.col("tags").alias("before"), F.lit(None).cast("int").alias("now"))
    changed = (
        now.unionByName(then)
        .groupBy("cluster_id", "file_no", "path")
        .agg(F.max("before").alias("before"), F.max("now").alias("now"))
        .where("before is null or now is null or (before <> now and before > 0 and now > 0)")
    )
    above = changed.select("cluster_id", "file_no", "path", F.explode_outer(_ancestors(F.col("path"))).alias("above"))
    tops = changed.select("cluster_id", "file_no", F.col("path").alias("above"), F.lit(True).alias("hit"))
    covered = above.join(tops, ["cluster_id", "file_no", "above"], "left_semi").select("cluster_id", "file_no", "path").distinct()
    return changed.join(covered, ["cluster_id", "file_no", "path"], "left_anti")


def renames(records: DataFrame, changes: DataFrame, order: DataFrame) -> DataFrame:
    """Pairs of a vanished and an appeared path that hold equal values in all shared records."""
    moved = changes.where("(before is null) <> (now is null)").select(
        "cluster_id", "file_no", "path", _parent(F.col("path")).alias("parent"), F.coalesce("before", "now").alias("tags"), F.col("now").isNotNull().alias("is_new")
    )
    both = moved.groupBy("cluster_id", "file_no", "parent", "tags").agg(F.countDistinct("is_new").alias("sides")).where("sides = 2").drop("sides")
    candidates = moved.join(both, ["cluster_id", "file_no", "parent", "tags"]).join(order.select("cluster_id", "file_no", "prev_no"), ["cluster_id", "file_no"])
    wanted = candidates.groupBy("cluster_id", "file_no", "prev_no").agg(
        F.collect_list(F.when(F.col("is_new"), F.struct("path", "parent", "tags"))).alias("new"),
        F.collect_list(F.when(~F.col("is_new"), F.struct("path", "parent", "tags"))).alias("old"),
    )
    # ids that both files hold; records of one file have their paths looked up there
    sides = wanted.select(
        F.explode(
            F.array(
                F.struct(F.col("file_no").alias("at"), F.lit(True).alias("is_new"), F.col("new").alias("paths")),
                F.struct(F.col("prev_no").alias("at"), F.lit(False).alias("is_new"), F.col("old").alias("paths")),
            )
        ).alias("s"),
        "cluster_id",
        F.col("file_no").alias("to_no"),
    ).select("cluster_id", F.col("s.at").alias("file_no"), "to_no", "s.is_new", "s.paths")
    names = F.transform(F.split("shape", _NEXT), lambda x: F.substr(x, F.lit(3)))
    met = records.join(sides, ["cluster_id", "file_no"]).withColumn("names", names)
    held = met.select(
        "cluster_id",
        "to_no",
        "rec_id",
        "is_new",
        F.transform(
            "paths",
            lambda p: F.struct(
                p["path"].alias("path"),
                p["parent"].alias("parent"),
                p["tags"].alias("tags"),
                F.get(F.col("hashes"), (F.array_position(F.col("names"), p["path"]) - 1).cast("int")).alias("h"),
            ),
        ).alias("values"),
    )
    flat = held.select("cluster_id", "to_no", "rec_id", "is_new", F.explode("values").alias("v")).select("cluster_id", "to_no", "rec_id", "is_new", "v.*")
    one = flat.groupBy("cluster_id", "to_no", "rec_id", "is_new", "path", "parent", "tags").agg(F.min("h").alias("least"), F.max("h").alias("h"), F.count("h").alias("n"), F.count(F.lit(1)).alias("m"))
    one = one.select("*", ((F.col("least") == F.col("h")) & (F.col("n") == F.col("m"))).alias("clear"))
    shared = one.groupBy("cluster_id", "to_no", "rec_id").agg(F.countDistinct("is_new").alias("k")).where("k = 2").drop("k")
    one = one.join(shared, ["cluster_id", "to_no", "rec_id"], "left_semi").where("h is not null")
    held_by = one.groupBy("cluster_id", "to_no", "is_new", "path").agg(F.countDistinct("rec_id").alias("n_held"))
    key = ["cluster_id", "to_no", "rec_id", "parent", "tags", "h"]
    old = one.where("not is_new and clear").select(*key, F.col("path").alias("field_path"))
    new = one.where("is_new and clear").select(*key, F.col("path").alias("new_path"))
    agreed = old.join(new, key).groupBy("cluster_id", "to_no", "parent", "tags", "field_path", "new_path").agg(F.count(F.lit(1)).alias("n"))
    was = held_by.where("not is_new").select("cluster_id", "to_no", F.col("path").alias("field_path"), F.col("n_held").alias("n_old"))
    now = held_by.where("is_new").select("cluster_id", "to_no", F.col("path").alias("new_path"), F.col("n_held").alias("n_new"))
    fitting = agreed.join(was, ["cluster_id", "to_no", "field_path"]).join(now, ["cluster_id", "to_no", "new_path"]).where("n = n_old and n = n_new")
    pair = F.struct((-F.col("n")).alias("order"), "field_path", "new_path")
    chosen = fitting.groupBy("cluster_id", "to_no", "parent", "tags").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    kept = F.aggregate(
        "pairs",
        F.array().cast("array<struct<order:bigint,field_path:string,new_path:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda x: (x["field_path"] == p["field_path"]) | (x["new_path"] == p["new_path"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(p["order"].cast("bigint").alias("order"), p["field_path"].alias("field_path"), p["new_path"].alias("new_path"))))
        ),
    )
    return chosen.select("cluster_id", F.col("to_no").alias("file_no"), F.explode(kept).alias("p")).select("cluster_id", "file_no", "p.field_path", "p.new_path")


def shown(path: Column) -> Column:
    """A path in the notation of field statistics: ``user.name``, ``items[].id``."""
    return F.replace(F.replace(path, F.lit(_ITEM), F.lit("[]")), F.lit(_STEP), F.lit("."))


def _compared(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of paths and renames of staged ``shape_records``, both staged."""
    fields = stage(file_fields(records), "file-fields")
    order = file_order(fields)
    changes = stage(raw_changes(fields, order), "raw-changes")
    return changes, stage(renames(records, changes, order), "renames")


def schema_changes(entries: DataFrame) -> DataFrame:
    """Every change from a file of a cluster to its next: cluster_id, file_no, change, field_path, new_path."""
    changes, pairs = _compared(stage(shape_records(entries), "shape-records"))
    gone = pairs.select("cluster_id", "file_no", F.explode(F.array("field_path", "new_path")).alias("path"))
    rest = changes.join(gone, ["cluster_id", "file_no", "path"], "left_anti").select(
        "cluster_id",
        "file_no",
        F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("type_changed").alias("change"),
        shown(F.col("path")).alias("field_path"),
        F.lit("").alias("new_path"),
    )
    named = pairs.select("cluster_id", "file_no", F.lit("renamed").alias("change"), shown(F.col("field_path")).alias("field_path"), shown(F.col("new_path")).alias("new_path"))
    return rest.unionByName(named)


def _tag_names(tags: Column) -> Column:
    named = F.array(*[F.when(tags.bitwiseAND(bit) > 0, F.lit(name)) for name, bit in TAGS.items() if bit])
    return F.array_join(F.array_compact(named), "|")


def cluster_schemas(entries: DataFrame) -> DataFrame:
    """The one table's schema per cluster: path, alternative types, canonical type, files that have it.

    The canonical type holds every alternative without loss: the type itself
    if there is one, else string (objects and arrays as JSON text).
    """
    fields = file_fields(shape_records(entries))
    return (
        fields.groupBy("cluster_id", "path")
        .agg(F.bit_or("tags").alias("tags"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count(F.lit(1)).alias("n_files"))
        .select(
            "cluster_id",
            shown(F.col("path")).alias("field_path"),
            _tag_names(F.col("tags")).alias("alternatives"),
            F.when(F.bit_count("tags") == 1, _tag_names(F.col("tags"))).otherwise("string").alias("canonical_type"),
            "first_file",
            "last_file",
            "n_files",
        )
    )


_UNIFIED = "cluster_id string, file_no int, rec_id string, field_path string, unified_path string, place int, type string, as_number double, as_boolean boolean, as_text string"
_SALT = 16


def first_name(path: str, file_no: int, renamed: list[tuple[int, str, str]]) -> str:
    """The first name of a path of a file: renames (file, old path, new path) up to that file undone, the latest first."""
    for at, old, new in sorted(renamed, reverse=True):
        if at <= file_no and path.startswith(new) and path[len(new) : len(new) + 1] in ("", _STEP, _ITEM):
            path = old + path[len(new) :]
    return path


def _number(value: int | float) -> float | None:
    """A number as a double; none for one that is too large, whose digits are in the text."""
    try:
        return float(value)
    except OverflowError:
        return None


def _unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _UNIFIED.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    out: list[tuple] = []
    held = 0
    for batch in batches:
        for cluster, file_no, raw, renamed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            try:
                body = jsonkit.parse_bytes(raw)
            except ValueError:
                continue
            if type(body) is not dict or "id" not in body:
                continue
            pairs = [(r["file_no"], r["field_path"], r["new_path"]) for r in renamed or ()]
            rec = jsonkit.clean(jsonkit.canonical_text(body["id"]))
            for path, (_, values) in fields_of(body).items():
                here, first = (jsonkit.clean(p.replace(_ITEM, "[]").replace(_STEP, ".")) for p in (path, first_name(path, file_no, pairs) if pairs else path))
                for i, v in enumerate(values):
                    t = jsonkit.kind(v)
                    text = v if t == "string" else None if v is None else jsonkit.canonical_text(v)
                    out.append((cluster, file_no, rec, here, first, i, t, _number(v) if t == "number" else None, v if t == "boolean" else None, None if text is None else jsonkit.clean(text)))
                    held += 100 + len(text or "")
                    if held >= _FLUSH:
                        yield made(out)
                        out, held = [], 0
    if out:
        yield made(out)


def unified_records(entries: DataFrame) -> DataFrame:
    """All usable bodies in one table: a row per value of a field with its type, typed branches and the canonical text.

    ``as_number`` and ``as_boolean`` hold the value where it has that type;
    ``as_text`` holds every value without loss, objects and arrays as JSON
    text and numbers with all digits (``as_number`` is empty for numbers that
    no double holds). Array elements that are not objects have no path of
    their own; they are in the text of their array. ``unified_path`` is the
    field's first name: renames found between files are undone, also of the
    objects and arrays around it, so a renamed field stays one column.
    """
    bodies = usable_bodies(entries)
    _, pairs = _compared(stage(shape_records(entries), "shape-records"))
    # a cluster may hold most bodies: its renames meet them in as many places as there are salts
    salted = pairs.groupBy("cluster_id").agg(F.collect_list(F.struct("file_no", "field_path", "new_path")).alias("renamed"))
    salted = salted.select("cluster_id", "renamed", F.explode(F.array(*[F.lit(i) for i in range(_SALT)])).alias("_salt"))
    met = bodies.withColumn("_salt", F.pmod(F.xxhash64("body"), F.lit(_SALT)).cast("int")).join(salted, ["cluster_id", "_salt"], "left")
    return met.select("cluster_id", "file_no", "body", "renamed").mapInArrow(_unify, _UNIFIED)
