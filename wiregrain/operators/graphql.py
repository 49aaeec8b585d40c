"""GraphQL traffic: operations, their variables, errors, fragments and response variants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gql, headers, jsonkit
from ..sources.tables import latest_entries, stage
from .meta import META

_OPERATION = (
    "entry_id string, ts_ms bigint, host string, is_batched boolean, batch_index int, name string, type string, fields array<string>, "
    "raw_query string, variables string, has_variables boolean, parse_failed boolean, has_errors boolean, response string"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for entry, ts, host, request, response in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            try:
                found = gql.operations(jsonkit.parse_bytes(request))
            except ValueError:
                continue
            if found is None:
                continue
            flags, text = [], None
            if response is not None:
                try:
                    flags = gql.error_flags(jsonkit.parse_bytes(response))
                    text = response.decode("utf-8")
                except ValueError:
                    pass
            for op in found[0]:
                variables = None if op.variables is None else jsonkit.canonical_text(op.variables)
                failed = op.batch_index < len(flags) and flags[op.batch_index]
                rows.append((entry, ts, host, found[1], op.batch_index, jsonkit.clean(op.name), op.type, [jsonkit.clean(f) for f in op.fields], jsonkit.clean(op.raw_query), variables, variables is not None, op.parse_failed, failed, text))
        types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        names = [c.strip().split(" ")[0] for c in _OPERATION.split(", ")]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def operations(entries: DataFrame) -> DataFrame:
    """One row per operation of each POST request with a JSON body that is a GraphQL request.

    Whether the request is one is decided on its latest delivery; bodies of
    other requests are not shuffled.
    """
    is_post = F.col("request.method") == "POST"
    json_type = lambda s: F.contains(F.lower(headers.first_value(F.col(f"{s}.headers"), "content-type")), F.lit("json"))
    request = F.when(is_post & json_type("request"), F.expr("try_to_binary(request.body, 'base64')"))
    kept = latest_entries(
        entries,
        {
            "ts_ms": META["ts_ms"](),
            "host": META["host"](),
            "request": request,
            "response": F.when(request.isNotNull() & json_type("response"), F.expr("try_to_binary(response.body, 'base64')")),
        },
    ).where("request is not null")
    return kept.mapInArrow(_parse, _OPERATION)


def operation_clusters(ops: DataFrame) -> DataFrame:
    """Operations per name and type: count, errors, whether variables occur, and all fields."""
    return ops.groupBy("name", "type").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.col("has_errors").cast("int")).alias("error_count"),
        F.max("has_variables").alias("has_variables"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields")))), ",").alias("fields"),
    )


def operation_examples(ops: DataFrame, most: int = 5) -> DataFrame:
    """The newest entries of each operation."""
    w = Window.partitionBy("name", "type").orderBy(F.desc("ts_ms"), "entry_id", "batch_index")
    return ops.select("name", "type", "entry_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def traffic_summary(ops: DataFrame) -> DataFrame:
    """Totals over all operations: by type, anonymous, batched entries, distinct operations and hosts."""
    by = lambda t: F.sum((F.col("type") == t).cast("int"))
    return ops.agg(
        F.count(F.lit(1)).alias("total_requests"),
        by("query").alias("query_count"),
        by("mutation").alias("mutation_count"),
        by("subscription").alias("subscription_count"),
        F.sum((F.col("name") == "anonymous").cast("int")).alias("anonymous_count"),
        F.countDistinct(F.when(F.col("is_batched"), F.col("entry_id"))).alias("batched_count"),
        F.countDistinct("name", "type").alias("unique_operations"),
        F.countDistinct("host").alias("n_hosts"),
    )


def _variable_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for name, kind, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            value = jsonkit.parse_json(text)
            if isinstance(value, dict):
                for k, v in value.items():
                    row = (name, kind, jsonkit.clean(k), jsonkit.kind(v), None if v is None else jsonkit.clean(jsonkit.canonical_text(v)))
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["name", "type", "variable", "value_type", "value"])


def variable_values(ops: DataFrame) -> DataFrame:
    """name, type, variable, value_type, value of every variable of every operation."""
    return ops.where("variables is not null").select("name", "type", "variables").mapInArrow(_variable_rows, "name string, type string, variable string, value_type string, value string")


def variable_distributions(ops: DataFrame, top: int = 5) -> DataFrame:
    """Per operation and variable: dominant type, distinct values, nulls, and the most frequent scalars."""
    counted = variable_values(ops).groupBy("name", "type", "variable", "value_type", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = stage(counted, "variable-values")
    key = ["name", "type", "variable"]
    typed = counted.where("value_type <> 'null'").groupBy(*key, "value_type").agg(F.sum("n").alias("n"))
    dominant = typed.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("rank"), "value_type")).alias("d")).select(*key, F.col("d.value_type").alias("value_type"))
    sums = counted.groupBy(*key).agg(F.count("value").alias("unique_count"), F.sum(F.when(F.col("value_type") == "null", F.col("n")).otherwise(0)).alias("null_count"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "value")
    best = counted.where("value is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    shown = best.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",").alias("top"))
    out = sums.join(dominant, key, "left").join(shown, key, "left")
    kind = F.coalesce("value_type", F.lit("null"))
    return out.select(*key, kind.alias("value_type"), "unique_count", "null_count", F.when(kind.isin("object", "array"), "").otherwise(F.coalesce("top", F.lit(""))).alias("top_values"))


def error_summary(ops: DataFrame) -> DataFrame:
    """Per operation: entries checked, with errors, partial and full failures. A batched response contributes none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, partial = [], []
            for text in batch.column(2).to_pylist():
                value = jsonkit.parse_json(text) if text else None
                errors = value.get("errors") if isinstance(value, dict) else None
                n = len(errors) if isinstance(errors, list) else 0
                found.append(n)
                partial.append(bool(n) and value.get("data") is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64()), pa.array(partial, pa.bool_())], names=["name", "type", "errors", "is_partial"])

    checked = ops.select("name", "type", "response").mapInArrow(run, "name string, type string, errors bigint, is_partial boolean")
    has = F.col("errors") > 0
    return checked.groupBy("name", "type").agg(
        F.count(F.lit(1)).alias("entries_checked"),
        F.sum(has.cast("int")).alias("entries_with_errors"),
        F.sum("errors").alias("total_errors"),
        F.sum((has & F.col("is_partial")).cast("int")).alias("partial_failures"),
        F.sum((has & ~F.col("is_partial")).cast("int")).alias("full_failures"),
    )


def typenames(ops: DataFrame) -> DataFrame:
    """Per operation every ``__typename`` of its responses: name, type, path, typename, whether nothing else was selected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, kind, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(name, kind, jsonkit.clean(at), jsonkit.clean(t), bare) for at, t, bare in gql.typed_objects(jsonkit.parse_json(text))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.bool_()], strict=True)], names=["name", "type", "path", "typename", "is_bare"])

    # one response per entry and operation, also where a batch names the operation twice
    answered = ops.where("response is not null").groupBy("name", "type", "entry_id").agg(F.first("response").alias("response")).select("name", "type", "response")
    return answered.mapInArrow(run, "name string, type string, path string, typename string, is_bare boolean")


def fragment_warnings(ops: DataFrame) -> DataFrame:
    """Objects of which only the type name was selected: they lack a fragment."""
    return typenames(ops).where("is_bare").select("name", "type", "path", "typename").distinct()


def operation_fragments(ops: DataFrame) -> DataFrame:
    """Fragments of each operation's query texts: name, type, fragment, on_type, is_inline, fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, kind, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(name, kind, f.name, f.on_type, f.is_inline, ",".join(f.fields)) for f in gql.fragments(text)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.string()] * 4 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["name", "type", "fragment", "on_type", "is_inline", "fields"])

    texts = ops.select("name", "type", "raw_query").distinct()
    return texts.mapInArrow(run, "name string, type string, fragment string, on_type string, is_inline boolean, fields string").distinct()


def fragment_coverage(ops: DataFrame) -> DataFrame:
    """Types seen in responses against types that fragments are on: matched, unmatched or unused."""
    seen = typenames(ops).groupBy("name", "type", "typename").agg(F.count(F.lit(1)).alias("n"))
    own = operation_fragments(ops).groupBy("name", "type", F.col("on_type").alias("typename")).agg(F.array_join(F.array_sort(F.collect_set("fragment")), ",").alias("fragments"))
    both = seen.join(own, ["name", "type", "typename"], "full_outer")
    state = F.when(F.col("n").isNull(), "unused").when(F.col("fragments").isNull(), "unmatched").otherwise("matched")
    return both.select("name", "type", "typename", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("fragments", F.lit("")).alias("fragments"), state.alias("state"))


def response_variants(ops: DataFrame, most: int = 10) -> DataFrame:
    """Operations answered in several shapes: each shape with its count and the variable that tells them apart.

    A variable's score is the share of pairs of shapes that share none of its
    values; pairs are taken among at most ``most`` shapes of an operation, the
    earliest, and the best variable (score above 0, then name) is reported.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [",".join(map(jsonkit.clean, gql.response_shape(jsonkit.parse_json(t)))) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(keys, pa.string())], names=["name", "type", "entry_id", "ts_ms", "variables", "shape"])

    answered = ops.where("response is not null").select("name", "type", "entry_id", "ts_ms", "response", F.coalesce("variables", F.lit("{}")).alias("variables"))
    shaped = stage(answered.mapInArrow(shapes, "name string, type string, entry_id string, ts_ms bigint, variables string, shape string").where("shape <> ''"), "response-shapes")
    key = ["name", "type"]
    groups = shaped.groupBy(*key, "shape").agg(F.count(F.lit(1)).alias("entry_count"), F.min(F.struct("ts_ms", "entry_id")).alias("first"))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("first"))).where(F.col("rank") <= most)
    sizes = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_shapes")).where("n_shapes > 1")
    ranked = ranked.join(sizes, key)
    values = shaped.join(ranked.select(*key, "shape", "rank"), [*key, "shape"]).select(*key, "rank", "variables")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, kind, rank, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                value = jsonkit.parse_json(text)
                rows += [(name, kind, rank, jsonkit.clean(k), jsonkit.clean(jsonkit.canonical_text(v))) for k, v in (value.items() if isinstance(value, dict) else ())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["name", "type", "rank", "variable", "value"])

    held = values.mapInArrow(exploded, "name string, type string, rank int, variable string, value string").groupBy(*key, "variable", "value").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    pair = F.flatten(F.transform("ranks", lambda a: F.transform(F.filter("ranks", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    overlaps = held.select(*key, "variable", F.explode_outer(pair).alias("p")).groupBy(*key, "variable").agg(F.countDistinct("p").alias("shared"))
    scored = overlaps.join(sizes, key).withColumn("pairs", F.col("n_shapes") * (F.col("n_shapes") - 1) / 2).withColumn("score", 1 - F.col("shared") / F.col("pairs"))
    best = scored.where("score > 0").groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("rank"), "variable")).alias("b")).select(*key, F.col("b.variable").alias("discriminating_variable"))
    return ranked.join(best, key, "left").select(*key, "shape", "entry_count", F.col("first.entry_id").alias("example_entry_id"), F.coalesce("discriminating_variable", F.lit("")).alias("discriminating_variable"))
