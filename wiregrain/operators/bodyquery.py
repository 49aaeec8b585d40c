"""Extraction from bodies with jq, CSS, XPath, regular expressions or form keys.

The expression is compiled on the driver (a wrong one fails there) and each
task compiles it once. jq paths without iteration and regular expressions have
a plan of their own that stays in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bodies, content, headers, text
from ..functions.jsonkit import clean
from ..sources.tables import latest_entries, stage

TARGETS = ("request", "response", "both")


def decoded_bodies(entries: DataFrame, target: str = "response", entry_ids: Sequence[str] | None = None) -> DataFrame:
    """entry_id, target, content type, whether there is a body, and the decoded body (null where it is not base64)."""
    sides = sides_of(target)
    if entry_ids is not None:
        entries = entries.where(F.col("entry_id").isin(list(entry_ids)))
    kept = latest_entries(
        entries,
        {
            c: v
            for s in sides
            for c, v in (
                (f"{s}_type", headers.first_value(F.col(f"{s}.headers"), "content-type")),
                (f"{s}_has", F.coalesce(F.length(f"{s}.body") > 0, F.lit(False))),
                (f"{s}_body", F.expr(f"try_to_binary({s}.body, 'base64')")),
            )
        },
    )
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("target"), F.col(f"{s}_type").alias("content_type"), F.col(f"{s}_has").alias("has_body"), F.col(f"{s}_body").alias("body")) for s in sides]))
    return kept.select("entry_id", each.alias("b")).select("entry_id", "b.*")


def per_body(entries: DataFrame, sides: Sequence[str], work: Callable[[], Callable[[str, bool, bytes | None], list[tuple]]], ddl: str) -> DataFrame:
    """What ``work`` makes of each body: entry_id, target and the columns of ``ddl``.

    ``work`` is called once per task; its result takes content type, whether
    there is a body, and the body (null where it is not base64), and gives
    rows. Deliveries are worked on before the latest one is chosen, so the
    results are shuffled and not the bodies.
    """
    flat = entries.select(
        "entry_id",
        "ingested_at",
        *[
            c
            for s in sides
            for c in (
                headers.first_value(F.col(f"{s}.headers"), "content-type").alias(f"{s}_type"),
                F.coalesce(F.length(f"{s}.body") > 0, F.lit(False)).alias(f"{s}_has"),
                F.expr(f"try_to_binary({s}.body, 'base64')").alias(f"{s}_body"),
            )
        ],
    )
    row = f"struct<target:string,{ddl.replace(', ', ',').replace(' ', ':')}>"
    names = ["target", *(c.split()[0] for c in ddl.split(", "))]
    arrow = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    item = pa.struct([("target", pa.string()), *((n, arrow[t]) for n, t in (c.split() for c in ddl.split(", ")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, side in enumerate(sides):
                for rows, kind, has, body in zip(found, *[batch.column(2 + 3 * i + k).to_pylist() for k in range(3)], strict=True):
                    rows.extend(dict(zip(names, (side, *r), strict=True)) for r in each(kind, has, body))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(item))], names=["entry_id", "ingested_at", "rows"])

    at = dict(flat.dtypes)["ingested_at"]
    made = flat.mapInArrow(run, f"entry_id string, ingested_at {at}, rows array<{row}>")
    return latest_entries(made, {"rows": F.col("rows")}).select("entry_id", F.explode("rows").alias("r")).select("entry_id", "r.*")


def _extraction(expression: str, mode: str, most: int) -> Callable[[], Callable[[str, bool, bytes | None], list[tuple]]]:
    def work() -> Callable[[str, bool, bytes | None], list[tuple]]:
        extract = bodies.Extractor(expression, mode, most)

        def each(kind: str, has: bool, body: bytes | None) -> list[tuple]:
            if not has:
                return [(None, "skipped", None, "empty")]
            if body is None:
                return [(None, "skipped", None, "not base64")]
            if bodies.is_binary(kind, body):
                return [(None, "skipped", None, clean(f"binary: {kind}"))]
            try:
                used, values, errors = extract(body, kind)
                out = [(used, "value", i, clean(json.dumps(v, ensure_ascii=False, separators=(",", ":")))) for i, v in enumerate(values)]
            except (ValueError, RecursionError) as e:
                return [(None, "error", None, clean(str(e)[:500]))]
            out += [(used, "error", None, clean(e)) for e in errors]
            return out or [(used, "nothing", None, None)]

        return each

    return work


def sides_of(target: str) -> tuple[str, ...]:
    """The sides of an entry that a target names."""
    if target not in TARGETS:
        raise ValueError("target must be 'request', 'response', or 'both'")
    return ("request", "response") if target == "both" else (target,)


def query_bodies(entries: DataFrame, expression: str, mode: str = "", target: str = "response", entry_ids: Sequence[str] | None = None, most: int = 0) -> DataFrame:
    """One row per value (as JSON text), error, skipped body or body without a value: entry_id, target, mode, status, pos, value.

    An empty ``mode`` is chosen by the content type of each body. ``most``
    limits the values of a body (0: all).
    """
    bodies.Extractor(expression, mode, most)
    if entry_ids is not None:
        entries = entries.where(F.col("entry_id").isin(list(entry_ids)))
    return per_body(entries, sides_of(target), _extraction(expression, mode, most), "mode string, status string, pos int, value string")


def values_of(found: DataFrame, deduplicate: bool = False) -> DataFrame:
    """The values; with ``deduplicate`` each once, at its first entry."""
    rows = found.where("status = 'value'")
    if not deduplicate:
        return rows.select("entry_id", "target", "pos", "value")
    return rows.groupBy("value").agg(F.min(F.struct("entry_id", "target", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).select("first.entry_id", "first.target", "first.pos", "value", "n")


def label_counts(found: DataFrame) -> DataFrame:
    """Values per body; bodies that gave none are left out."""
    return found.where("status = 'value'").groupBy("entry_id", "target").agg(F.count(F.lit(1)).alias("n_values"))


def query_errors(found: DataFrame) -> DataFrame:
    """Distinct errors with the number of bodies that have them."""
    return found.where("status = 'error'").groupBy(F.col("value").alias("error")).agg(F.countDistinct("entry_id", "target").alias("n_bodies"))


def query_summary(found: DataFrame) -> DataFrame:
    """Bodies per status, and values in all."""
    return found.groupBy("status").agg(F.countDistinct("entry_id", "target").alias("n_bodies"), F.count("pos").alias("n_values"))


_SIMPLE_PATH = re.compile(r"(?:\.[A-Za-z_]\w*(?:\[\d+\])*)+\Z")


def lowered_path(expression: str) -> str | None:
    """The variant path of a jq expression that only walks down members and places; else nothing."""
    return "$" + expression if _SIMPLE_PATH.match(expression) else None


def json_path_values(entries: DataFrame, expression: str, target: str = "response") -> DataFrame:
    """Non-null scalars at a jq path of JSON bodies, as text; evaluated on variants, without Python."""
    path = lowered_path(expression)
    if path is None:
        raise ValueError("not a plain path")
    raw = F.expr(f"try_to_binary({sides_of(target)[0]}.body, 'base64')").cast("string")
    kind = headers.first_value(F.col(f"{sides_of(target)[0]}.headers"), "content-type")
    flat = entries.select("entry_id", "ingested_at", F.when(F.contains(F.lower(kind), F.lit("json")), raw).alias("body"))
    at = F.try_variant_get(F.try_parse_json(F.when(F.is_valid_utf8("body"), F.col("body"))), path, "variant")
    scalar = ~F.schema_of_variant(at).rlike("^(OBJECT|ARRAY|VOID)")
    # the value is taken before the shuffle, so bodies are not moved
    return latest_entries(flat, {"value": F.when(scalar, F.try_variant_get(at, "$", "string"))}).where("value is not null")


def regex_values(entries: DataFrame, pattern: str, group: int = 0, target: str = "response") -> DataFrame:
    """Every match (or its ``group``) in textual bodies, with its place; evaluated in the JVM."""
    re.compile(pattern)
    side = sides_of(target)[0]
    kind = headers.first_value(F.col(f"{side}.headers"), "content-type")
    flat = entries.select("entry_id", "ingested_at", kind.alias("content_type"), F.expr(f"try_to_binary({side}.body, 'base64')").alias("body"))
    body = F.make_valid_utf8(F.col("body").cast("string"))
    matches = F.when(F.col("body").isNotNull() & ~content.is_binary(F.col("content_type"), F.col("body")), F.regexp_extract_all(body, F.lit(pattern), F.lit(group)))
    # the matches are taken before the shuffle, so bodies are not moved
    return latest_entries(flat, {"found": matches}).select("entry_id", F.posexplode("found").alias("pos", "value"))


def form_keys(entries: DataFrame) -> DataFrame:
    """Keys of query strings: in how many URLs with a query they occur, and how often."""
    keys = F.when(F.contains("url", F.lit("?")), F.transform(text.query_pairs(F.col("url")), lambda p: p["key"]))
    kept = latest_entries(entries, {"keys": keys}).where("keys is not null")
    # one row per key of a URL, and one without a key per URL: their sum is the number of URLs
    each = F.transform(F.array_distinct("keys"), lambda k: F.struct(k.alias("key"), F.size(F.filter("keys", lambda x: x == k)).alias("n")))
    marked = F.explode(F.concat(each, F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).alias("n")))))
    counted = kept.select(marked.alias("k")).groupBy("k.key").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("k.n").alias("n_pairs"))
    counted = stage(counted, "form-keys")
    total = (counted.where("key is null").select("n_urls").first() or [1])[0]
    return counted.where("key is not null").select("key", "n_urls", "n_pairs", F.round(F.col("n_urls") / F.lit(total), 6).alias("frequency"))


def compact_bodies(entries: DataFrame, mode: str = "compact", target: str = "response", max_bytes: int = 0) -> DataFrame:
    """Bodies as they are displayed: entry_id, target, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "" if not has else "[decode error]" if body is None else clean(bodies.display(body, kind, mode, max_bytes))
                for _, _, kind, has, body in zip(*[c.to_pylist() for c in batch.columns], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["entry_id", "target", "text"])

    return decoded_bodies(entries, target).mapInArrow(run, "entry_id string, target string, text string")
