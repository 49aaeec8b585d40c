"""Bodies against a schema given as struct declarations, builder expression or JSON Schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonkit import clean
from ..functions.schemas import parse_schema, validate
from .bodyquery import per_body, sides_of


def validate_bodies(entries: DataFrame, schema_text: str, notation: str, target: str = "response") -> DataFrame:
    """Per body: status matching, failed or skipped, and its errors or the reason.

    The schema is parsed once on the driver, where a wrong text fails.
    """
    schema = parse_schema(schema_text, notation)

    def each(kind: str, has: bool, body: bytes | None) -> list[tuple]:
        if not has or body is None or "json" not in kind.lower():
            return [("skipped", ["empty" if not has else "not base64" if body is None else clean(f"not JSON: {kind}")])]
        found = validate(body.decode("utf-8", "replace"), schema)
        return [("failed" if found else "matching", [clean(e) for e in found])]

    return per_body(entries, sides_of(target), lambda: each, "status string, errors array<string>")


def validation_summary(found: DataFrame) -> DataFrame:
    """matching, failed and skipped bodies, and whether all that were checked match."""
    counts = [F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in ("matching", "failed", "skipped")]
    return found.agg(*counts).withColumn("all_match", (F.col("failed") == 0) & (F.col("matching") > 0))


def common_errors(found: DataFrame) -> DataFrame:
    """How many bodies have each error."""
    return found.where("status = 'failed'").select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
