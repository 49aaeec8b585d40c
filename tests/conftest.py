from __future__ import annotations

import base64
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("wiregrain-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def b64(value) -> str:
    text = value if isinstance(value, str) else json.dumps(value)
    return base64.b64encode(text.encode()).decode()


def make_entry(key, **given):
    """A row of ``entries``; headers as lists of pairs, bodies as text or JSON values."""
    response = given.get("response", {})
    return (
        key,
        given.get("session", "s1"),
        "f1",
        given.get("file_no", 1),
        given.get("url", "https://api.x.example/v1/users/7"),
        given.get("http_version", "h2"),
        "request",
        None if given.get("request") is None and "request" in given else (given.get("method", "GET"), None, given.get("headers", []), b64(given["body"]) if "body" in given else None),
        None if response is None else (response.get("status", 200), None, response.get("headers", [["Content-Type", "application/json"]]), response["raw"] if "raw" in response else b64(response["body"]) if "body" in response else None),
        (given.get("ts", 1000), None, None, None),
        given.get("process", (1, "node")),
        given.get("tls", ("t1", 772, "j3", "j4")),
        given.get("http2"),
        given.get("at"),
    )


@pytest.fixture(scope="session")
def entries_of(spark):
    from datetime import datetime

    from wiregrain.sources.live import ENTRY_SCHEMA

    def build(rows, extra=None):
        fixed = [(*r[:-1], r[-1] or datetime(2025, 1, 1)) for r in rows]
        df = spark.createDataFrame(fixed, ENTRY_SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in extra:
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())
