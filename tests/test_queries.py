"""Every registered query at sf0.001: it runs, and where there is SQL the rows are the same."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry_module

SF = f"{DATA}/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else str(v)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry_module.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", "jq_select css_text regex_extract query_body_labels schema_validate graphql_operations html_tag_counts filter_body_contains search_body_matches header_rows p4_found p5_found".split())
def test_building_runs_no_plan(spark, name):
    """Building a query reads at most the footers of its tables; only queries that write a table first run jobs."""
    sc = spark.sparkContext
    sc.setJobGroup(f"build {name}", name)
    QUERIES[name](spark, SF)
    jobs = sc.statusTracker().getJobIdsForGroup(f"build {name}")
    sc.setJobGroup("other", "other")
    assert len(jobs) <= 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        return
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
