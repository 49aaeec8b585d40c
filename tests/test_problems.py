"""The data-preparation operators against brute force and on edge cases."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
from datetime import datetime
from urllib.parse import unquote

import duckdb
import pytest
from conftest import DATA, make_entry, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wiregrain.functions import jsonkit
from wiregrain.operators import drift, nested, packed, skew
from wiregrain.sources import read_table
from wiregrain.sources.tables import places

SF = f"{DATA}/sf0.01"
CLASH = ["cluster_id", "record_id", "value", "shape", "_row", "raw", "name", "n_entries"]


def latest(columns):
    return duckdb.sql(f"select {columns} from '{SF}/entries.parquet' qualify row_number() over (partition by entry_id order by ingested_at desc) = 1").fetchall()


def cluster_of(session, url, method):
    m = re.match(r"(?i)^[a-z]+://([^/?#]*)([^?#]*)", url)

    def seg(s):
        low = s.lower()
        if re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low):
            return "{uuid}"
        return "{id}" if re.fullmatch(r"[0-9]+", s) else "{hex}" if re.fullmatch(r"[0-9a-f]{8,}", low) else s

    path = "/".join(map(seg, unquote(m[2]).split("/")))
    return hashlib.sha256("\0".join([session, m[1].rpartition("@")[2].lower(), method, path]).encode()).hexdigest()[:16]


# -- schemas that drift ---------------------------------------------------------


def walk(o, at, out):
    types = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object"}
    for k, v in o.items():
        tags, values = out.setdefault(at + k, (set(), []))
        if v is not None:
            tags.add(types[type(v)])
        values.append(json.dumps(v, sort_keys=True))
        if isinstance(v, dict):
            walk(v, at + k + ".", out)
        elif isinstance(v, list):
            for e in v:
                if isinstance(e, dict):
                    walk(e, at + k + "[].", out)


def brute_changes():
    files: dict = {}
    for session, url, method, no, status, body in latest("session_id, url, request.method, file_no, response.status_code, response.body"):
        try:
            o = json.loads(base64.b64decode(body, validate=True).decode())
        except (ValueError, TypeError):
            continue
        if status == 200 and isinstance(o, dict) and "id" in o:
            files.setdefault(cluster_of(session, url, method), {}).setdefault(no, []).append(o)
    out = set()
    for cluster, by_file in files.items():
        before = None
        for no in sorted(by_file):
            schema, ids = {}, {}
            for o in by_file[no]:
                found = {}
                walk(o, "", found)
                ids[o["id"]] = found
                for p, (tags, _) in found.items():
                    schema.setdefault(p, set()).update(tags)
            if before:
                old, old_ids = before
                changed = [p for p in {*schema, *old} if (p in schema) != (p in old) or (schema[p] != old[p] and schema[p] and old[p])]
                top = [p for p in changed if not any(p != q and p.startswith((q + ".", q + "[].")) for q in changed)]
                used = set()
                for a in sorted(p for p in top if p not in schema):
                    for b in sorted(p for p in top if p not in old):
                        if b in used or a.rpartition(".")[0] != b.rpartition(".")[0] or old[a] != schema[b]:
                            continue
                        pairs = [(old_ids[k].get(a, (0, None))[1], ids[k].get(b, (0, None))[1]) for k in ids if k in old_ids]
                        if any(x is not None for x, _ in pairs) and all(x == y for x, y in pairs):
                            used |= {a, b}
                            out.add((cluster, no, "renamed", a, b))
                            break
                out |= {(cluster, no, "added" if p not in old else "removed" if p not in schema else "type_changed", p, "") for p in top if p not in used}
            before = (schema, ids)
    return out


def test_drift_against_brute_force(spark):
    got = rows(drift.schema_changes(read_table(spark, SF, "entries")))
    assert len(got) == len(set(got)) and set(got) == brute_changes()


def drift_entries(entries_of, files, **more):
    made = []
    for no, found in enumerate(files, 1):
        for i, body in enumerate(found):
            made.append(make_entry(f"e{no}-{i}", file_no=no, response={"body": body}, **more))
    return entries_of(made, CLASH)


def changes(df):
    return sorted(tuple(r)[1:] for r in drift.schema_changes(df).collect())


def test_drift_kinds(entries_of):
    a = [{"id": 1, "x": "v", "o": {"p": 1, "q": [1]}, "arr": [{"k": 1, "z": True}]}, {"id": 2, "x": "w", "o": {"p": 2, "q": []}, "n": None}]
    b = [{"id": 1, "y": "v", "o": [1], "arr": [{"k": "1", "z": True, "new": {"deep": 1}}], "n": None}, {"id": 3, "y": "other", "n": 5}]
    assert changes(drift_entries(entries_of, [a, b])) == [
        (2, "added", "arr[].new", ""),
        (2, "renamed", "x", "y"),
        (2, "type_changed", "arr[].k", ""),
        (2, "type_changed", "o", ""),
    ]


def test_drift_rename_needs_equal_values_in_all_shared_records(entries_of):
    first = [{"id": 1, "a": "x"}, {"id": 2, "a": "y"}]
    assert changes(drift_entries(entries_of, [first, [{"id": 1, "b": "x"}, {"id": 2, "b": "z"}]])) == [(2, "added", "b", ""), (2, "removed", "a", "")]
    assert changes(drift_entries(entries_of, [first, [{"id": 9, "b": "x"}]])) == [(2, "added", "b", ""), (2, "removed", "a", "")]
    assert changes(drift_entries(entries_of, [first, [{"id": 1, "b": "x"}, {"id": 7, "b": "q"}]])) == [(2, "renamed", "a", "b")]
    # ties: two fields with equal values before and after pair up by name
    assert changes(drift_entries(entries_of, [[{"id": 1, "a": True, "b": True}], [{"id": 1, "c": True, "d": True}]])) == [(2, "renamed", "a", "c"), (2, "renamed", "b", "d")]


def test_drift_unusable_bodies(entries_of, spark):
    odd = [
        make_entry("a", file_no=1, response={"body": {"id": 1, "x": 1}}),
        make_entry("b", file_no=2, response={"body": "[1]"}),
        make_entry("c", file_no=2, response={"raw": "%%%"}),
        make_entry("d", file_no=2, response={"status": 500, "body": {"id": 1}}),
        make_entry("e", file_no=2, response=None),
        make_entry("f", file_no=2, response={"body": {"no": "id"}}),
        make_entry("g", file_no=None, response={"body": {"id": 1}}),
        make_entry(None, file_no=2, response={"body": {"id": 1}}),
        make_entry("h", file_no=3, response={"body": {"id": 1, "x": 2.0}}),
        make_entry("h", file_no=3, at=datetime(2024, 1, 1), response={"body": {"id": 1, "other": 2}}),
    ]
    assert changes(entries_of(odd)) == []
    assert changes(entries_of(odd).limit(0)) == []


def test_drift_tables(entries_of):
    df = drift_entries(entries_of, [[{"id": 1, "x": 1, "t": ["a", {"b": 2}]}], [{"id": 2, "x": "s", "big": "y" * 100_000}]])
    found = {r["field_path"]: (r["alternatives"], r["canonical_type"], r["n_files"]) for r in drift.cluster_schemas(df).collect()}
    assert found["x"] == ("string|number", "string", 2) and found["t[].b"] == ("number", "number", 1)
    flat = {(r["rec_id"], r["field_path"]): (r["as_number"], r["as_text"]) for r in drift.unified_records(df).collect()}
    assert flat["1", "x"] == (1.0, "1") and flat["2", "x"] == (None, "s") and len(flat["2", "big"][1]) == 100_000


def test_unified_records_keep_arrays_and_objects(entries_of):
    first = [{"id": 1, "codes": ["a", "b"], "x": 1, "o": {}, "m": [1, {"k": [True]}, [2]]}]
    second = [{"id": 2, "codes": "a", "x": ["s", 2.0], "o": {"b": 1, "a": []}, "deep": json.loads('{"a":' * 300 + "1" + "}" * 300)}]
    df = drift_entries(entries_of, [first, second])
    found = {(r["rec_id"], r["field_path"]): (r["type"], r["as_text"]) for r in drift.unified_records(df).collect()}
    assert found["1", "codes"] == ("array", '["a","b"]') and found["2", "codes"] == ("string", "a")
    assert found["1", "x"] == ("number", "1") and found["2", "x"] == ("array", '["s",2]')
    assert found["1", "o"] == ("object", "{}") and found["2", "o"] == ("object", '{"a":[],"b":1}')
    assert found["1", "m"] == ("array", '[1,{"k":[true]},[2]]') and found["1", "m[].k"] == ("array", "[true]")
    deep: list = []
    for _ in range(3_000):
        deep = [1, {"b": deep, "a": {}}]
    text = jsonkit.canonical_text(deep)
    assert text == jsonkit.canonical_text(jsonkit.parse_json(text)) and text.startswith('[1,{"a":{},"b":[1,{"a":{},"b":')
    # every path of the schemas has rows, and of every type that the schema names
    kinds: dict = {}
    for (_, path), (t, _) in found.items():
        kinds.setdefault(path, set()).add(t)
    assert kinds == {r["field_path"]: set(r["alternatives"].split("|")) for r in drift.cluster_schemas(df).collect()}


def test_unified_records_undo_renames_and_keep_every_digit(entries_of):
    deep = json.loads('{"a":' * 30 + "1" + "}" * 30)
    files = [
        [{"id": i, "total": i * 7, "user": {"mail": f"m{i}"}, "big": 10**400} for i in range(3)],
        [{"id": i, "total": i * 7, "person": {"mail": f"m{i}"}, "big": 2**60 + 1} for i in range(3)],
        [{"id": i, "sum": i * 7, "person": {"mail": f"m{i}"}, "big": 0.1} for i in range(3)] + [{"id": deep, "sum": 1}],
    ]
    found = drift.unified_records(drift_entries(entries_of, files)).collect()
    paths = {(r["file_no"], r["field_path"]): r["unified_path"] for r in found}
    assert {u for (_, p), u in paths.items()} == {"id", "total", "user", "user.mail", "big", *("id" + ".a" * k for k in range(1, 31))}
    assert paths[3, "sum"] == "total" and paths[2, "person.mail"] == paths[3, "person.mail"] == "user.mail" and paths[2, "total"] == "total"
    big = {r["file_no"]: (r["as_number"], r["as_text"]) for r in found if r["field_path"] == "big"}
    assert big == {1: (None, "1" + "0" * 400), 2: (float(2**60), str(2**60 + 1)), 3: (0.1, "0.1")}
    assert drift.first_name("c", 5, [(2, "a", "b"), (4, "b", "c")]) == "a" and drift.first_name("c", 3, [(4, "b", "c")]) == "c"


# -- packed values --------------------------------------------------------------


def test_packed_against_brute_force(spark):
    want = set()
    names = {"request": ("cookie", "x-feature-tags", "x-forwarded-for"), "response": ("link", "x-cache-tags", "vary")}
    for key, request, response in latest("entry_id, request.headers, response.headers"):
        for side, found in (("request", request), ("response", response)):
            for pos, h in enumerate(found or []):
                if len(h) < 2 or h[1] is None or h[0].lower() not in names[side]:
                    continue
                marks = {"cookie": ";", "link": ","}.get(h[0].lower(), ",;|\t")
                parts, cur, quote, i = [], "", "", 0
                while i < len(h[1]):
                    c = h[1][i]
                    if quote and c == "\\":
                        cur += h[1][i : i + 2]
                        i += 2
                        continue
                    if quote:
                        if c == quote and not (c == '"' and h[1][i + 1 : i + 2] == '"'):
                            quote = ""
                        elif c == quote:
                            cur += c
                            i += 1
                    elif c in '"<':
                        quote = {"<": ">"}.get(c, c)
                    elif c in marks:
                        parts.append(cur)
                        cur, i = "", i + 1
                        continue
                    cur += c
                    i += 1
                k = 0
                for p in [*parts, cur]:
                    p = p.strip()
                    if len(p) > 1 and p[0] == p[-1] == '"':
                        p = p[1:-1].replace('\\"', '"').replace('""', '"')
                    if p:
                        want.add((key, side, pos, k, p))
                        k += 1
    got = rows(packed.header_values(read_table(spark, SF, "entries")))
    assert len(got) == len(set(got)) and set(got) == want


def test_packed_edges(entries_of):
    h = [["Cookie", 'a=1;; b="x;y" ; nopair;c='], ["ragged"], [], ["X-Feature-Tags", None], ["x-feature-tags", ' new cart |"say ""hi"", \\"you\\"",, "" |<a,b>;x'], ["x-forwarded-for", '"open, 1.2.3.4'], ["VARY", "no"]]
    df = entries_of([make_entry("e", headers=h, response={"headers": [["LINK", '<a,b>; t="x, y", <c>']]}), make_entry("n", headers=None, response=None)], CLASH)
    assert rows(packed.header_values(df)) == [
        ("e", "request", 0, 0, "a=1"), ("e", "request", 0, 1, 'b="x;y"'), ("e", "request", 0, 2, "c="),
        ("e", "request", 4, 0, "new cart"), ("e", "request", 4, 1, 'say "hi", "you"'), ("e", "request", 4, 2, "<a,b>"), ("e", "request", 4, 3, "x"),
        ("e", "request", 5, 0, '"open'), ("e", "request", 5, 1, "1.2.3.4"),
        ("e", "response", 0, 0, '<a,b>; t="x, y"'), ("e", "response", 0, 1, "<c>"),
    ]
    assert rows(packed.header_values(df.limit(0))) == []


PEOPLE = ["Doe, Jane", "Roe, Max", "Vane, Ida", "Finch, Tom", "Moor, Eva", "Lund, Kai"]


def test_packed_learns_which_delimiters_separate(spark):
    """A delimiter inside values that recur as a whole does not separate; a field may be read unlike its column."""
    rng = random.Random(4)
    named = {"; ".join(rng.sample(PEOPLE, rng.randint(1, 4))) for _ in range(150)} | {f"{w}; {x}" for w in ("alpha", "beta") for x in PEOPLE}
    tags = {rng.choice(",;|\t").join(rng.sample("eu us beta staff pilot gift v2".split(), rng.randint(1, 5))) for _ in range(150)}
    fields = [("people", t) for t in sorted(named)] + [("people", "alpha, beta")] * 3 + [("tags", t) for t in sorted(tags)] + [("tags", "new|one"), ("none", "a,b"), ("tags", None)]
    df = spark.createDataFrame(fields, "name string, raw string").withColumn("k", F.monotonically_increasing_id()).withColumn("separators", F.lit("clash"))
    grammars = {"people": packed.Grammar(",;"), "tags": packed.Grammar(",;|\t")}
    learned = packed.learn(df, grammars)
    assert learned.models["people"].separates[","] < 0.1 < 0.9 < learned.models["people"].separates[";"]
    assert all(p > 0.9 for p in learned.models["tags"].separates.values())
    got = packed.split_fields(df, ["k"], grammars, learned).join(df, "k").select("name", "raw", "value_pos", "value").collect()
    values = {n: {r["value"] for r in got if r["name"] == n} for n in ("people", "tags", "none")}
    assert values == {"people": {*PEOPLE, "alpha", "beta"}, "tags": {*"eu us beta staff pilot gift v2 new one".split()}, "none": set()}
    assert sum(r["raw"] == "alpha, beta" for r in got) == 6
    # without what was learned nothing separates
    bare = packed.split_fields(df, ["k"], grammars, packed.Segmentation()).collect()
    assert {r["value"] for r in bare} == {raw for name, raw in fields if raw and name != "none"}
    # many copies of one field are no evidence, and values that recur nowhere are separated
    copies = spark.createDataFrame([("tags", "only;here")] * 500 + [("tags", f"a{i};b{i}") for i in range(30)], "name string, raw string")
    learned = packed.learn(copies, {"tags": packed.Grammar(";")})
    assert learned.models["tags"].usual(";") == ";" and learned.odd is None and not learned.odd_hot


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " cc ", "", '"d,e"', "f g"]), min_size=1, max_size=6), st.lists(st.sampled_from(",;|"), min_size=5, max_size=5), st.dictionaries(st.sampled_from(["a", "b", "cc", "a,b", "d,e", "a;b"]), st.integers(2, 50)), st.floats(0.01, 0.99))
def test_viterbi_takes_the_best_of_all_readings(parts, marks, counts, share):
    """Weights and decision of a field against every set of separators, spelled out."""
    import math

    raw = "".join(p + m for p, m in zip(parts, [*marks, ""][: len(parts) - 1] + [""], strict=False))
    grammar = packed.Grammar(",;|")
    net = packed.lattice(raw, grammar, packed._cutter(grammar))
    model = packed.Model({",": share, ";": 1 - share, "|": 0.5}, 100.0)
    spelling = packed.Spelling(",;|", {"a": 5.0}, 5.0)
    runs = sorted({r for reading in packed.readings(net.open) for r in net.runs(reading)})
    paths = [[runs.index(r) for r in net.runs(reading)] for reading in packed.readings(net.open)]
    spelled = [spelling.log(*r) for r in runs]
    logs = packed.weights(paths, spelled, [counts.get(v, 0.0) for v, _ in runs], [1.0] * len(runs), model, net.open, [net.borders.count(d) for d in net.open])
    want = {}
    for reading in packed.readings(net.open):
        w = 1.0
        for d in net.borders:
            w *= 1.0 if d == "" else model.separates[d] if d in reading else 1 - model.separates[d]
        for r in net.runs(reading):
            w *= 0.5 * max(counts.get(r[0], 0.0) - 1.0, 0.0) / 100 + math.exp(spelling.log(*r))
        want[reading] = w
    assert [math.exp(x) for x in logs] == pytest.approx(list(want.values()))
    assert want[packed.viterbi(logs, net.open)] == pytest.approx(max(want.values()))
    assert abs(sum(packed.posterior(logs)) - 1) < 1e-9


def test_packed_headers_never_join_values(entries_of):
    """A fixed pair of proxies or tags behind many distinct values stays two values, at any size."""
    for n in (40,):
        made = [make_entry(f"e{i}", headers=[["X-Forwarded-For", f"10.0.0.{i}, 192.0.2.1, 192.0.2.2"]], response={"headers": [["X-Cache-Tags", f"t{i}|site; shop"]]}) for i in range(n)]
        got = rows(packed.header_values(entries_of(made)))
        want = [("request", k, v) for k, v in enumerate(["10.0.0.{}", "192.0.2.1", "192.0.2.2"])] + [("response", k, v) for k, v in enumerate(["t{}", "site", "shop"])]
        assert got == sorted((f"e{i}", side, 0, k, v.format(i)) for i in range(n) for side, k, v in want)


# -- hot keys -------------------------------------------------------------------


def test_wrong_counts_edges(spark, entries_of):
    e = entries_of([
        make_entry("a", url="https://u@H.test:1/x/1"), make_entry("a", url="https://h.test:1/x/1", at=datetime(2026, 1, 1)), make_entry("b", url="https://h.test:1/x/2"),
        make_entry("c", url=None), make_entry("d", method=None, url="https://h.test:1/x/2"), make_entry(None),
    ], CLASH)
    schema = "cluster_id string, session_id string, host string, method string, path_template string, `count` bigint, n_entries string"
    clusters = spark.createDataFrame([
        ("c1", "s1", " H.test:1", "GET", "/x/{id}", 2, "z"), ("c1", "s1", "h.test:1", "GET", "/x/{id}", None, "z"),
        ("c2", "s1", "h.test:1", "GET", "/y", 1, "z"), ("c3", "s1", "h.test:1", "GET", "/z", None, "z"), ("c4", "s1", "h.test:1", "GET", "/q", 0, "z"),
        (None, "s1", "h.test:1", "GET", "/x/{id}", 9, "z"), ("c5", None, None, None, None, 1, "z"),
    ], schema)
    assert rows(skew.wrong_counts(e, clusters)) == [("c2",), ("c5",)]
    assert rows(skew.wrong_counts(e.limit(0), clusters)) == [("c1",), ("c2",), ("c5",)]
    assert rows(skew.wrong_counts(e, clusters.limit(0))) == []


def test_eager_join_aggregate(spark):
    left = spark.createDataFrame([(i % 3 if i < 90 else None, i, "x") for i in range(100)], "k int, a int, n_joined string")
    right = spark.createDataFrame([(0, 1), (0, 2), (1, 5), (None, 9)], "k int, b int")
    plain = left.join(right, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n_joined"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    assert rows(skew.eager_join_aggregate(left, right, ["k"], ["a"], ["b"])) == rows(plain)
    whole = skew.eager_join_aggregate(left, right, ["k"], ["a"], ["b"], rollup=[])
    assert rows(whole) == rows(left.join(right, "k").agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")))


def test_places_equal_a_window(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i * 7 % 101, i) for i in range(300)], "k string, o int, i int")
    got = rows(places(df, ["k"], ["o", "i"]).select("k", "i", "place"))
    import collections

    want, seen = [], collections.Counter()
    for k, _, i in sorted(tuple(r) for r in df.collect()):
        want.append((k, i, seen[k]))
        seen[k] += 1
    assert got == sorted(want)
    assert sorted(r["place"] for r in places(df, [], ["o", "i"]).collect()) == list(range(300))


# -- nested records ---------------------------------------------------------------


def brute_nodes(value, at="", owner=""):
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return
        if isinstance(inner, (dict, list)):
            yield from brute_nodes(inner, at, owner)
        return
    if isinstance(value, dict):
        if at:
            yield at, owner
        for k, v in value.items():
            yield from brute_nodes(v, at + "/" + k.replace("~", "~0").replace("/", "~1"), at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute_nodes(v, f"{at}/{i}", owner)


def test_nested_against_brute_force(spark):
    want = set()

    def add(source, key, text):
        try:
            want.update((source, key, *n) for n in brute_nodes(json.loads(text)))
        except (ValueError, TypeError):
            pass

    for key, body in latest("entry_id, response.body"):
        try:
            add("body", key, base64.b64decode(body, validate=True).decode())
        except (ValueError, TypeError):
            pass
    for key, text in duckdb.sql(f"select op_id, variables from '{SF}/graphql_operations.parquet'").fetchall():
        add("variables", key, text)
    for key, text in duckdb.sql(f"select connection_id, extensions from '{SF}/tls_client_hellos.parquet'").fetchall():
        add("extensions", key, text)
    got = rows(nested.object_nodes(*[read_table(spark, SF, t) for t in ("entries", "graphql_operations", "tls_client_hellos")]))
    assert len(got) == len(set(got)) and set(got) == want


NESTED = [
    ("1", '{"a/b": {"x~y": [[{"k": 1}], {"t": "[{\\"z\\": {}}]"}]}, "e": {}, "n": null}'),
    ("2", '"{\\"o\\": {\\"p\\": {}}}"'),
    ("3", '[{"a": {}}, 5]'),
    ("4", "{broken"), ("5", ""), ("6", None), ("7", "3"), (None, '{"a": {}}'),
    ("8", '{"a": {}, "a": {"b": {}}}'), ("9", '{"a": "not {json}"}'), ("1", '{"a/b": {}}'), ("10", '{"": {"": {}}}'),
    ("11", '{"s": "\\ud800", "o": {"\\ud800": {}}}'),
]


def test_nested_edges(spark):
    df = spark.createDataFrame([(*r, "clash") for r in NESTED], "id string, t string, record_id string")
    got = [tuple(r)[:3] for r in nested.nested_records(df, F.col("id"), F.col("t"), ["object"]).where("node_path <> ''").collect()]
    assert sorted(got) == sorted([
        ("1", "/a~1b", ""), ("1", "/a~1b/x~0y/0/0", "/a~1b"), ("1", "/a~1b/x~0y/1", "/a~1b"), ("1", "/a~1b/x~0y/1/t/0", "/a~1b/x~0y/1"), ("1", "/a~1b/x~0y/1/t/0/z", "/a~1b/x~0y/1/t/0"), ("1", "/e", ""),
        ("2", "/o", ""), ("2", "/o/p", "/o"), ("3", "/0", ""), ("3", "/0/a", "/0"), ("8", "/a", ""), ("8", "/a/b", "/a"), ("1", "/a~1b", ""), ("10", "/", ""), ("10", "//", "/"), ("11", "/o", ""), ("11", "/o/\ufffd", "/o"),
    ])
    assert nested.nested_records(df.limit(0), F.col("id"), F.col("t")).count() == 0


def test_nested_tables(spark):
    df = spark.createDataFrame([("r", json.dumps([{"v": 1, "g": {"n": "a", "record_id": "q"}}, {"v": 2, "g": {"n": "b"}}, {"v": 3}]))], "id string, t string")
    records = nested.nested_records(df, F.col("id"), F.col("t")).cache()
    assert rows(nested.group_tables(records).select("group_path", "parent_group", "n_rows", "members")) == [("/*", "", 3, "v:number"), ("/*/g", "/*", 2, "n:string,record_id:string")]
    assert rows(nested.pivot_group(records, "/*/g", ["n", "record_id"])) == [("r", "/0/g", "/0", "a", "q"), ("r", "/1/g", "/1", "b", None)]


def test_all_groups_of_all_sources(spark, entries_of):
    body = [{"v": 1, "*": None, "g": {"n": "a", "x/y": True}, "codes": ["p", 2], "none": []}, [[3]]]
    e = entries_of([make_entry("e", response={"body": body})], CLASH)
    op = spark.createDataFrame([("o", '{"f": [{"k": 1}]}'), ("o", '{"f": [{"k": 2}]}'), ("o", '{"f": [{"k": 1}]}'), ("p", "{broken")], "op_id string, variables string")
    hello = spark.createDataFrame([("c", '{"s": {"g": "x"}}')], "connection_id string, extensions string")
    got = {(r["source"], r["group_path"], r["node_path"], tuple(map(tuple, r["members"]))): (r["parent_group"], r["parent_path"]) for r in nested.capture_groups(e, op, hello).collect()}
    assert got == {
        ("body", "/*", "/0", (("v", "number", "1"), ("*", "null", None), ("codes", "array", None), ("none", "array", None))): ("", ""),
        ("body", "/*/g", "/0/g", (("n", "string", "a"), ("x/y", "boolean", "true"))): ("/*", "/0"),
        ("body", "/*/codes/*", "/0/codes/0", (("*", "string", "p"),)): ("/*", "/0"),
        ("body", "/*/codes/*", "/0/codes/1", (("*", "number", "2"),)): ("/*", "/0"),
        ("body", "/*", "/1", (("*", "array", None),)): ("", ""),
        ("body", "/*/*", "/1/0", (("*", "array", None),)): ("", ""),
        ("body", "/*/*/*", "/1/0/0", (("*", "number", "3"),)): ("", ""),
        ("variables", "", "", (("f", "array", None),)): ("", ""),
        ("variables", "/f/*", "/f/0", (("k", "number", "1"),)): ("", ""),
        ("variables", "/f/*", "/f/0", (("k", "number", "2"),)): ("", ""),
        ("extensions", "", "", ()): ("", ""),
        ("extensions", "/s", "/s", (("g", "string", "x"),)): ("", ""),
    }
    tables = {tuple(r) for r in nested.capture_tables(e, op, hello).collect()}
    assert {("body", "/*/codes/*", "/*", 2, "*:number,*:string"), ("variables", "/f/*", "", 2, "k:number"), ("extensions", "/s", "", 1, "g:string")} <= tables


def test_deep_record(spark):
    deep = '{"a":' * 3_000 + "1" + "}" * 3_000
    df = spark.createDataFrame([("d", deep)], "id string, t string")
    assert nested.nested_records(df, F.col("id"), F.col("t"), ["object"]).count() == 3_000


@pytest.mark.parametrize("parts", ["1", "8"])
def test_results_do_not_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        e, c = read_table(spark, f"{DATA}/sf0.001", "entries"), read_table(spark, f"{DATA}/sf0.001", "clusters")
        assert len(rows(skew.wrong_counts(e.repartition(int(parts)), c))) == len(rows(skew.wrong_counts(e, c)))
        assert rows(packed.header_values(e.repartition(int(parts)))) == rows(packed.header_values(e))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
