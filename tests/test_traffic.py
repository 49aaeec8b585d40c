"""Search, catalog, flow, comparison, bodies, GraphQL, streaming, live source and engine on small captures."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from conftest import DATA, b64, make_entry, rows
from pyspark.sql import functions as F

from wiregrain.api import Engine
from wiregrain.config import EngineConfig
from wiregrain.errors import EngineError, from_source
from wiregrain.operators import bodyquery, catalog, compare, flow, graphql, infer, search, shapes, validation
from wiregrain.operators.search import Filters
from wiregrain.sources import live, read_table
from wiregrain.streaming import ingest

JSON_TYPE = [["Content-Type", "application/json"]]


@pytest.fixture(scope="module")
def corpus(entries_of):
    """Four entries at 1000 to 4000 ms on two hosts."""
    auth = [["Authorization", "Bearer abc"], ["Accept", "x/y"]]
    return entries_of([
        make_entry("a", ts=1000, url="https://shop.test/v2/wares?q=red", headers=auth),
        make_entry("b", ts=2000, url="https://shop.test/v2/orders", method="POST", process=(2, "curl"), response={"status": 500}),
        make_entry("c", ts=3000, url="https://img.test/pic/a.png", http_version="http/1.1", response={"headers": [["content-type", "image/png"]]}),
        make_entry("d", ts=4000, url="https://shop.test:8443/v2/wares", headers=auth, response={"body": {"msg": "Hello RED"}}),
    ])


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Filters(host="SHOP.test"), "ab"), (Filters(host="*.test"), "abc"), (Filters(host="*."), ""), (Filters(host="none"), ""),
        (Filters(method="POST"), "b"), (Filters(method="post"), ""), (Filters(status=200), "acd"), (Filters(http_version="h2"), "abd"), (Filters(process_name="curl"), "b"), (Filters(pid=1), "acd"),
        (Filters(header_name="AUTHORIZATION"), "ad"), (Filters(header_value=("accept", "x/y")), "ad"), (Filters(since_ms=2000, until_ms=3000), "bc"), (Filters(time_window_ms=1500, now_ms=4000), "cd"),
        (Filters(path_contains="WARES"), "ad"), (Filters(url_contains="q=RED"), "a"), (Filters(header_contains="authorization: bearer"), "ad"), (Filters(body_contains="hello red"), "d"), (Filters(session_id="s2"), ""), (Filters(), "abcd"),
    ],
)
def test_filters(corpus, f, want):
    assert "".join(r[0] for r in rows(search.filtered(corpus, f))) == want


def test_search_scores(corpus):
    got = {r["entry_id"]: (r["score"], r["highlights"], r["matched_in"]) for r in search.search(corpus, "wares bearer", limit=None).collect()}
    assert got == {"a": (0.45, "wares", "url,header"), "d": (0.75, "wares", "url,header")}
    assert [r["entry_id"] for r in search.search(corpus, limit=2, offset=1).collect()] == ["c", "b"]
    assert [r["entry_id"] for r in search.search(corpus, "hello", limit=None, body_index=True).collect()] == ["d"]
    assert search.search(corpus, "hello", limit=None).count() == 0
    assert all(0.1 <= r["score"] <= 1.6 for r in search.search(corpus, "v2", Filters(method="GET", header_name="accept"), limit=None).collect())


def test_search_reads_whole_bodies(entries_of):
    df = entries_of([make_entry("a", response={"body": {"n": 12345, "pad": "x" * 70_000, "msg": "farbehind"}})])
    assert {tuple(r) for r in search.body_token_counts(df).collect()} == {("pad", 1), ("x" * 70_000, 1), ("msg", 1), ("farbehind", 1)}
    assert search.search(df, "farbehind", limit=None, body_index=True).count() == 1
    assert search.search(df, "farbehind", limit=None, body_index=True, body_index_bytes=65_536).count() == 0


def test_body_matches(corpus):
    assert [tuple(r) for r in search.body_matches(corpus, "red", context=3).collect()] == [("d", "https://shop.test:8443/v2/wares", "response", 'lo RED"}')]


def test_clusters(entries_of):
    df = entries_of([make_entry(f"e{i}", ts=i, url=f"https://h.x/v1/users/{i}", response={"status": s, "body": "ab"}) for i, s in enumerate([200, 201, 302, 404, 500, 99])] + [make_entry("z", url="https://h.x/v1/users/9", response=None)])
    (c,) = catalog.endpoint_clusters(df).collect()
    assert (c["count"], c["status_profile"], c["error_rate"], c["avg_resp_bytes"], c["category"], c["content_type_hint"]) == (7, "2xx=2,3xx=1,4xx=1,5xx=1,other=1", 0.571429, 1, "api", "application/json")
    assert [r["entry_id"] for r in catalog.cluster_examples(df, 3).orderBy("place").collect()] == ["e0", "e2", "e4"]
    assert catalog.endpoint_clusters(df, min_count=8).count() == 0 and catalog.endpoint_clusters(df, catalog.Scope(method="get")).count() == 1
    assert catalog.endpoint_clusters(df, normalize_ids=False).count() == 7
    assert catalog.scope_hash() == "default" and len(catalog.scope_hash(catalog.Scope(host="a"))) == 16
    page = catalog.endpoint_page(catalog.endpoint_clusters(df)).collect()
    assert page[0]["total_count"] == 1
    assert catalog.endpoint_clusters(df.limit(0)).count() == 0


def test_describe(entries_of):
    df = entries_of([make_entry(f"e{i}", ts=i, url=f"https://h.x/a?page={i}&lang=en&ts={i}", headers=[["Accept", "x"], ["Cookie", "c=1"], *([["X-API-Key", "k"]] if i else [])]) for i in range(3)])
    assert [tuple(r)[1:] for r in catalog.header_frequency(df).orderBy("rank").collect()] == [(1, "accept", 1.0), (2, "cookie", 1.0), (3, "x-api-key", 0.666667)]
    assert rows(catalog.query_keys(df).drop("cluster_id")) == [("lang", "stable"), ("page", "volatile"), ("ts", "volatile")]
    assert rows(catalog.auth_signals(df).drop("cluster_id")) == [(True, False, "x-api-key")]


def test_flow(entries_of):
    tls = lambda c: (c, 772, "j", "k")
    df = entries_of([
        make_entry("login", ts=1000, tls=tls("A"), response={"headers": [["Set-Cookie", "sid=1; Path=/"]]}),
        make_entry("page", ts=2000, tls=tls("A"), headers=[["Cookie", "sid=1"], ["Authorization", "t"]]),
        make_entry("api", ts=3000, tls=tls("A"), headers=[["Cookie", "sid=1"], ["Authorization", "t"]]),
        make_entry("far", ts=900_000, tls=tls("B"), url="https://other.x/"),
    ])
    nodes, edges = flow.trace(df, "page")
    assert {r["entry_id"] for r in nodes.collect()} == {"login", "page", "api"}
    assert rows(flow.edge_summary(edges)) == [("same_auth", 1), ("same_session_cookie", 1), ("same_tls", 2), ("session_cookie_origin", 2)]
    assert len(set(rows(edges))) == edges.count()
    assert {r["entry_id"] for r in flow.trace(df, "page", limit=2)[0].collect()} == {"login", "page"}
    assert flow.related(flow.flow_nodes(df), "nobody").count() == 0
    assert ("api", "far", "temporal") in rows(flow.flow_edges(flow.flow_nodes(df), per_session=True))


def test_diffs(spark, entries_of):
    base = [["Host", "h"], ["Accept", "a"], ["X", "1"], ["Date", "d1"]]
    df = entries_of([
        make_entry("a", headers=base), make_entry("b", headers=[["Host", "h"], ["Accept", "b"], ["X", "1"], ["Date", "d2"]]), make_entry("c", headers=[["Accept", "a"], ["Host", "h"], ["New", "n"], ["Date", "d"]], tls=("t", 1, "j3", "other")),
        make_entry("d", headers=base, tls=("t1", 772, "another", "j4")), make_entry("e", headers=base, http2=("h", 3)), make_entry("f", headers=base[:3]), make_entry("g", headers=[]),
    ])
    pairs = spark.createDataFrame([("a", x) for x in "abcdefg"], "baseline_id string, candidate_id string")
    got = {r["candidate_id"]: r for r in compare.diffs(df, pairs).collect()}
    assert {k: r["severity"] for k, r in got.items()} == {"a": "low", "b": "medium", "c": "high", "d": "low", "e": "medium", "f": "medium", "g": "high"}
    assert (got["c"]["headers_missing"], got["c"]["headers_extra"], got["b"]["headers_changed"], got["b"]["headers_ignored"]) == ("x", "new", "accept", "date")
    assert got["d"]["ja3_changed"] and got["e"]["http2_changed"]
    moves = {r["candidate_id"]: r["moves"] for r in compare.header_moves(df, pairs).collect()}
    assert moves["c"] == "accept:1>0" or moves["c"] == "host:0>1"
    assert compare.moved_headers(list("abc"), list("abc")) == []


def test_body_query(entries_of):
    df = entries_of([
        make_entry("a", response={"body": {"k": [1, None, "x"]}}), make_entry("b", response={"body": "<h1>T</h1>", "headers": [["content-type", "text/html"]]}),
        make_entry("c", response={"raw": "%%"}), make_entry("d", response=None), make_entry("e", response={"body": "\x00", "headers": [["content-type", "image/png"]]}), make_entry("f", response={"body": "{", "headers": JSON_TYPE}), make_entry("g", response={"body": {"k": [1]}}),
    ])
    got = [tuple(r) for r in bodyquery.query_bodies(df, ".k[]", "jq").select("entry_id", "status", "pos", "value").where("status in ('value', 'skipped')").collect()]
    assert sorted(got, key=str) == sorted([("a", "value", 0, "1"), ("a", "value", 1, '"x"'), ("g", "value", 0, "1"), ("c", "skipped", None, "not base64"), ("d", "skipped", None, "empty"), ("e", "skipped", None, "binary: image/png")], key=str)
    values = bodyquery.values_of(bodyquery.query_bodies(df, ".k[]", "jq"), deduplicate=True)
    assert rows(values.select("value", "n")) == [('"x"', 1), ("1", 2)]
    assert rows(bodyquery.json_path_values(df, ".k[0]")) == [("a", "1"), ("g", "1")]
    with pytest.raises(ValueError):
        bodyquery.json_path_values(df, ".k[]")
    with pytest.raises(ValueError):
        bodyquery.query_bodies(df, ".k[", "jq")
    assert rows(bodyquery.query_bodies(df, "h1", "css").where("status = 'value'").select("entry_id", "value")) == [("b", '"T"')]


def test_schemas_and_stats(entries_of):
    samples = [{"id": i, "name": f"n{i % 2}", "at": "2024-01-01", "o": {"p": 1}, "arr": [{"q": 1}, {"q": "x"}], **({"opt": None} if i else {})} for i in range(5)]
    df = entries_of([make_entry(f"e{i}", ts=i, response={"body": s}) for i, s in enumerate(samples)])
    (s,) = infer.json_schemas(df).collect()
    schema = json.loads(s["schema"])
    assert (s["sample_count"], s["all_match"]) == (5, False) and schema["required"] == ["arr", "at", "id", "name", "o"]
    got = {r["path"]: r for r in infer.field_stats(df).collect()}
    assert set(got) == {"id", "name", "at", "o", "o.p", "arr", "arr[].q", "opt"}
    assert (got["opt"]["frequency"], got["opt"]["required"], got["opt"]["nullable"], got["opt"]["type"]) == (0.8, False, True, "null")
    assert (got["name"]["format"], got["name"]["distinct_count"], got["at"]["format"]) == ("enum", 2, "iso8601")
    assert got["arr[].q"]["type"] == "integer|string" and got["arr[].q"]["frequency"] == 1.0
    mixed = entries_of([make_entry("x", response={"body": {"o": {"p": 1}}}), make_entry("y", response={"body": {"o": None}})])
    assert {r["path"] for r in infer.field_stats(mixed).collect()} == {"o"}


def test_body_shapes(entries_of):
    csv = {"body": "name,age\nx,1\ny,2\n", "headers": [["content-type", "text/csv"]]}
    df = entries_of([make_entry("a", url="https://h.x/csv", response=csv), make_entry("b", url="https://h.x/xml", response={"body": "<r><i a='1'/><i/></r>", "headers": [["content-type", "text/xml"]]}), make_entry("c", url="https://h.x/txt", response={"body": "t", "headers": [["content-type", "text/plain"]]})])
    got = {r["content_category"]: json.loads(r["shape"]) for r in shapes.body_shapes(df).collect()}
    assert [c["type"] for c in got["csv"]["columns"]] == ["string", "number"] and got["xml"]["root"]["children"][0]["repeated"] and got["text"]["skipped"]


def test_long_pages_and_deep_fields(entries_of):
    page = {"body": "<div>" * 8 + "<p>x</p>" * 300 + "</div>" * 8, "headers": [["content-type", "text/html"]]}
    counts = {r["tag"]: (r["n"], r["n_pages"]) for r in shapes.html_tag_counts(entries_of([make_entry("a", response=page)])).collect()}
    assert counts["p"] == (300, 1) and counts["div"] == (8, 1)
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": 1}}}}}}}}}
    found = {r["path"]: r["type"] for r in infer.field_stats(entries_of([make_entry("a", response={"body": deep})])).collect()}
    assert len(found) == 9 and found["a.b.c.d.e.f.g.h.i"] == "integer"


def test_field_names_with_dots_and_brackets(entries_of):
    body = {"a.b": 1, "a": {"b": "x"}, "c[]": 2, "l": [{"k.[]": True}], "o": {"z": [1, 2]}}
    found = sorted((r["path"], r["type"], r["frequency"]) for r in infer.field_stats(entries_of([make_entry("a", response={"body": body})])).collect())
    assert found == [("a", "object", 1.0), ("a.b", "integer", 1.0), ("a.b", "string", 1.0), ("c[]", "integer", 1.0), ("l", "array", 1.0), ("l[].k.[]", "boolean", 1.0), ("o", "object", 1.0), ("o.z", "array", 1.0)]


def test_field_values_are_told_apart(entries_of):
    bodies = [{"o": {"x": 1, "y": [1, 2]}}, {"o": {"y": [1.0, 2], "x": 1}}, {"o": {"x": 1, "y": [2, 1]}}, {"o": {"x": "1", "y": [1, 2]}}]
    (o,) = (r for r in infer.field_stats(entries_of([make_entry(f"e{i}", ts=i, response={"body": b}) for i, b in enumerate(bodies)])).collect() if r["path"] == "o")
    assert o["distinct_count"] == 3


def test_results_follow_the_latest_delivery(entries_of):
    """Work is done on every delivery, and the latest one's result counts, also if it has none."""
    from datetime import datetime

    def sent(key, day, body, kind="application/json"):
        return make_entry(key, response={"body": body, "headers": [["Content-Type", kind]]}, at=datetime(2025, 1, day))

    df = entries_of([sent("a", 1, {"v": 1}), sent("a", 2, {"v": 2}), sent("b", 1, {"v": 3}), sent("b", 2, "gone", "text/plain"), sent("c", 1, "<p>x</p>", "text/html"), sent("c", 2, "<i>x</i>", "text/html"), sent("a", 2, {"v": 2})])
    assert rows(bodyquery.json_path_values(df, ".v")) == [("a", "2")]
    assert rows(bodyquery.values_of(bodyquery.query_bodies(df, ".v", "jq"))) == [("a", "response", 0, "2")]
    assert rows(bodyquery.regex_values(df, r'"v":\s*(\d)', 1)) == [("a", 0, "2")]
    assert {r["tag"] for r in shapes.html_tag_counts(df).collect()} & {"i", "p"} == {"i"}
    assert rows(search.filtered(df, Filters(body_contains='"v": 1'), ())) == [] and rows(search.body_matches(df, "gone", 0)) == [("b", "https://api.x.example/v1/users/7", "response", "gone")]


def test_body_shapes_hold_all_bodies(entries_of):
    def many(path, kind, body_of, n=30):
        return [make_entry(f"{path}{i:02}", ts=i, url=f"https://h.x/{path}", response={"body": body_of(i), "headers": [["content-type", kind]] if kind and i != 5 else []}) for i in range(n)]

    made = many("j", "application/json", lambda i: {"a": 1} | ({"late": 1} if i == 29 else {}))
    made += many("x", "text/xml", lambda i: "<r><late/></r>" if i == 29 else "<r/>") + many("f", "application/x-www-form-urlencoded", lambda i: "late=1" if i == 29 else "k=1")
    made += many("c", "text/csv", lambda i: "n,s\n" + "1,x\n" * 10 + ("one,y\n" if i == 29 else ""))
    made.append(make_entry("j99", ts=99, url="https://h.x/j", response={"body": "<p>hi</p>", "headers": [["content-type", "text/html"]]}))
    df = entries_of(made)
    found = [(r["content_category"], r["sample_count"], json.loads(r["shape"])) for r in shapes.body_shapes(df.repartition(3)).collect()]
    got = {c: s for c, _, s in found}
    assert sorted((c, n) for c, n, _ in found) == [("csv", 30), ("form", 30), ("html", 1), ("json", 30), ("xml", 30)]
    assert set(got["json"]["schema"]["properties"]) == {"a", "late"} and not got["json"]["all_match"] and got["json"]["schema"]["required"] == ["a"]
    assert got["xml"]["root"]["children"][0]["name"] == "late" and {k["key"]: k["frequency"] for k in got["form"]["form_keys"]} == {"k": 0.966667, "late": 0.033333}
    assert [(c["type"], c["enum_values"], c["examples"]) for c in got["csv"]["columns"]] == [("string", ["1", "one"], ["1", "one"]), ("string", ["x", "y"], ["x", "y"])] and got["csv"]["row_count"] == 301
    assert {r["content_category"]: r["sample_count"] for r in shapes.body_shapes(df, sample=20).collect()} == {"csv": 20, "form": 20, "json": 20, "xml": 20}


def test_validation(entries_of):
    df = entries_of([make_entry("a", response={"body": {"id": "1"}}), make_entry("b", response={"body": {"id": 1}}), make_entry("c", response=None)])
    found = validation.validate_bodies(df, "z.object({ id: z.string() })", "zod")
    assert rows(validation.validation_summary(found)) == [(1, 1, 1, False)]
    assert rows(validation.common_errors(found)) == [("/id: got number, want string", 1)]


def test_graphql(entries_of):
    def post(key, ts, body, answer):
        return make_entry(key, ts=ts, method="POST", headers=JSON_TYPE, body=body, response={"body": answer})

    q = "query Feed($k: Int) { feed { id ... on Post { x } } }"
    df = entries_of([
        post("a", 1, {"query": q, "variables": {"k": 1, "kind": "p"}}, {"data": {"feed": {"__typename": "Post", "id": 1}}}),
        post("b", 2, {"query": q, "variables": {"k": 1, "kind": "q"}}, {"data": {"feed": {"__typename": "Ad"}, "more": 1}}),
        post("c", 3, [{"query": "mutation M { m }"}, {"query": "{ x }"}], [{"data": 1}, {"errors": [{"message": "e"}], "data": None}]),
        post("d", 4, {"query": q, "variables": None}, {"data": None, "errors": [{"message": "e"}]}),
        post("e", 5, {"no": 1}, {}), make_entry("f", method="POST", headers=JSON_TYPE, body="nonsense"),
    ])
    ops = graphql.operations(df).cache()
    assert rows(graphql.operation_clusters(ops)) == [("Feed", "query", 3, 1, True, "feed"), ("M", "mutation", 1, 0, False, "m"), ("anonymous", "query", 1, 1, False, "x")]
    assert rows(graphql.traffic_summary(ops)) == [(5, 4, 1, 0, 1, 1, 3, 1)]
    assert ("Feed", "query", "k", "number", 1, 0, "1=2") in rows(graphql.variable_distributions(ops))
    assert rows(graphql.error_summary(ops))[0] == ("Feed", "query", 3, 1, 1, 0, 1)
    assert rows(graphql.fragment_warnings(ops)) == [("Feed", "query", "data.feed", "Ad")]
    assert {(r["typename"], r["state"]) for r in graphql.fragment_coverage(ops).where("name = 'Feed'").collect()} == {("Post", "matched"), ("Ad", "unmatched")}
    assert {(r["entry_count"], r["discriminating_variable"]) for r in graphql.response_variants(ops).collect()} == {(1, "kind")}


def test_streaming_counts(spark):
    path = f"{DATA}/sf0.001/entries.parquet"
    got = rows(ingest.replay_counts(spark, path))
    table = spark.read.parquet(path)
    assert sum(r[3] for r in got) == table.select("entry_id").distinct().count()
    assert rows(ingest.endpoint_counts(table.dropDuplicates(["entry_id"]))) == got


def test_streaming_in_steps(spark, entries_of, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path / 'work'}"
    first = entries_of([make_entry("a"), make_entry("b")])
    for batch in (first, entries_of([make_entry("b"), make_entry("c")])):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = ingest.first_versions(ingest.entry_stream(spark, source, first.schema), late="7 days")
        ingest.start_counts(ingest.endpoint_counts(stream), folder).awaitTermination()
    assert [r["count"] for r in ingest.current_counts(spark, folder).collect()] == [3]
    assert ingest.time_windows(first).count() == 1


# -- live source ------------------------------------------------------------------


@pytest.fixture(scope="module")
def service():
    keys, failures = [f"k{i}" for i in range(5)], [1, 1]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            parts = self.path.split("?")[0].strip("/").split("/")
            answer: object = None
            if parts == ["sessions"]:
                answer = [{"id": "s1", "name": "one", "entryIds": keys}]
            elif parts[0] == "sessions" and len(parts) == 2:
                answer = {"id": "s1", "name": "one", "entryIds": keys}
            elif parts[:1] == ["sessions"] and parts[2:3] == ["entries"] and len(parts) == 4 and parts[3] != "k3":
                answer = {"id": parts[3], "url": "https://h.x/a", "httpVersion": "h2", "request": {"method": "GET", "headers": [["a", "b"]], "body": b64("x")}, "response": None, "tls": {"connectionId": "c", "ja3": {"hash": "j"}}, "timings": {"startedAt": 5}}
            elif parts == ["sessions", "s1", "bookmarks"]:
                answer = ["k1"]
            elif parts == ["sessions", "s1", "entries"]:
                answer = [{"id": "k2"}] if "selected" in self.path else [{"id": "k0"}, {"id": "k2"}]
            elif parts == ["http2", "c"]:
                answer = [1, 3]
            elif parts[:3] == ["http2", "c", "streams"]:
                answer = [{"type": "HEADERS", "n": int(parts[3])}, {"type": "DATA"}]
            elif parts == ["tls", "c"]:
                answer = [{"side": "client", "msg": {"handshake": {"type": "client_hello"}}}, {"side": "server", "msg": {"type": "alert"}}]
            if parts[-1] == "k4" and failures:
                failures.pop()
                self.send_response(503)
                self.end_headers()
                return
            raw = json.dumps({"error": "nothing here"} if answer is None else answer).encode()
            self.send_response(404 if answer is None else 200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", keys
    server.shutdown()


def test_live_source(spark, service):
    live.register(spark)
    url, _ = service
    df = spark.read.format("capture").option("base_url", url).option("slice", "2").load()
    assert sorted(r["entry_id"] for r in df.collect()) == ["k0", "k1", "k2", "k4"]
    assert spark.read.format("capture").option("base_url", url).option("what", "sessions").load().first()["session_id"] == "s1"
    client = live.CaptureClient(url)
    assert client.http2_streams("c") == [1, 3]
    with pytest.raises(live.SourceError) as e:
        client.tls("nope")
    assert from_source(e.value).code == EngineError.NOT_FOUND and str(e.value) == "nothing here"
    with pytest.raises(ValueError):
        client.entries("s1", highlighted=("mauve",))
    assert live.frame_counts([{"type": "DATA"}, {"type": "DATA"}, {}]) == {"DATA": 2}
    assert live.tls_summary([{"msg": {"handshake": {"type": "client_hello", "version": {"name": "TLS 1.2"}}}}]) == {"tls_version": "TLS 1.2", "cipher_suite": ""}


def test_live_stream_offsets(service):
    assert live.new_keys(["a", "b", "c"], 0, "", 2) == (["b", "c"], True) and live.new_keys(["a", "b", "c"], 0, "") == (["a", "b", "c"], True)
    assert live.new_keys(["a", "b", "c"], 2, "b", 9) == (["c"], False)
    assert live.new_keys(["a"], 2, "b", 9) == (["a"], True)
    assert live.new_keys(["x", "y", "z"], 2, "b", 9) == (["x", "y", "z"], True)
    url, keys = service
    reader = live.CaptureDataSource({"base_url": url, "slice": "2"}).streamReader(None)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) == 3 and end == {"known": 5, "tail": "k4"}
    assert [r[0] for p in parts for r in reader.read(p)] == ["k0", "k1", "k2", "k4"]
    keys.append("k5")
    assert [r[0] for p in reader.partitions(end, reader.latestOffset()) for r in reader.read(p)] == ["k5"]
    keys.pop()


def test_live_stream(spark, service, tmp_path):
    live.register(spark)
    url, keys = service
    stream = spark.readStream.format("capture").option("base_url", url).option("slice", "2").load()
    sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    sink.trigger(once=True).start().awaitTermination(60)
    keys.append("k6")
    sink.trigger(once=True).start().awaitTermination(60)
    keys.pop()
    assert sorted(r["entry_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k0", "k1", "k2", "k4", "k6"]


def test_live_failures_are_tried_again():
    left = [1, 2]

    def flaky():
        if left:
            left.pop()
            raise live.SourceError(503, "busy")
        return "ok"

    assert live.patient(flaky, retries=2, pause=0) == "ok"
    left.extend([1, 2, 3])
    with pytest.raises(live.SourceError):
        live.patient(flaky, retries=2, pause=0)

    def gone():
        raise live.SourceError(404, "none")

    assert live.patient(gone) is None


def test_live_engine(spark, service):
    url, _ = service
    engine = Engine.live(spark, url, "s1")
    assert rows(engine.bookmarked()) == [("s1", "k1")] and rows(engine.listed(selected=True)) == [("s1", "k2")]
    assert [r["entry_id"] for r in engine.search_entries(among=engine.listed()).collect()] == ["k0", "k2"]
    assert [tuple(r)[:4] for r in engine.get_tls("c").collect()] == [("c", 0, "client", "client_hello"), ("c", 1, "server", "alert")]
    assert [tuple(r)[:4] for r in engine.http2_frames("c").collect()] == [("c", 1, 0, "HEADERS"), ("c", 1, 1, "DATA"), ("c", 3, 0, "HEADERS"), ("c", 3, 1, "DATA")]
    assert engine.http2_frames("c", 3).count() == 2 and engine.sessions_list().count() == 1
    with pytest.raises(EngineError):
        Engine(spark, {}).bookmarked()


# -- engine -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.open(spark, f"{DATA}/sf0.001")


def test_engine_tools(engine):
    assert engine.sessions_list().count() == 2
    with pytest.raises(EngineError) as e:
        engine.session_active()
    assert e.value.code == EngineError.INVALID_INPUT
    assert engine.search_entries(limit=3).count() == 3 and "pid" not in engine.search_entries().columns
    key = engine.search_entries(limit=1).first()["entry_id"]
    assert engine.get_entry(key)["entry_id"] == key
    with pytest.raises(EngineError):
        engine.get_entry("none")
    cluster = engine.extract_endpoints(limit=1).first()["cluster_id"]
    assert "endpoints" in engine.endpoints_hint(engine.extract_endpoints(limit=1))
    assert set(engine.describe_endpoint(cluster)) == {"headers", "auth", "query_keys", "request_shape", "response_shape", "examples"}
    assert engine.query_body(".id", cluster).columns == ["entry_id", "target", "pos", "value"]
    with pytest.raises(EngineError):
        engine.query_body(".id")
    with pytest.raises(EngineError):
        engine.validate_schema("nonsense", "zod", cluster)
    shape, stats = engine.infer_schema(cluster)
    assert shape.count() == 1 and "frequency" in stats.columns
    clusters, summary = engine.survey_graphql()
    assert clusters.count() > 0 and summary.count() == 1
    name = clusters.first()["name"]
    assert set(engine.inspect_graphql_operation(name, ["query", "errors"])) == {"query", "errors"}
    two = [r["entry_id"] for r in engine.search_entries(limit=2).collect()]
    assert engine.diff_entries(*two).count() == 1 and engine.fingerprint(two[0]).count() == 1
    assert json.loads(engine.resource(f"wiregrain://entry/s/{key}"))["entry_id"] == key
    assert json.loads(engine.resource("wiregrain://catalog/default"))
    for bad in ("wiregrain://nothing/1", "x", "wiregrain://entry/1", "wiregrain://graphql/s/o/x"):
        with pytest.raises(EngineError):
            engine.resource(bad)


def test_registry(engine):
    @engine.operator("hosts", "host string, n bigint")
    def hosts(e):
        from wiregrain.operators.skew import entry_counts

        return entry_counts(e.entries).groupBy("host").agg(F.sum("n_entries").alias("n"))

    assert engine.call("hosts").count() > 0
    engine.operator("wrong", "x int")(hosts)
    with pytest.raises(EngineError):
        engine.call("wrong")
    with pytest.raises(EngineError):
        engine.operator("hosts", "x int")
    with pytest.raises(EngineError):
        engine.operator("void", "")
    engine.without("hosts")
    with pytest.raises(EngineError):
        engine.call("hosts")


def test_cluster_store(spark, entries_of, tmp_path):
    from wiregrain.sources.store import ClusterStore

    df = entries_of([make_entry(f"e{i}", ts=i, url=f"https://h.x/v{i % 2}/u/{i}") for i in range(6)])
    store = ClusterStore(spark, f"file://{tmp_path}")
    page = catalog.endpoint_page(catalog.endpoint_clusters(df), limit=1)
    store.put("default", page, catalog.cluster_members(df))
    (kept,) = store.scope("default").collect()
    assert [r["entry_id"] for r in store.members("default", kept["cluster_id"]).collect()] == ["e0", "e2", "e4"]


def test_hints():
    from wiregrain import hints

    assert "offset=10" in hints.search(30, 10) and hints.search(5, 5) == "" and "Nothing found" in hints.search(0, 0)
    assert hints.endpoints(3, 2, {"api": 2, "page": 1}, 1).startswith("3 endpoints: 2 api, 1 page.")
    assert "'.'" in hints.query(0, 3, "jq") and "1 bodies failed" in hints.query(2, 3, errors=1)
    assert hints.graphql(["A"], "B") == "Failing operations: A (section 'errors'). inspect_graphql_operation('B') tells more."


def test_config(monkeypatch):
    monkeypatch.setenv("MAX_SEARCH_RESULTS", "7")
    monkeypatch.setenv("INDEX_BODY", "true")
    c = EngineConfig.from_env()
    assert (c.max_search_results, c.index_body, c.fetch_workers) == (7, True, 16)


def test_plans_read_only_what_they_need(spark):
    plan = search.filtered(read_table(spark, f"{DATA}/sf0.001", "entries"), Filters(method="GET"))._jdf.queryExecution().executedPlan().toString()
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line)
    assert "body" not in schema and "headers" not in schema


def test_categories_agree_in_plans_and_tasks(spark):
    """The rules for content types stand once as expressions and once for Arrow batches; both say the same."""
    from wiregrain.functions import bodies, content

    kinds = ["", "text/html; charset=x", "application/xhtml+xml", "TEXT/XML", "image/svg+xml", "application/json;v=1", "application/ld+json", "text/yaml", "application/x-yaml", "text/csv", "text/tab-separated-values", "application/x-www-form-urlencoded", "text/plain", "image/png", "audio/mp3", "application/octet-stream", "application/pdf", "application/zip", "application/javascript", "application/wasm", "Video/mp4"]
    texts = [b"plain", b"\xff\xfe\x00", "é".encode()]
    made = [(k, bytearray(b)) for k in kinds for b in texts]
    df = spark.createDataFrame(made, "kind string, body binary")
    found = df.select("kind", "body", content.classify(F.col("kind")).alias("category"), content.is_binary(F.col("kind"), F.col("body")).alias("is_binary")).collect()
    assert [(r["category"], r["is_binary"]) for r in found] == [(bodies.category(k), bodies.is_binary(k, bytes(b))) for k, b in made]
