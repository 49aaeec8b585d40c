"""Record-level functions and column expressions on literal cases."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wiregrain.functions import bodies, content, dom, gql, headers, jq, jsonkit, outlines, schemas, text, urls


def column(spark, values, expression, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expression(F.col("v"))).collect()]


def test_url_parts(spark):
    given_urls = ["https://U:p@API.x.example:8443/a%20b/c?q=1#f", "http://h.test", "no url", None, "http://h.test/%zz", "https://h/x?a=b?c"]
    assert column(spark, given_urls, urls.url_host) == ["api.x.example:8443", "h.test", "", "", "", "h"]
    assert column(spark, given_urls, urls.url_path) == ["/a b/c", "", "", "", "", "/x"]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/users/123/posts", "/users/{id}/posts"),
        ("/a/550E8400-e29b-41d4-a716-446655440000", "/a/{uuid}"),
        ("/x/deadBEEF", "/x/{hex}"),
        ("/x/deadbee", "/x/deadbee"),
        ("/x/12345678", "/x/{id}"),
        ("/x/v1", "/x/v1"),
        ("/", "/"),
        ("", ""),
        ("/a/1?b=2", "/a/{id}"),
        ("/a/1\n", "/a/1\n"),
    ],
)
def test_path_template(spark, path, want):
    assert column(spark, [path], urls.path_template) == [want]


def test_tokens(spark):
    assert column(spark, ["GET /v1/Users?id=7&x=ab\u00a0cd"], text.tokens) == [["get", "v1", "users", "id", "ab", "cd"]]
    assert column(spark, ["http://h.ex/a%20b?k=v%31&k2"], text.url_tokens) == [["ex", "v1", "k2"]]
    assert text.ask("A bb.cc") == ["bb", "cc"]


def test_headers(spark):
    h = [["Cookie", "sid=1; x=2;sid=3; =4; bad"], ["COOKIE", "z"], ["x"], [], ["X-Api-Key", "k"]]
    df = spark.createDataFrame([(h,), (None,)], "h array<array<string>>")
    got = df.select(
        headers.first_value(F.col("h"), "cookie"), headers.names(F.col("h")), headers.api_keys(F.col("h")), headers.session_cookies(headers.first_value(F.col("h"), "cookie"))
    ).collect()
    assert got[0][0] == "sid=1; x=2;sid=3; =4; bad"
    assert got[0][1] == ["cookie", "x", "x-api-key"]
    assert [tuple(x) for x in got[0][2]] == [("x-api-key", "k")]
    assert [tuple(x) for x in got[0][3]] == [("sid", "3")]
    assert got[1][0] == "" and got[1][1] == [] and got[1][3] == []


def test_body_bytes(spark):
    assert column(spark, ["aGVsbG8=", "", None, "abc*"], headers.body_bytes) == [5, 0, 0, 3]


@pytest.mark.parametrize(("kind", "want"), [("application/json; charset=x", "json"), ("text/html", "html"), ("image/svg+xml", "xml"), ("text/csv", "csv"), ("application/x-www-form-urlencoded", "form"), ("text/plain", "text"), ("image/png", "binary"), ("", "binary"), ("application/x-yaml", "yaml")])
def test_content_category(spark, kind, want):
    assert column(spark, [kind], content.classify) == [want]
    assert bodies.category(kind) == want


@pytest.mark.parametrize(
    ("template", "kind", "want"),
    [("/a/app.js", "text/html", "asset"), ("/x", "image/png", "asset"), ("/x", "application/json", "api"), ("/x", "text/html", "page"), ("/x", "text/csv", "data"), ("/api/x", "", "api"), ("/_next/x", "", "asset"), ("/x", "", "other"), ("/a/{id}", "", "other"), ("/x", "text/css", "asset")],
)
def test_endpoint_category(spark, template, kind, want):
    df = spark.createDataFrame([(template, kind)], "t string, k string")
    assert df.select(content.endpoint_category(F.col("t"), F.col("k"))).first()[0] == want


JQ = [
    (".name", {"name": "John", "age": 30}, ["John"]),
    (".items[].name", {"items": [{"name": "a"}, {"name": "b"}]}, ["a", "b"]),
    (".items[] | select(. > 2)", {"items": [1, 2, 3, 4, 5]}, [3, 4, 5]),
    (".a[1:3], .a[-1]", {"a": [1, 2, 3, 4]}, [[2, 3], 4]),
    ("{a: .x, b, (\"c\"): 3}", {"x": 1, "b": 2}, [{"a": 1, "b": 2, "c": 3}]),
    ("[.[] | .a?]", [{"a": 1}, 3], [[1]]),
    ("map(.a) | add", [{"a": 1}, {"a": 2}], [3]),
    ("with_entries(.value += 1)", {"a": 1}, [{"a": 2}]),
    (".a // \"d\"", {}, ["d"]),
    ("if .a > 1 then \"x\" elif .a == 1 then \"y\" else \"z\" end", {"a": 1}, ["y"]),
    ("reduce .[] as $x (0; . + $x)", [1, 2, 3], [6]),
    ("[foreach .[] as $x (0; . + $x; [$x, .])]", [1, 2], [[[1, 1], [2, 3]]]),
    ("\"n: \\(.a + 1)!\"", {"a": 1}, ["n: 2!"]),
    (".. | numbers", {"a": [1, {"b": 2}]}, [1, 2]),
    (".a |= . + 1 | .b = 5 | del(.c)", {"a": 1, "c": 3}, [{"a": 2, "b": 5}]),
    ("group_by(.a) | map(length)", [{"a": 1}, {"a": 2}, {"a": 1}], [[2, 1]]),
    ("def f(x): x * 2; def g($y): $y + 1; f(.a), g(.a)", {"a": 4}, [8, 5]),
    (". as [$a, {b: $c}] | $a + $c", [1, {"b": 2}], [3]),
    ("try error(\"x\") catch .", None, ["x"]),
    ("[limit(2; range(10))]", None, [[0, 1]]),
    ("[paths]", {"a": {"b": 1}}, [[["a"], ["a", "b"]]]),
    ("label $out | .[] | if . > 1 then ., break $out else . end", [1, 2, 3], [1, 2]),
    ("@base64, (@uri \"a=\\(.)\")", "h i", ["aCBp", "a=h%20i"]),
    ("[.[] | tostring] | join(\",\")", [1, "a", None], ["1,a,null"]),
    ("unique_by(.a) | length", [{"a": 1}, {"a": 1}], [1]),
    ("[match(\"(b)(c)\"; \"g\").captures[].string]", "abc abc", [["b", "c", "b", "c"]]),
    ("gsub(\"a\"; \"o\")", "banana", ["bonono"]),
    ("to_entries[] | select(.value > 1) | .key", {"a": 1, "b": 2}, ["b"]),
    ("any(.[]; . > 2), all(. > 0)", [1, 3], [True, True]),
    ("[.[] | (.a, .b)] | sort", [{"a": 2, "b": 1}], [[1, 2]]),
    ("walk(if type == \"number\" then . + 1 else . end)", [1, {"a": 2}], [[2, {"a": 3}]]),
    ("null", {}, []),
]


@pytest.mark.parametrize(("expression", "value", "want"), JQ)
def test_jq(expression, value, want):
    assert jq.run_jq(jq.compile_jq(expression), value) == (want, [])


@pytest.mark.parametrize("expression", [".a[", "nosuch", "{a", "if . then 1", ".a |", "1 +", "\"open", "foo(1)"])
def test_jq_rejects(expression):
    with pytest.raises(jq.JqSyntaxError):
        jq.compile_jq(expression)


def test_jq_runtime_errors():
    assert jq.run_jq(jq.compile_jq(".[] | .a"), [{"a": 1}, 3]) == ([1], ['cannot index number with "a" (no such member, or a value of another type)'])
    assert "nothing stands" in jq.run_jq(jq.compile_jq(".a[]"), {})[1][0]


HTML = '<h1 class="title">A</h1><div class="content"><span>x</span><p>p1<p>p2</div><h1 class="title big">B</h1><script>var t="</p>"</script><ul><li>1<li>2</ul>'


@pytest.mark.parametrize(
    ("selector", "want"),
    [("h1.title", ["A", "B"]), ("div.content > span", ["x"]), ("p", ["p1", "p2"]), ("li:nth-child(2)", ["2"]), ("[class~=big], span", ["x", "B"]), ("h1 ~ ul li:first-child", ["1"]), ("h1:not(.big)", ["A"]), ("div:has(span) p", ["p1", "p2"]), ("bad[", []), ("", [])],
)
def test_css(selector, want):
    assert dom.css_texts(dom.parse_html(HTML), selector) == want


XML = '<c xmlns:n="u"><item id="1"><title>T1</title><price>5</price></item><item id="2"><title>T2</title><price>9</price></item><n:x>z</n:x></c>'


@pytest.mark.parametrize(
    ("expression", "want"),
    [("//item/title", ["T1", "T2"]), ("/c/item[1]/title", ["T1"]), ("//item[price > 6]/title", ["T2"]), ("//@id", ["1", "2"]), ("//item[@id='2']/price | //title", ["T1", "T2", "9"]), ("//item[last()]/title/text()", ["T2"]), ("//price/../title", ["T1", "T2"]), ("//title[contains(., '2')]", ["T2"]), ("//n:x", ["z"]), ("//nothing", [])],
)
def test_xpath(expression, want):
    assert dom.xpath_texts(dom.parse_xml(XML), expression) == want


def test_xpath_errors():
    with pytest.raises(ValueError):
        dom.xpath_texts(dom.parse_xml(XML), "//item[")
    with pytest.raises(ValueError):
        dom.parse_xml("<a>")
    assert dom.xpath_texts(dom.parse_html(HTML), "//div/p[2]") == ["p2"]


def test_extractor():
    form = b"username=john&email=john%40x.example&role=admin&role=editor"
    assert bodies.Extractor("role", "form")(form, "") == ("form", ["admin", "editor"], [])
    assert bodies.Extractor("*")(form, "application/x-www-form-urlencoded")[1] == [{"username": "john", "email": "john@x.example", "role": ["admin", "editor"]}]
    assert bodies.Extractor(".a[1].b")(b"a:\n- 1\n- b: 2\n", "text/yaml")[1] == [2]
    assert bodies.Extractor(r"id=(\d+)", "regex")(b"id=1 id=22", "")[1] == ["1", "22"]
    with pytest.raises(ValueError):
        bodies.Extractor("(", "regex")
    with pytest.raises(ValueError):
        bodies.Extractor("x", "sql")


@pytest.mark.parametrize(
    ("kind", "body", "want"),
    [
        ("application/json", b'{"ab": ["Cd-ef", 12, {"gh": true}]}', ["ab", "cd", "ef", "gh"]), ("application/json", b'{"ab', ['{"ab']), ("text/html", b"<p class=x>Hi there</p>", ["hi", "there"]),
        ("application/x-www-form-urlencoded", b"aa=b%20cc&dd=", ["aa", "cc", "dd"]), ("text/plain", b"one two", ["one", "two"]), ("image/png", b"abc", []), ("text/plain", None, []), ("text/csv", b"xx,yy", ["xx", "yy"]),
    ],
)
def test_body_tokens(kind, body, want):
    assert sorted(bodies.body_tokens(body, kind)) == sorted(want)


def test_compact():
    assert bodies.compact([1, 2, 3, 4, 5]) == [1, 2, 3, "... (2 more items)"]
    assert bodies.compact({"a": "x" * 600})["a"] == "x" * 500 + "... (100 more chars)"
    assert bodies.compact({"a": {"b": 1}}, depth=1) == {"a": "[max depth]"}
    assert bodies.truncate_utf8("aé", 2) == "a"
    assert bodies.display(b"\x89PNG", "image/png") == "[binary content, 4 bytes]"


def test_shapes_merge_in_any_order():
    values = [{"id": 1, "a": [1, "x"]}, {"id": 2.5}, {"id": None, "z": [{"q": 1}, {}]}, {"id": 3, "a": []}]
    forward, backward = schemas.Shape(), schemas.Shape()
    for v in values:
        forward.merge(schemas.Shape.of(v))
    for v in reversed(values):
        backward.merge(schemas.Shape.of(v))
    assert forward.schema() == backward.schema()
    assert forward.schema()["properties"]["a"]["items"] == {"anyOf": [{"type": "integer"}, {"type": "string"}]}
    assert schemas.Shape.load(json.loads(json.dumps(forward.dump()))).schema() == forward.schema()


def test_struct_schema():
    s, warnings = schemas.parse_structs('type A struct {\n ID int `json:"id"`\n Name *string `json:"name,omitempty"`\n Raw []byte\n Skip int `json:"-"`\n Bs []B\n M map[string]int\n}\ntype B struct { X float64 }')
    assert s["required"] == ["id", "raw", "bs", "m"] and set(s["properties"]) == {"id", "name", "raw", "bs", "m"}
    assert s["properties"]["bs"]["items"] == {"$ref": "#/$defs/B"} and len(warnings) == 1
    assert schemas.validate('{"id": 1, "raw": 5, "bs": [{"x": "no"}], "m": {}}', s) == ["/bs/0/x: got string, want number"]
    with pytest.raises(schemas.SchemaTextError):
        schemas.parse_structs("type A struct { X any }")


def test_builder_schema():
    s = schemas.parse_builder('z.object({ id: z.number().int().min(1), n: z.string().optional(), t: z.array(z.string()), u: z.union([z.string(), z.null()]), "e-e": z.enum(["a", "b"]).nullable() })')
    assert s["required"] == ["e-e", "id", "t", "u"]
    assert schemas.validate('{"id": 1, "t": [], "u": null, "e-e": null}', s) == []
    assert schemas.validate('{"id": "x", "t": [1], "u": 2, "e-e": "a"}', s) == ["/id: got string, want number", "/t/0: got number, want string", "/u: got number, want string", "/u: got number, want null"]
    for bad in ("z.any()", "z.date()", "z.object({a z.string()})", "q.string()", "z.record(z.string(), z.number())"):
        with pytest.raises(schemas.SchemaTextError):
            schemas.parse_builder(bad)


def test_json_schema():
    s = schemas.parse_schema('{"type":"object","properties":{"name":{"type":"string","minLength":9},"age":{"type":"integer"}},"required":["name"],"additionalProperties":false}', "json_schema")
    assert schemas.validate('{"name": "a", "age": 2.0}', s) == []
    assert schemas.validate('{"age": "x", "b": 1}', s) == ["missing property 'name'", "/age: got string, want integer", "additional properties 'b' not allowed"]
    assert schemas.validate("{", s)[0].startswith("invalid JSON")
    with pytest.raises(schemas.SchemaTextError):
        schemas.parse_schema('{"type": ["string", "null"]}', "json_schema")


def test_graphql_parsing():
    ops, batch = gql.parse_request('[{"query": "query A($x: Int) { user(id: $x) { id ...F } b: items @include(if: true) { z } ... on Q { k } }"}, {"operationName": "Z"}]')
    assert batch and (ops[0].name, ops[0].type, ops[0].fields) == ("A", "query", ["user", "b", "items"])
    assert (ops[1].name, ops[1].type, ops[1].parse_failed) == ("Z", "query", False)
    assert gql.parse_request('{"query": ""}') is None and gql.parse_request("[]") is None and gql.parse_request("x") is None
    assert gql.parse_request('{"query": "mutation { a }"}')[0][0].name == "anonymous"
    assert [(f.name, f.on_type, f.is_inline, f.fields) for f in gql.fragments("query { a { ... on T { x } ...N } } fragment N on U { k l }")] == [("", "T", True, ["x"]), ("N", "U", False, ["k", "l"])]
    assert gql.error_flags([{"errors": [1]}, {"data": 1}]) == [True, False]
    assert gql.typed_objects({"data": {"a": [{"__typename": "X"}, {"__typename": "Y", "id": 1}]}}) == [("data.a[0]", "X", True), ("data.a[1]", "Y", False)]
    assert gql.response_shape({"data": {"a": {"b": {"c": {"d": 1}}}}}) == ["a", "a.b", "a.b.c"]


def test_outlines():
    merged = outlines.xml_outline('<a x="1"><b><c/></b><b/></a>').merge(outlines.xml_outline('<a y="2"><d/></a>'))
    assert merged.dump()["attributes"] == ["x", "y"] and [c["name"] for c in merged.dump()["children"]] == ["b", "d"]
    h = outlines.HtmlOutline.of('<title>T</title><form action="/x" method="post"><input name="a" type="text"><select name="s"></select></form><p id="q">')
    assert h.title == "T" and h.forms == [{"action": "/x", "method": "POST", "inputs": [{"name": "a", "type": "text"}, {"name": "s", "type": "select"}]}] and h.ids == {"q": "p"}
    names, data, header = outlines.csv_table("1,2\n3,4\n")
    assert (names, len(data), header) == (["col_0", "col_1"], 2, False)
    cols = outlines.csv_columns(*outlines.csv_table("name,age,on\nx,1,true\ny,,false\n")[:2])
    assert [(c["type"], c["empty_frequency"]) for c in cols] == [("string", 0.0), ("number", 0.5), ("boolean", 0.0)]
    assert outlines.text_format(["2024-01-01"] * 5)[0] == "iso8601" and outlines.text_format(["a"] * 5) == ("enum", ["a"]) and outlines.text_format(["a"] * 4) == ("", [])


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab/~{[", max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab/~*", max_size=2), c, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(json_values)
def test_iterative_parser_agrees(value):
    text_of = json.dumps(value)
    assert jsonkit._iterative(text_of) == value
    assert json.loads(jsonkit.canonical(value)) == value


@pytest.mark.parametrize("bad", ["", "{", "[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "nul", "1 2", "]", '{"a":}', "[}", "NaN"])
def test_parsers_reject(bad):
    with pytest.raises(ValueError):
        jsonkit.parse_json(bad)
    with pytest.raises(ValueError):
        jsonkit._iterative(bad)


def test_deep_json():
    deep = "[" * 30_000 + "]" * 30_000
    assert isinstance(jsonkit.parse_json(deep), list)
