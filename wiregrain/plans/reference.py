"""Registered queries of the traffic analytics, and DuckDB SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalog, compare, flow, meta, search
from ..operators.search import Filters
from ..sources.tables import read_table, ship_package

Query = Callable[[SparkSession, str], DataFrame]

SEED = "e0000000100"


def on(operator: Callable[..., DataFrame], *names: str) -> Query:
    """A query that reads the named tables (default: entries) and hands them to an operator."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(*[read_table(spark, sf_dir, n) for n in names or ("entries",)])

    return query


def _filter(f: Filters) -> Query:
    return on(lambda e: search.filtered(e, f))


FILTERS: dict[str, tuple[Filters, str]] = {
    "filter_host_exact": (Filters(host="WWW.mirgor.test"), "host = 'www.mirgor.test'"),
    "filter_host_wildcard": (Filters(host="*.silkesplin.test"), "(host = 'silkesplin.test' or host like '%.silkesplin.test')"),
    "filter_method": (Filters(method="POST"), "method = 'POST'"),
    "filter_status": (Filters(status=404), "status = 404"),
    "filter_http_version": (Filters(http_version="h2"), "http_version = 'h2'"),
    "filter_process_name": (Filters(process_name="node"), "process_name = 'node'"),
    "filter_pid": (Filters(pid=1179), "pid = 1179"),
    "filter_header_name": (Filters(header_name="X-Feature-Tags"), "list_contains(header_names, 'x-feature-tags')"),
    "filter_header_value": (Filters(header_value=("Accept-Encoding", "gzip, br")), "len(list_filter(header_pairs, lambda h: h.name = 'accept-encoding' and h.value = 'gzip, br')) > 0"),
    "filter_tls_connection": (Filters(tls_connection_id="tls-00-0000000"), "tls_connection_id = 'tls-00-0000000'"),
    "filter_h2_connection": (Filters(h2_connection_id="h2-00-0000350"), "h2_connection_id = 'h2-00-0000350'"),
    "filter_ja3": (Filters(ja3="cca3cd0ea4cc507c753b9c324b77f6c4"), "ja3 = 'cca3cd0ea4cc507c753b9c324b77f6c4'"),
    "filter_ja4": (Filters(ja4="t13dcca3cd0ea4cc"), "ja4 = 't13dcca3cd0ea4cc'"),
    "filter_time_range": (Filters(since_ms=1737014400000, until_ms=1737100800000), "ts_ms >= 1737014400000 and ts_ms <= 1737100800000"),
    "filter_time_window": (Filters(time_window_ms=86_400_000, now_ms=1737200000000), "ts_ms >= 1737113600000 and ts_ms <= 1737200000000"),
    "filter_path_contains": (Filters(path_contains="/REVIEWS/"), "contains(lower(path), '/reviews/')"),
    "filter_url_contains": (Filters(url_contains="Limit=8"), "contains(lower(url), 'limit=8')"),
    "filter_header_contains": (Filters(header_contains="user-agent: browser"), "len(list_filter(header_pairs, lambda h: contains(lower(concat(h.name, ': ', coalesce(h.value, ''))), 'user-agent: browser'))) > 0"),
    "filter_body_contains": (Filters(body_contains='"COLOR":"mauve"'), """(coalesce(contains(lower(req_text), '"color":"mauve"'), false) or coalesce(contains(lower(resp_text), '"color":"mauve"'), false))"""),
    "filter_combined": (
        Filters(host="*.test", method="GET", status=200, header_name="cookie", path_contains="/v", session_id="s00-0000"),
        "(host = 'test' or host like '%.test') and method = 'GET' and status = 200 and list_contains(header_names, 'cookie') and contains(lower(path), '/v') and session_id = 's00-0000'",
    ),
}

_PAIRS = "coalesce(list_transform(list_filter({h}, lambda p: len(p) >= 2), lambda p: {{'name': lower(p[1]), 'value': p[2]}}), [])"
_NAMES = "coalesce((select list(n order by i) from (select n, min(i) as i from (select unnest(list_transform(list_filter({h}, lambda p: len(p) >= 1), lambda p: lower(p[1]))) as n, generate_subscripts(list_filter({h}, lambda p: len(p) >= 1), 1) as i) group by n)), [])"
_FIRST = "coalesce(list_filter({p}, lambda h: h.name = '{n}')[1].value, '')"
_SIZE = "case when coalesce(length({b}), 0) = 0 then 0 else coalesce(octet_length(try(from_base64({b}))), cast(floor(length({b}) * 3 / 4) as bigint) - case when {b} like '%==' then 2 when {b} like '%=' then 1 else 0 end) end"
_SESSION = "(lower({c}) in ('jsessionid', 'phpsessid', 'asp.net_sessionid', 'connect.sid', '_session', '_session_id') or regexp_matches(lower({c}), 'session|sid|auth|token|jwt'))"


def _cookie(text: str) -> str:
    return f"{{'name': case when instr({text}, '=') > 1 then trim(substr({text}, 1, instr({text}, '=') - 1)) end, 'value': trim(substr({text}, instr({text}, '=') + 1))}}"


_LAST = "list_filter({l}, lambda x, i: len(list_filter({l}[i + 1:], lambda y: y.name = x.name)) = 0)"


META_SQL = f"""latest as (
  select * from entries where entry_id is not null qualify row_number() over (partition by entry_id order by ingested_at desc) = 1
), flat as (
  select entry_id, session_id, coalesce(timings.started_at, 0) as ts_ms, coalesce(request.method, '') as method, coalesce(url, '') as url,
    lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) as host,
    url_decode(replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '+', '%2B')) as path,
    coalesce(response.status_code, 0) as status, coalesce(http_version, '') as http_version, coalesce(process.name, '') as process_name, coalesce(process.pid, 0) as pid,
    coalesce(tls.connection_id, '') as tls_connection_id, coalesce(tls.ja3_hash, '') as ja3, coalesce(tls.ja4_hashed, '') as ja4,
    coalesce(http2.connection_id, '') as h2_connection_id, coalesce(http2.stream_id, 0) as h2_stream_id, http2 is not null as is_http2,
    {_SIZE.format(b='request.body')} as req_body_bytes, {_SIZE.format(b='response.body')} as resp_body_bytes,
    try(from_base64(request.body)) as req_raw, try(from_base64(response.body)) as resp_raw,
    try(decode(from_base64(request.body))) as req_text, try(decode(from_base64(response.body))) as resp_text,
    {_PAIRS.format(h='request.headers')} as request_pairs, {_PAIRS.format(h='response.headers')} as response_pairs,
    list_concat(list_distinct(list_transform(list_filter(coalesce(request.headers, []), lambda p: len(p) >= 1), lambda p: lower(p[1]))),
      list_distinct(list_transform(list_filter(coalesce(response.headers, []), lambda p: len(p) >= 1), lambda p: lower(p[1])))) as header_names
  from latest
), meta as (
  select *, list_concat(request_pairs, response_pairs) as header_pairs,
    array_to_string(list_transform(string_split(string_split(path, '?')[1], '/'), lambda s:
      case when regexp_full_match(lower(s), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') then '{{uuid}}'
           when regexp_full_match(s, '[0-9]+') then '{{id}}' when regexp_full_match(lower(s), '[0-9a-f]{{8,}}') then '{{hex}}' else s end), '/') as path_template,
    {_FIRST.format(p='request_pairs', n='authorization')} as auth_header,
    trim(lower(string_split({_FIRST.format(p='response_pairs', n='content-type')}, ';')[1])) as resp_content_type,
    list_filter(list_transform(string_split({_FIRST.format(p='request_pairs', n='cookie')}, ';'), lambda c: {_cookie('trim(c)')}), lambda c: c.name is not null and {_SESSION.format(c='c.name')}) as cookies_all,
    list_filter(request_pairs, lambda h: h.name in ('x-api-key', 'x-auth-token', 'x-access-token')) as api_keys_all,
    list_filter(list_transform(list_filter(response_pairs, lambda h: h.name = 'set-cookie'), lambda h:
      {{'name': case when instr(h.value, '=') > 1 then trim(substr(h.value, 1, instr(h.value, '=') - 1)) end, 'value': trim(string_split(substr(h.value, instr(h.value, '=') + 1), ';')[1])}}),
      lambda c: c.name is not null and {_SESSION.format(c='c.name')}) as set_cookies_all
  from flat
), m as (
  select *, {_LAST.format(l='cookies_all')} as cookies, {_LAST.format(l='api_keys_all')} as api_keys, {_LAST.format(l='set_cookies_all')} as set_cookies from meta
)"""


def sql(body: str, extra: str = "") -> str:
    return f"with {META_SQL}{extra}\n{body}"


_SUMMARY = ", ".join(["entry_id", *meta.SUMMARY])
_DELIM = r"[/?&=.\-_:;,@\s]+"
_TOKENS = "list_filter(regexp_split_to_array(lower({t}), '" + _DELIM + "'), lambda t: strlen(t) >= 2)"
_QPAIRS = (
    "list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not contains(p, ';')), "
    "lambda p: {'key': url_decode(replace(case when instr(p, '=') > 0 then substr(p, 1, instr(p, '=') - 1) else p end, '+', ' ')), "
    "'value': url_decode(replace(case when instr(p, '=') > 0 then substr(p, instr(p, '=') + 1) else '' end, '+', ' '))})"
)
_URL_TOKENS = _TOKENS.format(t=f"concat_ws(' ', host, path, array_to_string(flatten(list_transform({_QPAIRS}, lambda q: [q.key, q.value])), ' '))")
_HEAD_TOKENS = _TOKENS.format(t="array_to_string(list_transform(header_pairs, lambda h: concat(h.name, ': ', coalesce(h.value, ''))), ' ')")


def _classify(c: str) -> str:
    return (
        f"case when contains({c}, 'json') then 'json' when {c} in ('text/html', 'application/xhtml+xml') then 'html' when contains({c}, 'xml') then 'xml' when contains({c}, 'yaml') then 'yaml' "
        f"when {c} in ('text/csv', 'text/tab-separated-values') then 'csv' when {c} = 'application/x-www-form-urlencoded' then 'form' when {c} like 'text/%' then 'text' else 'binary' end"
    )


_CATEGORY = f"""case
  when not (regexp_extract(lower(path_template), '([^/]*)$', 1) like '{{%') and regexp_extract(regexp_extract(lower(path_template), '([^/]*)$', 1), '\\.([^.]*)$', 1)
    in ('js','mjs','cjs','css','png','jpg','jpeg','gif','svg','ico','webp','avif','woff','woff2','ttf','eot','otf','map','mp4','webm','mp3','ogg','pdf') then 'asset'
  when hint <> '' and ({_classify('hint')} = 'binary' or regexp_matches(lower(hint), 'javascript|css')) then 'asset'
  when hint <> '' and {_classify('hint')} in ('json', 'xml', 'yaml') then 'api' when hint <> '' and {_classify('hint')} = 'html' then 'page' when hint <> '' and {_classify('hint')} in ('csv', 'form') then 'data'
  when regexp_matches(path_template, '(?i)^/(api|graphql|rest|v\\d+)(/|$)') then 'api'
  when regexp_matches(lower(path_template), '/static/|/assets/|/dist/|/bundle|/_next/|/chunks/') then 'asset' else 'other' end"""

_CLUSTERS = f""", typed as (
  select host, method, path_template, resp_content_type, count(*) as n from m group by all
), hints as (
  select host, method, path_template, coalesce(first(resp_content_type order by n desc, resp_content_type) filter (resp_content_type <> ''), '') as hint from typed group by all
), stats as (
  select host, method, path_template, count(*) as count,
    count(*) filter (status between 100 and 199) as c1, count(*) filter (status between 200 and 299) as c2, count(*) filter (status between 300 and 399) as c3,
    count(*) filter (status between 400 and 499) as c4, count(*) filter (status between 500 and 599) as c5, count(*) filter (status <> 0 and (status < 100 or status >= 600)) as c0,
    cast(sum(resp_body_bytes) as bigint) // count(*) as avg_resp_bytes,
    bool_or(auth_header <> '' or len(cookies) > 0 or len(api_keys) > 0) as has_auth
  from m group by all
), endpoint as (
  select substr(sha256(concat(host, chr(0), method, chr(0), path_template)), 1, 12) as cluster_id, host, method, path_template, count, {_CATEGORY} as category,
    concat_ws(',', case when c1 > 0 then '1xx=' || c1 end, case when c2 > 0 then '2xx=' || c2 end, case when c3 > 0 then '3xx=' || c3 end, case when c4 > 0 then '4xx=' || c4 end, case when c5 > 0 then '5xx=' || c5 end, case when c0 > 0 then 'other=' || c0 end) as status_profile,
    round((c1 + c3 + c4 + c5 + c0) / count, 6) as error_rate, avg_resp_bytes, has_auth, hint as content_type_hint
  from stats join hints using (host, method, path_template)
)"""

_SAMPLE = """, placed as (
  select *, substr(sha256(concat(host, chr(0), method, chr(0), path_template)), 1, 12) as cluster_id,
    row_number() over (partition by host, method, path_template order by ts_ms, entry_id) as place, count(*) over (partition by host, method, path_template) as n_all from m
), sample as (
  select *, least(n_all, 5) as n_sample from placed where place <= 5
)"""


def _pairs_diffs(entries: DataFrame, hellos: DataFrame) -> DataFrame:
    return compare.diffs(entries, compare.neighbour_pairs(entries), hellos)


def _all_edges(entries: DataFrame) -> DataFrame:
    return flow.flow_edges(flow.flow_nodes(entries), per_session=True)


def _traced(part: int, limit: int) -> Callable[[DataFrame], DataFrame]:
    def run(entries: DataFrame) -> DataFrame:
        out = flow.trace(entries, SEED, limit=limit)[part]
        return out.select("entry_id", "ts_ms", "host") if part == 0 else out

    return run


QUERIES: dict[str, Query] = {
    "sessions_list": on(meta.sessions_list, "sessions"),
    "session_entries": on(meta.session_entries, "sessions", "entries"),
    "entries_meta": on(meta.entries_meta),
    "header_rows": on(meta.header_rows),
    "credentials": on(meta.credentials),
    "content_kinds": on(meta.content_kinds),
    "path_templates": on(catalog.path_templates),
    "status_classes": on(catalog.status_classes),
    "url_token_counts": on(meta.url_token_counts),
    "header_token_counts": on(meta.header_token_counts),
    "body_token_counts": on(search.body_token_counts),
    **{k: _filter(f) for k, (f, _) in FILTERS.items()},
    "search_tokens_and": on(lambda e: search.search(e, "reviews json", limit=None).select("entry_id", "url")),
    "search_scores": on(lambda e: search.search(e, "json v2 reviews", Filters(method="GET", header_name="cookie"), limit=None).select("entry_id", "score", "highlights", "matched_in")),
    "search_scored_topk": on(lambda e: search.search(e, "gzip v2", Filters(method="GET"), limit=20).select("entry_id", "score")),
    "search_body_matches": on(lambda e: search.body_matches(e, "mauve")),
    "search_body_index": on(lambda e: search.search(e, "mauve", limit=None, body_index=True).select("entry_id", "score", "matched_in")),
    "endpoint_clusters": on(catalog.endpoint_clusters),
    "endpoint_page": on(lambda e: catalog.endpoint_page(catalog.endpoint_clusters(e), limit=15).select("cluster_id", "count", "total_count")),
    "endpoint_scoped": on(lambda e: catalog.endpoint_clusters(e, catalog.Scope(host="*.test", method="get"), min_count=3, category="api")),
    "endpoint_raw_paths": on(lambda e: catalog.endpoint_clusters(e, normalize_ids=False).select("host", "method", "path_template", "count")),
    "endpoint_categories": on(lambda e: catalog.category_counts(catalog.endpoint_clusters(e))),
    "endpoint_members": on(catalog.cluster_members),
    "endpoint_examples": on(catalog.cluster_examples),
    "describe_headers": on(catalog.header_frequency),
    "describe_auth": on(catalog.auth_signals),
    "describe_query_keys": on(catalog.query_keys),
    "flow_related": on(lambda e: flow.related(flow.flow_nodes(e), SEED).select("entry_id", "ts_ms", "host")),
    "flow_related_wide": on(lambda e: flow.related(flow.flow_nodes(e), SEED, window_ms=7_200_000, same_pid=False, same_host=False).select("entry_id", "ts_ms", "host")),
    "flow_trace_edges": on(_traced(1, 50)),
    "flow_pruned_nodes": on(_traced(0, 5)),
    "flow_session_edges": on(_all_edges),
    "flow_edge_summary": on(lambda e: flow.edge_summary(_all_edges(e))),
    "fingerprints": on(compare.fingerprints),
    "diff_neighbours": on(_pairs_diffs, "entries", "tls_client_hellos"),
    "diff_severity": on(lambda e, h: compare.severity_counts(_pairs_diffs(e, h)), "entries", "tls_client_hellos"),
    "diff_header_moves": on(lambda e: compare.header_moves(e, compare.neighbour_pairs(e))),
}

_EDGE_KEYS = """, nodes as ({nodes}), tied as (
  select entry_id, ts_ms, tls_connection_id, h2_connection_id, unnest(list_concat(
    case when tls_connection_id <> '' then [{{'reason': 'same_tls', 'key': tls_connection_id}}] else [] end,
    case when h2_connection_id <> '' then [{{'reason': 'same_h2', 'key': h2_connection_id}}] else [] end,
    case when auth_header <> '' then [{{'reason': 'same_auth', 'key': auth_header}}] else [] end,
    list_transform(api_keys, lambda k: {{'reason': 'same_api_key', 'key': concat(k.name, ':', coalesce(k.value, ''))}}),
    list_transform(cookies, lambda k: {{'reason': 'same_session_cookie', 'key': concat(k.name, ':', coalesce(k.value, ''))}}),
    [{{'reason': 'temporal', 'key': ''}}])) as k, scope from nodes
), chained as (
  select entry_id as from_id, lead(entry_id) over w as to_id, k.reason as reason, tls_connection_id as t1, lead(tls_connection_id) over w as t2, h2_connection_id as h1, lead(h2_connection_id) over w as h2
  from tied window w as (partition by scope, k.reason, k.key order by ts_ms, entry_id)
), setters as (
  select scope, host, c.name as name, min({{'ts': ts_ms, 'id': entry_id}}) as s from (select scope, host, ts_ms, entry_id, unnest(set_cookies) as c from nodes) group by all
), users as (
  select scope, host, c.name as name, ts_ms, entry_id from (select scope, host, ts_ms, entry_id, unnest(cookies) as c from nodes)
), edges as (
  select from_id, to_id, reason from chained where to_id is not null and (reason <> 'temporal' or not ((t1 <> '' and t1 = t2) or (h1 <> '' and h1 = h2)))
  union select s.id, entry_id, 'session_cookie_origin' from users join setters using (scope, host, name) where s.ts < ts_ms and s.id <> entry_id
)"""
_SESSION_EDGES = _EDGE_KEYS.format(nodes="select *, session_id as scope from m")


def _related(window: int, same: bool) -> str:
    near = f"abs(m.ts_ms - s.ts_ms) <= {window // 2}" + (" and m.pid = s.pid and m.host = s.host" if same else "")
    return (
        f"select m.*, '' as scope from m, (select * from m where entry_id = '{SEED}') s where m.entry_id = s.entry_id or (m.tls_connection_id <> '' and m.tls_connection_id = s.tls_connection_id) "
        f"or (m.h2_connection_id <> '' and m.h2_connection_id = s.h2_connection_id) or ({near})"
    )


_DIFF = """, ranked as (
  select *, lead(entry_id) over (partition by session_id, host, method, path_template order by ts_ms, entry_id) as candidate_id from m
), versions as (
  select connection_id, last(version.name order by seen_at, version.name) as client_tls from tls_client_hellos where side = 'client' and connection_id is not null group by 1
), sided as (
  select m.*, coalesce(client_tls, '') as client_tls, list_distinct(list_transform(request_pairs, lambda h: h.name)) as names,
    list_transform(list_filter(request_pairs, lambda h: not h.name like ':%'), lambda h: h.name) as ordered,
    case when is_http2 then list_filter(request_pairs, lambda h: h.name like ':%') else [] end as pseudo, case when is_http2 then h2_stream_id else 0 end as stream
  from m left join versions on connection_id = tls_connection_id
), noise as (select ['date', 'x-request-id', 'x-correlation-id', 'x-trace-id', 'x-amzn-requestid', 'x-amzn-trace-id', 'cf-ray', 'x-cache', 'age', 'expires', 'last-modified', 'etag'] as noisy
), two as (
  select a.entry_id as baseline_id, b.entry_id as candidate_id,
    list_sort(list_filter(a.names, lambda n: not list_contains(b.names, n) and not list_contains(noisy, n))) as missing,
    list_sort(list_filter(b.names, lambda n: not list_contains(a.names, n) and not list_contains(noisy, n))) as extra,
    list_sort(list_filter(a.names, lambda n: list_contains(b.names, n) and not list_contains(noisy, n) and
      list_transform(list_filter(a.request_pairs, lambda h: h.name = n), lambda h: coalesce(h.value, '')) <> list_transform(list_filter(b.request_pairs, lambda h: h.name = n), lambda h: coalesce(h.value, '')))) as changed,
    list_sort(list_filter(a.names, lambda n: list_contains(b.names, n) and list_contains(noisy, n))) as ignored,
    a.ordered <> b.ordered as order_changed, a.http_version <> b.http_version as protocol_changed, a.ja3 <> b.ja3 as ja3_changed, a.ja4 <> b.ja4 as ja4_changed, a.client_tls <> b.client_tls as tls_version_changed,
    (a.is_http2 or b.is_http2) and (a.pseudo <> b.pseudo or a.stream <> b.stream) as http2_changed
  from ranked r join sided a on a.entry_id = r.entry_id join sided b on b.entry_id = r.candidate_id cross join noise
), diffed as (
  select baseline_id, candidate_id, array_to_string(missing, ',') as headers_missing, array_to_string(extra, ',') as headers_extra, array_to_string(changed, ',') as headers_changed, array_to_string(ignored, ',') as headers_ignored,
    order_changed, protocol_changed, ja3_changed, ja4_changed, tls_version_changed, http2_changed,
    case when ja4_changed or protocol_changed or len(missing) + len(extra) >= 3 then 'high'
         when order_changed or len(missing) + len(extra) > 0 or len(changed) > 0 or http2_changed then 'medium' when len(ignored) > 0 then 'low' else 'none' end as severity
  from two
)"""

_SEARCH_BASE = f""", tokened as (
  select *, {_URL_TOKENS} as ut, {_HEAD_TOKENS} as ht from m
)"""


def _search(asked: list[str], where: str, bonus: float, columns: str, tail: str = "") -> str:
    test = " and ".join(f"(list_contains(ut, '{t}') or list_contains(ht, '{t}'))" for t in asked)
    n = len(asked)
    hit = {c: " + ".join(f"cast(list_contains({c}, '{t}') as integer)" for t in asked) for c in ("ut", "ht")}
    marks = "concat_ws(',', " + ", ".join(f"case when list_contains(ut, '{t}') then '{t}' end" for t in asked) + ")"
    return sql(
        f"""select {columns} from (select entry_id, url, {marks} as highlights, concat_ws(',', case when {hit['ut']} > 0 then 'url' end, case when {hit['ht']} > 0 then 'header' end) as matched_in,
round(({hit['ut']}) / {n} * 0.4 + ({hit['ht']}) / {n} * 0.3 + (ts_ms - lo) / case when hi = lo then 1 else hi - lo end * 0.3 + {bonus}, 6) as score
from found, (select min(ts_ms) as lo, max(ts_ms) as hi from found)){tail}""",
        _SEARCH_BASE + f", found as (select * from tokened where {where} and {test})",
    )


_TYPE = "trim(lower(string_split(coalesce(list_filter({p}, lambda h: h.name = 'content-type')[1].value, ''), ';')[1]))"
_BODY_PARTS = rf""", sides as (
  select entry_id, {_TYPE.format(p='request_pairs')} as kind, req_text as t from m where req_text <> '' union all select entry_id, {_TYPE.format(p='response_pairs')}, resp_text from m where resp_text <> ''
), told as (
  select entry_id, {_classify('kind')} as category, t from sides
), nodes as (
  select entry_id, null::varchar as key, json(t) as v from (select * from told where category = 'json' and json_valid(t))
  union all
  select n.entry_id, case when json_type(n.v) = 'OBJECT' then e.key end, e.value from nodes n, json_each(n.v) e where json_type(n.v) in ('OBJECT', 'ARRAY')
), parts as (
  select entry_id, key as part from nodes where key is not null
  union all select entry_id, v->>'$' from nodes where json_type(v) = 'VARCHAR'
  union all select entry_id, t from told where (category = 'json' and not json_valid(t)) or category in ('text', 'csv')
  union all select entry_id, regexp_replace(t, '<[^>]*>', ' ', 'g') from told where category in ('html', 'xml')
  union all select entry_id, url_decode(replace(t, '+', ' ')) from told where category = 'form'
), body_tokens as (
  select distinct entry_id, token from (select entry_id, unnest(regexp_split_to_array(lower(part), '[/?&=.\-_:;,@\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+')) as token from parts) where strlen(token) >= 2
)"""


def _recursive(text: str) -> str:
    return text.replace("with latest", "with recursive latest", 1)


# breadth-first from the seed; within a depth by time, then id
_PRUNED = _EDGE_KEYS.format(nodes=_related(120_000, True)) + f""", steps as (
  select from_id as a, to_id as b from edges union select to_id, from_id from edges
), reached as (
  select '{SEED}' as entry_id, 0 as depth union select b, depth + 1 from reached join steps on a = entry_id where depth < 5
), depths as (
  select entry_id, min(depth) as depth from reached group by entry_id
)"""

ORACLES: dict[str, str] = {
    "body_token_counts": _recursive(sql("select token, count(*) as n_entries from body_tokens group by token", _BODY_PARTS)),
    "search_body_index": _recursive(sql("""select entry_id, round(cast(u as integer) * 0.4 + cast(h as integer) * 0.3 + cast(b as integer) * 0.2 + (ts_ms - lo) / case when hi = lo then 1 else hi - lo end * 0.3 + 0.1, 6) as score,
concat_ws(',', case when u then 'url' end, case when h then 'header' end, case when b then 'body' end) as matched_in from found, (select min(ts_ms) as lo, max(ts_ms) as hi from found)""",
        _BODY_PARTS + _SEARCH_BASE + """, found as (select * from (
  select entry_id, ts_ms, list_contains(ut, 'mauve') as u, list_contains(ht, 'mauve') as h, entry_id in (select entry_id from body_tokens where token = 'mauve') as b from tokened) where u or h or b)""")),
    "flow_pruned_nodes": _recursive(sql("select entry_id, ts_ms, host from depths join nodes using (entry_id) order by depth, ts_ms, entry_id limit 5", _PRUNED)),
    "sessions_list": "select session_id, coalesce(name, '') as name, cast(coalesce(len(entry_ids), 0) as integer) as entry_count from sessions",
    "session_entries": sql("select l.session_id, cast(l.pos as integer) as pos, l.entry_id, m.url, m.status from (select session_id, unnest(entry_ids) as entry_id, generate_subscripts(entry_ids, 1) - 1 as pos from sessions) l join m on m.entry_id = l.entry_id"),
    "entries_meta": sql(f"select {_SUMMARY} from m"),
    "header_rows": sql("""select entry_id, 'request' as side, cast(i - 1 as integer) as pos, h.name as name, h.value as value from (select entry_id, unnest(request_pairs) as h, generate_subscripts(request_pairs, 1) as i from m)
union all select entry_id, 'response', cast(i - 1 as integer), h.name, h.value from (select entry_id, unnest(response_pairs) as h, generate_subscripts(response_pairs, 1) as i from m)"""),
    "credentials": sql("""select entry_id, 'cookie' as kind, c.name as name, c.value as value from (select entry_id, unnest(cookies) as c from m)
union all select entry_id, 'api_key', c.name, c.value from (select entry_id, unnest(api_keys) as c from m) union all select entry_id, 'set_cookie', c.name, c.value from (select entry_id, unnest(set_cookies) as c from m)"""),
    "content_kinds": sql(f"select resp_content_type, {_classify('resp_content_type')} as category, count(*) as n from m group by all"),
    "path_templates": sql("select path_template, count(*) as n from m group by all"),
    "status_classes": sql("select case when status between 100 and 599 then concat(status // 100, 'xx') else 'other' end as status_class, count(*) as n from m where status <> 0 group by all"),
    "url_token_counts": sql(f"select token, count(*) as n from (select unnest({_URL_TOKENS}) as token from m) group by token"),
    "header_token_counts": sql(f"select token, count(*) as n from (select unnest({_HEAD_TOKENS}) as token from m) group by token"),
    **{k: sql(f"select entry_id, url, ts_ms from m where {where}") for k, (_, where) in FILTERS.items()},
    "search_tokens_and": _search(["reviews", "json"], "true", 0.1, "entry_id, url"),
    "search_scores": _search(["json", "v2", "reviews"], "method = 'GET' and list_contains(header_names, 'cookie')", 0.4, "entry_id, score, highlights, matched_in"),
    "search_scored_topk": _search(["gzip", "v2"], "method = 'GET'", 0.2, "entry_id, score", " order by score desc, entry_id limit 20"),
    "search_body_matches": sql("""select entry_id, url, target, substr(body, greatest(place - 50, 1), place - greatest(place - 50, 1) + 55) as snippet from (
select entry_id, url, case when contains(lower(req_text), 'mauve') then 'request' else 'response' end as target, case when contains(lower(req_text), 'mauve') then req_text else resp_text end as body, instr(lower(body), 'mauve') as place
from m where contains(lower(req_text), 'mauve') or contains(lower(resp_text), 'mauve'))"""),
    "endpoint_clusters": sql("select * from endpoint", _CLUSTERS),
    "endpoint_page": sql("select cluster_id, count, least((select count(*) from endpoint), 200) as total_count from endpoint order by count desc, host, method, path_template limit 15", _CLUSTERS),
    "endpoint_scoped": sql("select * from endpoint where (host = 'test' or host like '%.test') and method = 'GET' and count >= 3 and category = 'api'", _CLUSTERS),
    "endpoint_raw_paths": sql("select host, method, string_split(path, '?')[1] as path_template, count(*) as count from m group by all"),
    "endpoint_categories": sql("select category, count(*) as n_clusters, cast(sum(count) as bigint) as n_entries from endpoint group by all", _CLUSTERS),
    "endpoint_members": sql("select cluster_id, place - 1 as place, entry_id from placed", _SAMPLE),
    "endpoint_examples": sql("select cluster_id, place - 1 as place, entry_id from placed where n_all <= 3 or ((place - 1) % (n_all // 3) = 0 and (place - 1) // (n_all // 3) < 3)", _SAMPLE),
    "describe_headers": sql("""select cluster_id, cast(rank as integer) as rank, name, round(n / n_sample, 6) as frequency from (select cluster_id, n_sample, name, n, row_number() over (partition by cluster_id order by n desc, f) as rank from (
  select cluster_id, n_sample, name, count(*) as n, min({'place': place, 'pos': pos}) as f from (
    select cluster_id, n_sample, place, h.name as name, min(i) as pos from (select cluster_id, n_sample, place, unnest(request_pairs) as h, generate_subscripts(request_pairs, 1) as i from sample) group by all) group by cluster_id, n_sample, name)) where rank <= 20""", _SAMPLE),
    "describe_auth": sql("""select cluster_id, bool_or(len(list_filter(request_pairs, lambda h: h.name = 'cookie')) > 0) as cookies_present,
bool_or(len(list_filter(request_pairs, lambda h: h.name = 'authorization' and lower(h.value) like 'bearer %')) > 0) as bearer_present,
array_to_string(list_sort(list_distinct(flatten(list(list_transform(api_keys, lambda k: k.name))))), ',') as custom_auth_headers from sample group by cluster_id""", _SAMPLE),
    "describe_query_keys": sql(f"""select cluster_id, query_key, mark from (select cluster_id, key as query_key, case when regexp_matches(lower(key), '^(timestamp|ts|t|time|nonce|rand|random|_)') or v / n > 0.8 then 'volatile' when n / n_sample >= 0.5 then 'stable' end as mark
from (select cluster_id, n_sample, q.key as key, count(distinct entry_id) as n, count(distinct q.value) as v from (select cluster_id, n_sample, entry_id, unnest({_QPAIRS}) as q from sample) group by all)) where mark is not null""", _SAMPLE),
    "flow_related": sql(f"select entry_id, ts_ms, host from ({_related(120_000, True)})"),
    "flow_related_wide": sql(f"select entry_id, ts_ms, host from ({_related(7_200_000, False)})"),
    "flow_trace_edges": sql("select * from edges", _EDGE_KEYS.format(nodes=_related(120_000, True))),
    "flow_session_edges": sql("select * from edges", _SESSION_EDGES),
    "flow_edge_summary": sql("select reason, count(*) as n from edges group by reason", _SESSION_EDGES),
    "fingerprints": sql("""select entry_id, array_to_string(list_transform(request_pairs, lambda h: h.name), ',') as headers_ordered, array_to_string(list_sort(list_distinct(list_transform(request_pairs, lambda h: h.name))), ',') as headers_normalized,
case when is_http2 then array_to_string(list_transform(list_filter(request_pairs, lambda h: h.name like ':%'), lambda h: concat(h.name, '=', coalesce(h.value, ''))), ',') else '' end as pseudo_headers,
req_body_bytes as req_bytes, case when req_body_bytes > 0 and req_body_bytes <= 1048576 then coalesce(sha256(req_raw), '') else '' end as req_hash,
resp_body_bytes as resp_bytes, case when resp_body_bytes > 0 and resp_body_bytes <= 1048576 then coalesce(sha256(resp_raw), '') else '' end as resp_hash, ja3, ja4 from m"""),
    "diff_neighbours": sql("select * from diffed", _DIFF),
    "diff_severity": sql("select severity, count(*) as n from diffed group by severity", _DIFF),
}

