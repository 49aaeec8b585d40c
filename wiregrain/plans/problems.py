"""Registered queries of the general data-preparation operators (problems 1, 3, 4, 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, nested, packed, skew
from ..sources.tables import read_table, ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _on(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query that reads the named tables and hands them to an operator."""

    def wrap(operator: Callable[..., DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return operator(*[read_table(spark, sf_dir, n) for n in names])

        return query

    return wrap


_NESTED = ("entries", "graphql_operations", "tls_client_hellos")


def _nested_tables(*tables: DataFrame) -> DataFrame:
    hellos = tables[2].select("connection_id", "extensions").distinct()
    return nested.group_tables(nested.nested_records(hellos, F.col("connection_id"), F.col("extensions")))


def _key_shares(*tables: DataFrame) -> DataFrame:
    records = nested.nested_records(tables[0].select("connection_id", "extensions").distinct(), tables[0]["connection_id"], tables[0]["extensions"])
    return nested.pivot_group(records, "/*/client_shares/*/group", ("value", "name"))


QUERIES: dict[str, Query] = {
    "p1_found": _on("entries")(drift.schema_changes),
    "p1_cluster_schemas": _on("entries")(drift.cluster_schemas),
    "p1_unified_records": _on("entries")(drift.unified_records),
    "p3_found": _on("entries")(packed.header_values),
    "p4_found": _on("entries", "clusters")(skew.wrong_counts),
    "p4_cluster_counts": _on("entries", "clusters")(skew.cluster_entry_counts),
    "p4_host_counts": _on("entries")(skew.host_entry_counts),
    "p4_host_headers": _on("clusters", "header_frequencies")(skew.host_header_sums),
    "p5_found": _on(*_NESTED)(nested.object_nodes),
    "p5_group_tables": _on(*_NESTED)(nested.capture_tables),
    "p5_group_rows": _on(*_NESTED)(nested.capture_groups),
    "p5_extension_tables": _on(*_NESTED)(_nested_tables),
    "p5_key_share_groups": _on("tls_client_hellos")(_key_shares),
}

_LATEST = """latest as (
  select * from entries qualify row_number() over (partition by entry_id order by ingested_at desc) = 1
), keyed as (
  select entry_id, session_id, request.method as method,
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) as host,
    array_to_string(list_transform(string_split(url_decode(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '+', '%2B')), '/'), lambda s:
      case when regexp_full_match(lower(s), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') then '{uuid}'
           when regexp_full_match(s, '[0-9]+') then '{id}'
           when regexp_full_match(lower(s), '[0-9a-f]{8,}') then '{hex}' else s end), '/') as path_template
  from latest
), counts as (
  select session_id, host, method, path_template, count(*) as n_entries from keyed group by all
), stated as (
  select cluster_id, session_id, lower(trim(host)) as host, method, path_template, min("count") as least, max("count") as most
  from clusters group by all
)"""

_SHAPES = r"""latest as (
  select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as raw_path from entries where entry_id is not null qualify row_number() over (partition by entry_id order by ingested_at desc) = 1
), bodies as (
  select session_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) as host, request.method as method,
    array_to_string(list_transform(string_split(url_decode(replace(raw_path, '+', '%2B')), '/'), lambda s:
      case when regexp_full_match(lower(s), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') then '{uuid}' when regexp_full_match(s, '[0-9]+') then '{id}' when regexp_full_match(lower(s), '[0-9a-f]{8,}') then '{hex}' else s end), '/') as path_template,
    file_no, entry_id, try(decode(from_base64(response.body))) as t
  from latest where response.status_code = 200 and file_no is not null
), usable as (
  select substr(sha256(concat(session_id, chr(0), host, chr(0), method, chr(0), path_template)), 1, 16) as cluster_id, file_no, entry_id, json(t) as j, cast(json_extract(json(t), '$.id') as varchar) as rec_id
  from bodies where t is not null and json_valid(t) and json_type(json(t)) = 'OBJECT' and json_exists(json(t), '$.id')
), nodes as (
  select cluster_id, file_no, entry_id, rec_id, '' as path, j as v, true as inner_node, [0::ubigint] as place from usable
  union all
  select n.cluster_id, n.file_no, n.entry_id, n.rec_id, case when json_type(n.v) = 'ARRAY' then n.path || chr(30) when n.path = '' then e.key else n.path || chr(31) || e.key end, e.value, json_type(n.v) = 'ARRAY', list_append(n.place, e.id)
  from nodes n, json_each(n.v) e
  where json_type(n.v) = 'OBJECT' or (json_type(n.v) = 'ARRAY' and not n.inner_node and json_type(e.value) = 'OBJECT')
), fields as (
  select cluster_id, file_no, entry_id, rec_id, path, v, place, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end as type
  from nodes where not inner_node
), known as (
  select cluster_id, file_no, path, coalesce(list_sort(list(distinct type) filter (type is not null)), []) as types from fields group by all
)"""

_CHANGES = f"""with recursive {_SHAPES}, files as (
  select cluster_id, file_no, lag(file_no) over (partition by cluster_id order by file_no) as prev_no from (select distinct cluster_id, file_no from usable)
), pairs as (
  select cluster_id, file_no, path, max(before) as before, max(now) as now from (
    select f.cluster_id, f.file_no, k.path, null as before, k.types as now from files f join known k on k.cluster_id = f.cluster_id and k.file_no = f.file_no where prev_no is not null
    union all select f.cluster_id, f.file_no, k.path, k.types, null from files f join known k on k.cluster_id = f.cluster_id and k.file_no = f.prev_no) group by all
), changed as (
  select * from pairs where before is null or now is null or (before <> now and len(before) > 0 and len(now) > 0)
), topmost as (
  select * from changed c where not exists (select 1 from changed a where a.cluster_id = c.cluster_id and a.file_no = c.file_no and (starts_with(c.path, a.path || chr(31)) or starts_with(c.path, a.path || chr(30))))
), moved as (
  select t.cluster_id, t.file_no, f.prev_no, t.path, regexp_replace(t.path, '(^|' || chr(31) || ')[^' || chr(31) || ']*$', '') as parent, coalesce(before, now) as types, now is not null as is_new
  from topmost t join files f using (cluster_id, file_no) where before is null or now is null
), held as (
  select cluster_id, file_no, rec_id, path, list(distinct vs) as alternatives, count(*) as n from (
    select cluster_id, file_no, rec_id, entry_id, path, list(cast(v as varchar) order by place) as vs from fields group by all) group by all
), records as (
  select cluster_id, file_no, rec_id, count(distinct entry_id) as n from usable group by all
), shared as (
  select f.cluster_id, f.file_no, f.prev_no, a.rec_id, a.n as n_now, b.n as n_before from files f join records a on a.cluster_id = f.cluster_id and a.file_no = f.file_no join records b on b.cluster_id = f.cluster_id and b.file_no = f.prev_no and b.rec_id = a.rec_id
), candidates as (
  select o.cluster_id, o.file_no, o.prev_no, o.parent, o.types, o.path as field_path, n.path as new_path from moved o join moved n using (cluster_id, file_no, parent, types) where not o.is_new and n.is_new
), fitting as (
  select c.cluster_id, c.file_no, c.field_path, c.new_path, count(*) filter (x.rec_id is not null or y.rec_id is not null) as n_held,
    count(*) filter (len(x.alternatives) = 1 and len(y.alternatives) = 1 and x.alternatives = y.alternatives and x.n = s.n_before and y.n = s.n_now) as n_equal
  from candidates c join shared s on s.cluster_id = c.cluster_id and s.file_no = c.file_no
  left join held x on x.cluster_id = c.cluster_id and x.file_no = c.prev_no and x.rec_id = s.rec_id and x.path = c.field_path
  left join held y on y.cluster_id = c.cluster_id and y.file_no = c.file_no and y.rec_id = s.rec_id and y.path = c.new_path
  group by all having n_held > 0 and n_held = n_equal
), renamed as (
  select * from fitting qualify row_number() over (partition by cluster_id, file_no, field_path order by n_equal desc, new_path) = 1 and row_number() over (partition by cluster_id, file_no, new_path order by n_equal desc, field_path) = 1
), listed as (
  select cluster_id, file_no, case when before is null then 'added' when now is null then 'removed' else 'type_changed' end as change, path as field_path, '' as new_path from topmost t
  where not exists (select 1 from renamed r where r.cluster_id = t.cluster_id and r.file_no = t.file_no and t.path in (r.field_path, r.new_path))
  union all select cluster_id, file_no, 'renamed', field_path, new_path from renamed
)
select cluster_id, file_no, change, replace(replace(field_path, chr(30), '[]'), chr(31), '.') as field_path, replace(replace(new_path, chr(30), '[]'), chr(31), '.') as new_path from listed"""

_SCHEMAS = f"""with recursive {_SHAPES}, tagged as (
  select cluster_id, path, list_filter(['string', 'number', 'boolean', 'object', 'array'], lambda x: list_contains(flatten(list(types)), x)) as tags, min(file_no) as first_file, max(file_no) as last_file, count(*) as n_files from known group by all
)
select cluster_id, replace(replace(path, chr(30), '[]'), chr(31), '.') as field_path, array_to_string(tags, '|') as alternatives, case when len(tags) = 1 then tags[1] else 'string' end as canonical_type, first_file, last_file, n_files from tagged"""

_SPAN = r'''"(?:[^"\\]|\\.|"")*"|<[^<>]*>'''

_PACKED = rf"""with latest as (
  select entry_id, request.headers as q, response.headers as r from entries where entry_id is not null qualify row_number() over (partition by entry_id order by ingested_at desc) = 1
), placed as (
  select entry_id, 'request' as side, unnest(range(1, len(q) + 1)) as i, q as h from latest union all select entry_id, 'response', unnest(range(1, len(r) + 1)), r from latest
), packed as (
  select entry_id, side, cast(i - 1 as integer) as header_pos, lower(h[i][1]) as name, h[i][2] as raw from placed
), parts as (
  select entry_id, side, header_pos, name, case name when 'cookie' then regexp_extract_all(raw, '(?s)(?:{_SPAN}|[^;])+') when 'link' then regexp_extract_all(raw, '(?s)(?:{_SPAN}|[^,])+') else regexp_extract_all(raw, '(?s)(?:{_SPAN}|[^,;|\t])+') end as found
  from packed where (side = 'request' and name in ('cookie', 'x-feature-tags', 'x-forwarded-for')) or (side = 'response' and name in ('link', 'x-cache-tags', 'vary'))
), tidy as (
  select entry_id, side, header_pos, list_filter(list_transform(list_transform(found, lambda v: regexp_replace(v, '(?s)^\s+|\s+$', '', 'g')), lambda v:
    case when regexp_full_match(v, '(?s)"(?:[^"\\]|\\.|"")*"') then regexp_replace(substr(v, 2, len(v) - 2), '(?s)\\(.)|"(")', '\1\2', 'g') else v end), lambda v: v <> '' and (name <> 'cookie' or contains(v, '='))) as vs
  from parts
)
select entry_id, side, header_pos, cast(k - 1 as integer) as value_pos, vs[k] as value from (select *, unnest(range(1, len(vs) + 1)) as k from tidy)"""

_UNFOLD = "case when json_type({0}) = 'VARCHAR' and regexp_matches({0}->>'$', '^[ \\t\\n\\r]*[{{\\[]') and json_valid({0}->>'$') then json({0}->>'$') else {0} end"

_OBJECTS = rf"""with recursive texts as (
  select 'body' as source, entry_id as record_id, try(decode(from_base64(response.body))) as t from (
    select * from entries where entry_id is not null qualify row_number() over (partition by entry_id order by ingested_at desc) = 1)
  union select 'variables', op_id, variables from graphql_operations where op_id is not null
  union select 'extensions', connection_id, extensions from tls_client_hellos where connection_id is not null
), nodes as (
  select source, record_id, '' as ptr, '' as owner, {_UNFOLD.format("json(t)")} as v from (select * from texts where t is not null and json_valid(t))
  union all
  select source, record_id, ptr || '/' || replace(replace(key, '~', '~0'), '/', '~1'), case when json_type(v) = 'OBJECT' then ptr else owner end, {_UNFOLD.format("child")}
  from (select n.*, e.key, e.value as child from nodes n, json_each(n.v) e where json_type(n.v) in ('OBJECT', 'ARRAY'))
)
select distinct source, record_id, ptr as node_path, owner as parent_path from nodes where json_type(v) = 'OBJECT' and ptr <> ''"""

_GROUPS = (
    r"""with recursive texts as (
  select 'body' as source, entry_id as record_id, try(decode(from_base64(response.body))) as t from (
    select * from entries where entry_id is not null qualify row_number() over (partition by entry_id order by ingested_at desc) = 1)
  union select 'variables', op_id, variables from graphql_operations where op_id is not null
  union select 'extensions', connection_id, extensions from tls_client_hellos where connection_id is not null
), nodes as (
  select source, record_id, md5(t) as doc, '' as ptr, '' as owner, '' as grp, '' as owner_grp, '' as name, false as item, """
    + _UNFOLD.format("json(t)")
    + r""" as v from (select * from texts where t is not null and json_valid(t))
  union all
  select source, record_id, doc, ptr || '/' || token, case when parent = 'OBJECT' then ptr else owner end, case when parent = 'OBJECT' then grp || '/' || token else grp || '/*' end, case when parent = 'OBJECT' then grp else owner_grp end, key, parent = 'ARRAY', """
    + _UNFOLD.format("child")
    + r"""
  from (select n.*, json_type(n.v) as parent, e.key, replace(replace(e.key, '~', '~0'), '/', '~1') as token, e.value as child from nodes n, json_each(n.v) e where json_type(n.v) in ('OBJECT', 'ARRAY'))
), kinds as (
  select * exclude (v), case json_type(v) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind,
    case when json_type(v) not in ('OBJECT', 'ARRAY') then cast(v as varchar) end as value from nodes
), members as (
  select source, record_id, doc, owner as ptr, list(concat(name, ':', kind, ':', value) order by name) as held from kinds where not item and kind <> 'object' and ptr <> '' group by all
), groups as (
  select distinct k.source, k.record_id, k.grp, k.owner_grp, k.ptr, k.kind, case when k.kind = 'object' then coalesce(m.held, []) else [concat('*:', k.kind, ':', k.value)] end as held
  from kinds k left join members m on k.kind = 'object' and m.source = k.source and m.record_id = k.record_id and m.doc = k.doc and m.ptr = k.ptr where k.kind = 'object' or (k.item and k.kind <> 'object')
)
select source, grp as group_path, owner_grp as parent_group, count(*) as n_rows, coalesce(array_to_string(list_sort(list_distinct(flatten(list(list_transform(held, lambda x: regexp_extract(x, '(?s)^(.*?:(?:string|number|boolean|null|array))(?::.*)?$', 1)))))), ','), '') as members from groups group by all"""
)

ORACLES: dict[str, str] = {
    "p5_group_tables": _GROUPS,
    "p1_found": _CHANGES,
    "p1_cluster_schemas": _SCHEMAS,
    "p3_found": _PACKED,
    "p5_found": _OBJECTS,
    "p4_found": f"""with {_LATEST}
select distinct cluster_id from stated left join counts using (session_id, host, method, path_template)
where least <> coalesce(n_entries, 0) or most <> coalesce(n_entries, 0)""",
    "p4_cluster_counts": f"""with {_LATEST}
select cluster_id, session_id, host, method, path_template, least, most, coalesce(n_entries, 0) as n_entries
from stated left join counts using (session_id, host, method, path_template)""",
    "p4_host_headers": """select lower(trim(host)) as host, count(*) as n_rows, round(sum(frequency), 3) as frequency from clusters join header_frequencies using (cluster_id) group by lower(trim(host))""",
    "p4_host_counts": f"""with {_LATEST}
select host, cast(sum(n_entries) as bigint) as n_entries, count(distinct session_id) as n_sessions, count(*) as n_endpoints
from counts group by host""",
}
