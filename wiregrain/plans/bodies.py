"""Registered queries over bodies: extraction, inference, validation, GraphQL and streaming; with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bodyquery, catalog, graphql, infer, shapes, validation
from ..sources.tables import ship_package
from ..streaming.ingest import replay_counts, time_windows
from .reference import Query, on, sql

_SCHEMA_TEXT = "z.object({ id: z.string(), currency: z.string().optional() })"
_STRUCT_TEXT = "type Body struct { ID string `json:\"id\"`; UnitCount *float64 `json:\"unit_count,omitempty\"` }"


def _query(expression: str, mode: str, **more: object) -> Query:
    return on(lambda e: bodyquery.query_bodies(e, expression, mode, **more).where("status = 'value'").select("entry_id", "pos", "value"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return replay_counts(spark, f"{sf_dir.rstrip('/')}/entries.parquet")


def _top_fields(entries: DataFrame) -> DataFrame:
    return infer.field_stats(entries).where("path not like '%.%'").select("cluster_id", "path", "frequency", "required", "nullable")


QUERIES: dict[str, Query] = {
    "jq_path": on(lambda e: bodyquery.json_path_values(e, ".currency")),
    "jq_values": _query(".id", "jq"),
    "jq_select": _query(".variants[]? | select(.price > 50000) | {color, price}", "jq"),
    "jq_dedup": on(lambda e: bodyquery.values_of(bodyquery.query_bodies(e, ".currency, .locale", "jq"), deduplicate=True).select("value", "n")),
    "css_text": _query("h1.title", "css"),
    "xpath_text": _query("//body/h1", "xpath"),
    "regex_extract": on(lambda e: bodyquery.regex_values(e, r'"sku":"([A-Z]+)-', 1)),
    "regex_python": _query(r'"sku":"([A-Z]+)-', "regex"),
    "query_body_auto": on(lambda e: bodyquery.query_summary(bodyquery.query_bodies(e, ".id", target="both"))),
    "query_body_labels": on(lambda e: bodyquery.label_counts(bodyquery.query_bodies(e, ".id, .currency", "jq"))),
    "query_body_errors": on(lambda e: bodyquery.query_errors(bodyquery.query_bodies(e, ".id", "jq"))),
    "form_keys": on(bodyquery.form_keys),
    "display_bodies": on(lambda e: bodyquery.compact_bodies(e).where("text <> ''").select("entry_id", F.sha2("text", 256).alias("text_hash"))),
    "json_schema_infer": on(infer.json_schemas),
    "json_field_stats": on(infer.field_stats),
    "json_field_types": on(lambda e: infer.field_stats(e).select("cluster_id", "path", "type", "frequency", "required", "nullable")),
    "json_top_fields": on(_top_fields),
    "body_shapes": on(shapes.body_shapes),
    "html_tag_counts": on(shapes.html_tag_counts),
    "schema_validate": on(lambda e: validation.validate_bodies(e, _SCHEMA_TEXT, "zod").select("entry_id", "status")),
    "schema_validate_struct": on(lambda e: validation.validation_summary(validation.validate_bodies(e, _STRUCT_TEXT, "go_struct"))),
    "schema_common_errors": on(lambda e: validation.common_errors(validation.validate_bodies(e, _SCHEMA_TEXT, "zod"))),
    "graphql_operations": on(lambda e: graphql.operations(e).select("entry_id", "batch_index", "name", "type", "is_batched", "has_variables", "has_errors")),
    "graphql_survey": on(lambda e: graphql.operation_clusters(graphql.operations(e)).select("name", "type", "count", "error_count", "has_variables")),
    "graphql_fields": on(lambda e: graphql.operation_clusters(graphql.operations(e)).select("name", "type", "fields")),
    "graphql_examples": on(lambda e: graphql.operation_examples(graphql.operations(e))),
    "graphql_traffic_summary": on(lambda e: graphql.traffic_summary(graphql.operations(e))),
    "graphql_variables": on(lambda e: graphql.variable_distributions(graphql.operations(e)).select("name", "type", "variable", "value_type", "null_count")),
    "graphql_variable_values": on(lambda e: graphql.variable_distributions(graphql.operations(e)).select("name", "type", "variable", "unique_count", "top_values")),
    "graphql_errors": on(lambda e: graphql.error_summary(graphql.operations(e))),
    "graphql_fragments": on(lambda e: graphql.fragment_coverage(graphql.operations(e))),
    "graphql_fragment_warnings": on(lambda e: graphql.fragment_warnings(graphql.operations(e))),
    "graphql_variants": on(lambda e: graphql.response_variants(graphql.operations(e))),
    "graphql_endpoints": on(lambda e: catalog.graphql_endpoints(e, graphql.operations(e))),
    "stream_endpoint_counts": _stream,
    "time_windows": on(lambda e: time_windows(e).select(F.unix_millis("start").alias("start_ms"), "status_class", "n")),
}

_JSON = "contains(lower(coalesce(list_filter(response_pairs, lambda h: h.name = 'content-type')[1].value, '')), 'json')"
_TEXTUAL = "regexp_matches(lower(coalesce(list_filter(response_pairs, lambda h: h.name = 'content-type')[1].value, '')), '^text/|json|xml|javascript|html|css|yaml|form-urlencoded')"
_VALID = f"{_JSON} and resp_text is not null and json_valid(resp_text)"
_PAGE = "regexp_matches(lower(coalesce(list_filter(response_pairs, lambda h: h.name = 'content-type')[1].value, '')), '^text/html')"

_OPS = f""", posts as (
  select *, json(req_text) as j from m where method = 'POST' and contains(lower(coalesce(list_filter(request_pairs, lambda h: h.name = 'content-type')[1].value, '')), 'json') and req_text is not null and json_valid(req_text)
), items as (
  select entry_id, ts_ms, host, json_type(j) = 'ARRAY' as is_batched, unnest(case when json_type(j) = 'ARRAY' then cast(j as json[]) else [j] end) as o,
    generate_subscripts(case when json_type(j) = 'ARRAY' then cast(j as json[]) else [j] end, 1) - 1 as batch_index,
    case when {_VALID} then json(resp_text) end as r
  from posts where coalesce(json_extract_string(case when json_type(j) = 'ARRAY' then j->0 else j end, '$.query'), '') <> ''
), ops as (
  select entry_id, ts_ms, host, is_batched, cast(batch_index as integer) as batch_index,
    coalesce(nullif(json_extract_string(o, '$.operationName'), ''), nullif(case when trim(q) like '{{%' then '' else regexp_extract(q, '(?i)^\\s*(subscription|mutation|query)?\\s*(\\w*)', 2) end, ''), 'anonymous') as name,
    case when regexp_matches(q, '(?i)^\\s*subscription') then 'subscription' when regexp_matches(q, '(?i)^\\s*mutation') then 'mutation' else 'query' end as type,
    coalesce(json_type(o, '$.variables'), 'NULL') <> 'NULL' as has_variables, json_extract(o, '$.variables') as variables, r,
    coalesce(json_array_length(case when json_type(r) = 'ARRAY' then json_extract(r, concat('$[', batch_index, ']')) when batch_index = 0 then r end, '$.errors'), 0) > 0 as has_errors
  from (select *, coalesce(json_extract_string(o, '$.query'), '') as q from items)
)"""

ORACLES: dict[str, str] = {
    "jq_path": sql(f"select entry_id, json_extract_string(resp_text, '$.currency') as value from m where {_VALID} and coalesce(json_type(resp_text, '$.currency'), 'NULL') not in ('NULL', 'OBJECT', 'ARRAY')"),
    "jq_values": sql(f"select entry_id, 0 as pos, cast(json_extract(resp_text, '$.id') as varchar) as value from m where {_VALID} and coalesce(json_type(resp_text, '$.id'), 'NULL') <> 'NULL'"),
    "jq_dedup": sql(f"""select value, count(*) as n from (select unnest([cast(json_extract(resp_text, '$.currency') as varchar), cast(json_extract(resp_text, '$.locale') as varchar)]) as value from m where {_VALID}) where value is not null and value <> 'null' group by value"""),
    "query_body_labels": sql(f"select entry_id, 'response' as target, cast(coalesce(json_type(resp_text, '$.id'), 'NULL') <> 'NULL' as integer) + cast(coalesce(json_type(resp_text, '$.currency'), 'NULL') <> 'NULL' as integer)::bigint as n_values from m where {_VALID} and (coalesce(json_type(resp_text, '$.id'), 'NULL') <> 'NULL' or coalesce(json_type(resp_text, '$.currency'), 'NULL') <> 'NULL')"),
    "css_text": sql(f"select entry_id, cast(i - 1 as integer) as pos, concat('\"', trim(v), '\"') as value from (select entry_id, unnest(regexp_extract_all(resp_text, '<h1 class=\"title\">([^<]*)</h1>', 1)) as v, generate_subscripts(regexp_extract_all(resp_text, '<h1 class=\"title\">([^<]*)</h1>', 1), 1) as i from m where {_TEXTUAL} and resp_text is not null)"),
    "xpath_text": sql(f"select entry_id, cast(i - 1 as integer) as pos, concat('\"', trim(v), '\"') as value from (select entry_id, unnest(regexp_extract_all(resp_text, '<h1[^>]*>([^<]*)</h1>', 1)) as v, generate_subscripts(regexp_extract_all(resp_text, '<h1[^>]*>([^<]*)</h1>', 1), 1) as i from m where {_PAGE} and resp_text is not null)"),
    "regex_extract": sql(f"""select entry_id, cast(i - 1 as integer) as pos, v as value from (select entry_id, unnest(regexp_extract_all(resp_text, '"sku":"([A-Z]+)-', 1)) as v, generate_subscripts(regexp_extract_all(resp_text, '"sku":"([A-Z]+)-', 1), 1) as i from m where {_TEXTUAL} and resp_text is not null)"""),
    "regex_python": sql(f"""select entry_id, cast(i - 1 as integer) as pos, concat('"', v, '"') as value from (select entry_id, unnest(regexp_extract_all(resp_text, '"sku":"([A-Z]+)-', 1)) as v, generate_subscripts(regexp_extract_all(resp_text, '"sku":"([A-Z]+)-', 1), 1) as i from m where {_TEXTUAL} and resp_text is not null)"""),
    "form_keys": sql("""select key, count(distinct entry_id) as n_urls, count(*) as n_pairs, round(count(distinct entry_id) / (select count(*) from m where contains(url, '?')), 6) as frequency
from (select entry_id, url_decode(replace(string_split(p, '=')[1], '+', ' ')) as key from (select entry_id, unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) as p from m where contains(url, '?')) where p <> '' and not contains(p, ';')) group by key"""),
    "json_top_fields": sql(f"""select b.cluster_id, k.key as path, round(count(*) / any_value(t.n), 6) as frequency, count(*) = any_value(t.n) and count(*) filter (json_type(k.value) = 'NULL') = 0 as required, count(*) filter (json_type(k.value) = 'NULL') > 0 as nullable
from b join (select cluster_id, count(*) as n from b group by 1 having bool_and(json_type(j) = 'OBJECT')) t using (cluster_id), json_each(b.j) k where k.key not like '%.%' group by b.cluster_id, k.key""",
        f", b as (select substr(sha256(concat(host, chr(0), method, chr(0), path_template)), 1, 12) as cluster_id, json(resp_text) as j from m where {_VALID})"),
    "graphql_variable_values": sql("""select name, type, variable, coalesce(sum(1) filter (value is not null), 0)::bigint as unique_count,
  case when coalesce(first(vt order by total desc, vt) filter (vt <> 'null'), 'null') in ('object', 'array') then '' else coalesce(string_agg(value || '=' || n, ',' order by n desc, value) filter (r <= 5), '') end as top_values
from (select *, sum(n) over (partition by name, type, variable, vt) as total, case when value is not null then row_number() over (partition by name, type, variable, value is null order by n desc, value) end as r from (
  select o.name, o.type, k.key as variable, case json_type(k.value) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as vt,
    case when json_type(k.value) <> 'NULL' then cast(k.value as varchar) end as value, count(*) as n
  from (select * from ops where json_type(variables) = 'OBJECT') o, json_each(o.variables) k group by all)) group by name, type, variable""", _OPS),
    "schema_validate_struct": sql(f"""select cast(count(*) filter (s = 'matching') as bigint) as matching, cast(count(*) filter (s = 'failed') as bigint) as failed, cast(count(*) filter (s = 'skipped') as bigint) as skipped, count(*) filter (s = 'failed') = 0 and count(*) filter (s = 'matching') > 0 as all_match
from (select case when coalesce(resp_text, '') = '' or not {_JSON} then 'skipped'
when resp_text is not null and json_valid(resp_text) and json_type(resp_text) = 'OBJECT' and json_type(resp_text, '$.id') = 'VARCHAR' and coalesce(json_type(resp_text, '$.unit_count'), 'NULL') in ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE') then 'matching' else 'failed' end as s from m)"""),
    "html_tag_counts": sql(f"""select cluster_id, tag, cast(sum(n) as bigint) as n, count(distinct entry_id) as n_pages from (
  select substr(sha256(concat(host, chr(0), method, chr(0), path_template)), 1, 12) as cluster_id, entry_id, unnest(regexp_extract_all(lower(resp_text), '<([a-z][a-z0-9]*)[^>]*>', 1)) as tag, 1 as n from m where {_PAGE} and resp_text is not null) group by all"""),
    "json_field_types": sql(f"""select n.cluster_id, replace(replace(n.path, chr(30), '[]'), chr(31), '.') as path, array_to_string(list_sort(list(distinct n.type)), '|') as type, round(count(*) / any_value(p.n), 6) as frequency, count(*) = any_value(p.n) and count(*) filter (n.type = 'null') = 0 as required, count(*) filter (n.type = 'null') > 0 as nullable
from typed n join single p on p.cluster_id = n.cluster_id and p.path = n.parent and p.type = 'object'
where not n.item and n.path <> '' and not exists (select 1 from mixed x where x.cluster_id = n.cluster_id and (x.path = '' or starts_with(n.path, x.path || chr(31)) or starts_with(n.path, x.path || chr(30)))) group by n.cluster_id, n.path""",
f""", b as (select substr(sha256(concat(host, chr(0), method, chr(0), path_template)), 1, 12) as cluster_id, json(resp_text) as j from m where {_VALID}), nodes as (
  select cluster_id, '' as path, '' as parent, false as item, j as v from b
  union all
  select n.cluster_id, case when json_type(n.v) = 'ARRAY' then n.path || chr(30) when n.path = '' then e.key else n.path || chr(31) || e.key end, n.path, json_type(n.v) = 'ARRAY', e.value
  from nodes n, json_each(n.v) e where json_type(n.v) = 'OBJECT' or (json_type(n.v) = 'ARRAY' and n.path <> '')
), typed as (
  select *, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' when 'DOUBLE' then case when cast(v as double) = floor(cast(v as double)) then 'integer' else 'number' end else 'integer' end as type from nodes
), single as (
  select cluster_id, path, any_value(type) as type, count(*) as n from typed group by cluster_id, path having count(distinct type) = 1
), mixed as (
  select cluster_id, path from typed group by cluster_id, path having count(distinct type) > 1
)""").replace("with latest","with recursive latest",1),
    "schema_validate": sql(f"""select entry_id, case when coalesce(resp_text, '') = '' or not {_JSON} then 'skipped'
when json_valid(resp_text) and json_type(resp_text) = 'OBJECT' and json_type(resp_text, '$.id') = 'VARCHAR' and coalesce(json_type(resp_text, '$.currency'), 'VARCHAR') = 'VARCHAR' then 'matching' else 'failed' end as status from m"""),
    "graphql_operations": sql("select entry_id, batch_index, name, type, is_batched, has_variables, has_errors from ops", _OPS),
    "graphql_survey": sql("select name, type, count(*) as count, count(*) filter (has_errors) as error_count, bool_or(has_variables) as has_variables from ops group by all", _OPS),
    "graphql_examples": sql("select name, type, entry_id, cast(rank as integer) as rank from (select name, type, entry_id, row_number() over (partition by name, type order by ts_ms desc, entry_id, batch_index) as rank from ops) where rank <= 5", _OPS),
    "graphql_traffic_summary": sql("""select count(*) as total_requests, count(*) filter (type = 'query') as query_count, count(*) filter (type = 'mutation') as mutation_count, count(*) filter (type = 'subscription') as subscription_count,
count(*) filter (name = 'anonymous') as anonymous_count, count(distinct entry_id) filter (is_batched) as batched_count, count(distinct concat(name, chr(0), type)) as unique_operations, count(distinct host) as n_hosts from ops""", _OPS),
    "graphql_variables": sql("""select name, type, variable, coalesce(first(vt order by n desc, vt) filter (vt <> 'null'), 'null') as value_type, coalesce(sum(n) filter (vt = 'null'), 0)::bigint as null_count from (
select o.name, o.type, k.key as variable, case json_type(k.value) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as vt, count(*) as n
from (select * from ops where json_type(variables) = 'OBJECT') o, json_each(o.variables) k group by all) group by name, type, variable""", _OPS),
    "graphql_errors": sql("""select name, type, count(*) as entries_checked, count(*) filter (n > 0) as entries_with_errors, cast(sum(n) as bigint) as total_errors, count(*) filter (n > 0 and has_data) as partial_failures, count(*) filter (n > 0 and not has_data) as full_failures
from (select name, type, case when json_type(r) = 'OBJECT' then coalesce(json_array_length(r, '$.errors'), 0) else 0 end as n, coalesce(json_type(r, '$.data'), 'NULL') <> 'NULL' as has_data from ops) group by name, type""", _OPS),
    "graphql_endpoints": sql("select substr(sha256(concat(host, chr(0), method, chr(0), path_template)), 1, 12) as cluster_id, host, method, path_template, count(*) as n from m where method = 'POST' and entry_id in (select entry_id from ops) group by all", _OPS),
    "stream_endpoint_counts": sql("select host, method, path_template, count(*) as count from m group by all"),
    "time_windows": """select cast(epoch_ms(time_bucket(interval 10 minutes, make_timestamp(timings.started_at * 1000))) as bigint) as start_ms,
case when response.status_code between 100 and 599 then concat(response.status_code // 100, 'xx') else 'other' end as status_class, count(*) as n from entries where timings.started_at is not null group by all""",
}
