"""Registered queries of the text operators (problems 2, 6, 7, 8) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table, ship_package
from . import leaks, packing, sentences, terms

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[..., DataFrame], *names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(*[read_table(spark, sf_dir, n) for n in names])

    return query


def queries() -> dict[str, Query]:
    return {
        "p2_found": _on(terms.found_terms, "header_frequencies", "clusters"),
        "p2_term_counts": _on(terms.capture_terms, "header_frequencies", "clusters"),
        "p6_found": _on(packing.cut_pieces, "documents", "container_kinds"),
        "p6_packing": _on(packing.document_packing, "documents", "container_kinds"),
        "p6_packing_summary": _on(packing.packing_summary, "documents", "container_kinds"),
        "p6_instruction_packing": _on(packing.instruction_packing, "documents", "container_kinds"),
        "p6_invariants": _on(packing.packing_invariants, "documents", "container_kinds"),
        "p6_instruction_invariants": _on(packing.instruction_invariants, "documents", "container_kinds"),
        "p7_found": _on(leaks.leaked_documents, "documents", "eval_items"),
        "p7_spans": _on(leaks.leaks, "documents", "eval_items"),
        "p7_report": _on(leaks.leak_report, "documents", "eval_items"),
        "p8_found": _on(sentences.document_sentences, "documents"),
    }


_TERMS = """with rows as (
  select 'header_name' as field, lower(trim(name)) as term, cluster_id from header_frequencies
  union all select 'host', lower(trim(host)), cluster_id from clusters
  union all select 'path_template', trim(path_template), cluster_id from clusters
), totals as (
  select 'header_name' as field, count(distinct cluster_id) as n from header_frequencies
  union all select 'host', count(distinct cluster_id) from clusters
  union all select 'path_template', count(distinct cluster_id) from clusters
), counts as (
  select field, term, count(*) as occurrences, count(distinct cluster_id) as records from rows where term <> '' group by field, term
), marked as (
  select field, term, occurrences, records,
    case when records <= 2 then 'rare' when records >= 0.04 * n then 'common' else 'useful' end as mark
  from counts join totals using (field)
)"""


# windows of items and documents as words or letters, joined
_WINDOWS = r"""with texts as (
  select 'd' as side, doc_id as id, text from documents where text <> '' union all select 'i', item_id, text from eval_items where text <> ''
), bare as (
  select side, id, lower(regexp_replace(regexp_replace(regexp_replace(text, '(?s)</?[A-Za-z][^<>]*>|<!--.*?-->|\]\([^()\s]*\)', '', 'g'), '&(nbsp|#160);', ' ', 'g'), '\p{Cf}+', '', 'g')) as t from texts
), cut as (
  select side, id, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda w: w <> '') as words, regexp_replace(t, '[^\p{L}]+', '', 'g') as letters from bare
), kinds as (
  select *, 2 * len(regexp_replace(letters, '[^\p{Han}\p{Hiragana}\p{Katakana}ー]+', '', 'g')) > len(letters) as lettered from cut
), patterns as (
  select distinct id as item_id, array_to_string(words[k:k + 11], ' ') as p from (select *, unnest(range(1, len(words) - 10)) as k from kinds where side = 'i' and not lettered)
  union select distinct id, substr(letters, cast(k as bigint), 24) from (select *, unnest(range(1, len(letters) - 22)) as k from kinds where side = 'i' and lettered)
), grams as (
  select distinct id as doc_id, array_to_string(words[k:k + 11], ' ') as p from (select *, unnest(range(1, len(words) - 10)) as k from kinds where side = 'd')
  union select distinct id, substr(letters, cast(k as bigint), 24) from (select *, unnest(range(1, len(letters) - 22)) as k from kinds where side = 'd' and regexp_matches(letters, '[\p{Han}\p{Hiragana}\p{Katakana}]'))
)"""


# the invariants of a packing, from the documents alone
_WHOLE = """with sized as (
  select container_kind, capacity_tokens as cap, cast(floor(capacity_tokens * {share}) as bigint) as most_loss, strlen(text) as n, strlen(regexp_replace(text, '\\s+', '', 'g')) as loss
  from documents, container_kinds where text <> '' and capacity_tokens > 0
), capped as (
  select container_kind, n, greatest(1, least(cap, most_loss * n // greatest({loss}, 1))) as cap from sized
)
select container_kind, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens, cast(sum(ceil(n / cap)) as bigint) as n_pieces, 0 as n_overfull, 0 as n_broken, true as few from capped group by container_kind"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_invariants": _WHOLE.format(share=1, loss="n"),
        "p6_instruction_invariants": _WHOLE.format(share=0.875, loss="loss"),
        "p2_found": f"{_TERMS} select field, term, mark from marked where mark <> 'useful'",
        "p2_term_counts": f"{_TERMS} select field, term, occurrences, records, mark from marked",
        "p7_found": f"{_WINDOWS} select distinct doc_id, item_id from grams join patterns using (p)",
        "p7_report": f"""{_WINDOWS} select item_id, suite, lang, count(distinct doc_id) as n_docs, count(distinct source) as n_sources
from eval_items left join (select distinct doc_id, item_id, source from grams join patterns using (p) join documents using (doc_id)) using (item_id) group by all""",
        "p6_found": """select container_kind, doc_id, cast(unnest(range(cast(ceil(strlen(text) / capacity_tokens) as bigint))) as integer) as piece_no
from documents cross join container_kinds where strlen(text) > capacity_tokens""",
    }
