"""SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from tracemill.llm.centroid_clusters import ORACLE_SQL as CLUSTERS_SQL
from tracemill.llm.mix_sources import ORACLE_SQL as MIX_SQL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str, separator: str) -> str:
    return f"[x for x in string_split_regex({text}, '{separator}') if x <> '']"


def _components(similar: int, kept: str = "") -> str:
    """Components of documents whose sets of 4-word shingles have that similarity in per cent."""
    return f"""
with recursive words as materialized (select doc_id, {_words(_LOWER, _SPACE)} as w from documents),
sets as materialized (
  select doc_id, case when len(w) >= 4 then list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from words),
shingles as materialized (select doc_id, len(s) as n, unnest(s) as g from sets),
shared as (
  select a.doc_id as x, b.doc_id as y, any_value(a.n) as n, any_value(b.n) as m, count(*) as c
  from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select x, y from shared where 100 * c >= {similar} * (n + m - c)),
edges as materialized (select x, y from links union all select y, x from links),
reached as (
  select distinct x as id, x as other from edges
  union
  select reached.id, edges.y from reached join edges on reached.other = edges.x),
least as (select id, min(other) as other from reached group by id)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(other, doc_id) as component_id{kept}
from sets left join least on doc_id = id"""


REPEATED_SQL = f"""
with words as materialized (select doc_id, {_words("coalesce(text, '')", _SPACE)} as w from documents),
each_word as materialized (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words),
ahead as (
  select doc_id, i, string_agg(word, ' ') over next_words as p, count(*) over next_words as n from each_word
  window next_words as (partition by doc_id order by i rows between current row and 19 following)),
windows as (select doc_id, i, row_number() over (partition by p order by doc_id, i) as nth from ahead where n = 20),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from windows where nth > 1),
left_over as (
  select doc_id, count(*) as n_kept, string_agg(word, ' ' order by i) as kept
  from each_word anti join gone using (doc_id, i) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n_kept, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from words left join left_over using (doc_id)"""

CONTAMINATION_SQL = f"""
with words as materialized (select doc_id, {_words(_LOWER, _NOT_WORD)} as w from documents),
items as (select cast(item_id as varchar) as item, {_words(_LOWER, _NOT_WORD)} as w from benchmark where item_id is not null),
starts as (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0),
patterns as materialized (select distinct item, least(len(w), 13) as n, array_to_string(w[i:i + 12], ' ') as p from starts),
lengths as (select distinct n from patterns),
each_word as materialized (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words),
ahead as (
  select doc_id, i, list(word) over next_words as next from each_word
  window next_words as (partition by doc_id order by i rows between current row and 12 following)),
windows as (select doc_id, n, i, array_to_string(next[1:n], ' ') as p from ahead cross join lengths where len(next) >= n),
found as materialized (select doc_id, n, i, item from windows join patterns using (n, p)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit using (doc_id) left join named using (doc_id)"""


def all_oracles() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": CONTAMINATION_SQL,
        "op6_jaccard_join": _components(85),
        "op8_mix_sources": MIX_SQL,
        "op10_substring_dedup": REPEATED_SQL,
        "op11_centroid_clusters": CLUSTERS_SQL,
        "op12_minhash_dedup": _components(80, ", doc_id = coalesce(other, doc_id) as kept"),
    }
