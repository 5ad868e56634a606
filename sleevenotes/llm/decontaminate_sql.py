"""Benchmark passages in documents, in DuckDB SQL."""

from sleevenotes.llm.decontaminate import WINDOW
from sleevenotes.llm.text import LOWER, UPPER

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(UPPER, LOWER)
DECONTAMINATE_SQL = f"""
with d as (
  select row_number() over () as rid, doc_id, {WORDS} as w from documents
), b as (
  select item_id, {WORDS} as w from benchmark
), windows as (
  select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[i : i + {WINDOW} - 1], ' ') as g
  from b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as p(i) where len(w) > 0
), sizes as (
  select distinct n from windows
), places as (
  select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as g from d, sizes, unnest(range(1, len(w) - n + 2)) as p(i)
), found as (
  select rid, i, n, item_id from places join windows using (n, g)
), hit as (
  select rid, count(distinct i + k) as n_hit from (select distinct rid, i, n from found), unnest(range(0, n)) as o(k) group by rid
), items as (
  select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names
  from (select distinct rid, item_id from found) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join items using (rid)
"""
