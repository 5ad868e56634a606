"""Licence notices in DuckDB SQL."""

from sleevenotes.llm.licences import PERCENT, TEMPLATES

BIGRAMS = (
    "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    " from (select *, list_filter(string_split_regex({text}, '[^a-z0-9]+'), lambda x: x != '') as w from {table})"
)
VALUES = ", ".join(f"('{name}', '{text.lower()}')" for name, text in sorted(TEMPLATES.items()))
LICENCE_SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, lower(coalesce(text, '')) as t from documents
), paragraphs as (
  select rid, unnest(string_split_regex(t, '\n[ \t\r]*\n')) as unit from d
), units as (
  select rid, unnest(string_split(t, chr(10))) as unit from d
  union all select rid, unit from paragraphs where contains(unit, chr(10))
), u as (
  select rid, row_number() over () as uid, {BIGRAMS.format(text="unit", table="units").replace(" from ", " as b from ", 1)}
), templates(name, body) as (values {VALUES}), t as (
  select name, {BIGRAMS.format(text="body", table="templates").replace(" from ", " as b from ", 1)}
), compared as (
  select rid, uid, name, len(list_intersect(u.b, t.b)) as shared, len(u.b) + len(t.b) as sizes from u, t
), best as (
  select rid, uid, name, 2.0::double * shared / sizes as dice from compared where 200 * shared >= {PERCENT} * sizes
  qualify row_number() over (partition by rid, uid order by 2.0::double * shared / sizes desc, name) = 1
), found as (
  select rid, count(*) as n, string_agg(distinct name, ',' order by name) as names, max(dice) as best_dice from best group by rid
)
select doc_id, coalesce(n, 0)::bigint as n_notices, coalesce(names, '') as licences, coalesce(best_dice, 0) as best_dice
from d left join found using (rid)
"""
