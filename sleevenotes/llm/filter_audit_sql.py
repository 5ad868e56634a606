"""The filter interaction audit in DuckDB SQL."""

FILTER_AUDIT_SQL = r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), split as (
  select *, list_filter(string_split_regex(t, '[ \x09-\x0D]+'), lambda w: w <> '') as words, min(doc_id) over (partition by t) as earliest from docs
), flags as (
  select doc_id, part,
    case when len(words) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > earliest then 16 else 0 end as failed
  from split
), marks as (
  select doc_id, bool_or(quality is not distinct from 1) as good, bool_or(toxic is not distinct from 1) as toxic
  from labels where doc_id is not null group by doc_id
), marked as (
  select part, failed, count(*) as n, count(*) filter (coalesce(good, false)) as good, count(*) filter (coalesce(toxic, false)) as toxic
  from flags left join marks using (doc_id) group by part, failed
), filters as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, own)
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
  from filters a, filters b, filters c, filters d, filters e where a.own + b.own + c.own + d.own + e.own = 31
    and (a.own | b.own | c.own | d.own | e.own) = 31
), steps as (
  select filter_order, step, f.own,
    (select coalesce(sum(g.own), 0) from filters g where position(g.letter in o.filter_order) < o.step)::int as before
  from (select filter_order, unnest(range(1, 6)) as step from orders) o join filters f on f.letter = substring(o.filter_order, o.step::int, 1)
), counted as (
  select part, filter_order, step::int as step, own,
    coalesce(sum(n) filter ((failed & (before | own)) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter ((failed & before) = 0 and (failed & own) <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter ((failed & before) <> 0 and (failed & own) <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (failed = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter ((failed & before) = 0 and (failed & own) <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter ((failed & before) = 0 and (failed & own) <> 0), 0)::bigint as toxic_lost
  from marked, steps group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, own)::bigint as shapley
from counted
"""
