"""The quality rules in DuckDB SQL.

CRC-32 is folded over a list: each byte of the n-gram, then eight times -1 for the eight shifts.
"""

from sleevenotes.llm.quality_rules import BUCKETS, MIN_WORDS, PSEUDO, THRESHOLD

WORD = r"[^\x20\x09-\x0D]+"
QUALITY_SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select rid, doc_id, text, regexp_extract_all(text, '{WORD}') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines
  from d
), triples as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from w, unnest(range(1, len(w) - 1)) as p(i)
), again as (
  select rid, i from triples qualify count(*) over (partition by rid, g) > 1
), repeated as (
  select rid, count(distinct i + k) as n_repeat_words from again, unnest([0, 1, 2]) as o(k) group by rid
), good as (
  select distinct doc_id from labels where quality = 1
), grams as (
  select rid, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as gram from w
), hexed as (
  select gram, hex(gram) as h from (select distinct gram from grams)
), hashed as (
  select gram, xor(4294967295, list_reduce(
           [4294967295] || flatten([[strpos('0123456789ABCDEF', h[k]) * 16 + strpos('0123456789ABCDEF', h[k + 1]) - 17]
                                    || [-1, -1, -1, -1, -1, -1, -1, -1] for k in range(1, len(h), 2)]),
           lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end)) % {BUCKETS} as bucket
  from hexed
), bucketed as (
  select rid, doc_id, bucket from grams join hashed using (gram)
), counted as (
  select bucket, count(*) as n, count(*) filter (doc_id in (select doc_id from good)) as t from bucketed group by bucket
), shares as (
  select sum(t) / sum(n) as share from counted
), weights as (
  select bucket, case when share > 0 then ln((t + {PSEUDO} * share) / (n + {PSEUDO}) / share) else 0 end as weight
  from counted, shares
), scores as (
  select rid, avg(weight) as score from bucketed join weights using (bucket) group by rid
), base as (
  select w.rid, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(score, 0) as score
  from w left join repeated using (rid) left join scores using (rid)
), judged as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and score >= {THRESHOLD} as kept
from judged
"""
