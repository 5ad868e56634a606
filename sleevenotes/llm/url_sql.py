"""URL rules in DuckDB SQL."""

from sleevenotes.llm.text import LOWER, UPPER


def url_sql(rules: list[tuple[str, str]], default: str) -> str:
    values = ", ".join(f"('{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{a}')" for a, t in rules)
    return rf"""
with rules(host, path, action) as (values {values}),
p as (
  select row_number() over () as row, page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
  from pages
), best as (
  select row, r.host || r.path as rule, action
  from p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  qualify row_number() over (partition by row order by length(r.host || r.path) desc, length(r.host) desc) = 1
)
select page_id, host, path, rule, coalesce(action, '{default}') as verdict from p left join best using (row)
"""
