"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {
    "op6_line_dedup": """
with lines as (
  select doc_id, i, n, split[i] as line
  from (select doc_id, split, len(split) as n from (select doc_id, string_split(coalesce(text, ''), chr(10)) as split from documents)),
       unnest(range(1, n + 1)) as u(i)
), keyed as (
  select doc_id, i, n, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), held as (
  select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
)
select doc_id, max(n)::bigint as n_lines,
  (count(*) filter (where last is not null and last <> doc_id))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where last is null or last = doc_id), '')) as kept_sha256
from keyed left join held using (key) group by doc_id
""",
}
