"""DuckDB SQL for the registered queries that SQL can express."""

from . import chat, licences, merkle, trie, urls

MIXING = r"""
with t as (
  select doc_id, source, coalesce(text, '') as x from documents
), r as (
  select doc_id, source, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))::bigint as size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / greatest(0.05, 1.0 - 4.0 * (length(x) - length(translate(x, '#*$%&|<>{}[]^~=@_', ''))) / greatest(length(x), 1)) as k
  from t
), s as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from r group by source
), f as (
  select *, sum(source_size) over () as total, sum(w) over () as weights,
    coalesce(sum(source_size) over (order by source_size * 6 / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as gone,
    coalesce(sum(w) over (order by source_size * 6 / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as spent
  from s
), u as (
  select *, (total - 3 * gone)::double / (weights - spent) as unit from f
), g as (
  select source, source_size, least((select coalesce(arg_min(unit, spent), 'inf'::double) from u where unit * w <= 3 * source_size) * w, (3 * source_size)::double) as target from u
), p as (
  select r.*, g.source_size, g.target, sum(size) over (partition by r.source order by k, doc_id, size rows unbounded preceding) - size as start
  from r join g on r.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  case when source_size = 0 then 0 else (least(3, floor(target / source_size)) * size
    + greatest(0, least(size, floor(target + 0.5) - least(3, floor(target / source_size)) * source_size - start)))::bigint end as taken
from p
"""

ORACLES: dict[str, str] = {"op1_license_scan": licences.duckdb_sql(), "op2_mix_sources": MIXING, "op10_url_filter": urls.duckdb_sql(), "op10_url_filter_whole": urls.duckdb_sql(), "op11_conversation_trie": trie.duckdb_sql(), "op12_merkle_manifest": merkle.duckdb_sql(), "op13_chat_examples": chat.duckdb_sql()}
