"""DuckDB SQL for the queries that SQL can express, written without the operators' code paths."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from documents
), normal as (
  select doc_id, source, raw, pos, lower(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) as line from lines
), bad as (
  select line from normal where length(line) >= 20 group by line having count(distinct coalesce('s' || source, 'n')) >= 5
), kept as (
  select doc_id, count(*) as n_lines, count(*) filter (where line in (select line from bad)) as n_removed,
         coalesce(string_agg(raw, chr(10) order by pos) filter (where line not in (select line from bad)), '') as text
  from normal group by doc_id
)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, cast(length(coalesce(k.text, '')) as bigint) as kept_chars,
       md5(coalesce(k.text, '')) as kept_md5
from documents left join kept k using (doc_id)
"""

OP7 = r"""
with sized as (
  select doc_id, source, md5('mix:' || doc_id) as key,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
), src as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighted as (
  select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from src
), levels as (
  -- the level if exactly the sources with a smaller size for their weight are capped
  select w.source,
         (sum(o.source_size) * 3 - coalesce(sum(o.source_size) filter (where o.source_size / o.weight < w.source_size / w.weight), 0) * 4)
         / cast(2 * sum(o.weight) filter (where o.source_size / o.weight >= w.source_size / w.weight) as double) as level,
         w.source_size, w.weight
  from weighted w, weighted o group by w.source, w.source_size, w.weight
), chosen as (
  select arg_min(level, source_size / weight) filter (where level * weight <= 2 * source_size) as level from levels
), goals as (
  select source, source_size, weight, least(cast(2 * source_size as double), coalesce(c.level * weight, 2 * source_size)) as target,
         (source_size + 31) // 32 as blocks, case when source is null then '1' else '0' || source end as src
  from weighted, chosen c
), seats as (
  select src, row_number() over (order by target / (2 * j + 1) desc, src) as r
  from (select src, target, unnest(range(0, 2 * blocks + 2)) as j from goals)
), house as (
  select floor(sum(target) / 32 + 0.5) as k from goals
), quotas as (
  select g.*, least(coalesce(q.seats, 0), 2 * blocks) as seats
  from goals g left join (select src, count(*) as seats from seats, house where r <= k group by src) q using (src)
), plan as (
  select *, case when blocks > 0 then cast('0x' || substr(md5('mix/start:' || src), 1, 8) as bigint) % blocks else 0 end as start,
         case when blocks > 0 then seats // blocks else 0 end as epochs from quotas
), spans as (
  select *, seats - epochs * blocks as rest from plan
), lined as (
  select s.doc_id, s.size, p.*,
         coalesce(sum(s.size) over (partition by p.src order by s.key, s.size rows between unbounded preceding and 1 preceding), 0) as pos
  from sized s join spans p on s.source is not distinct from p.source
)
select doc_id, size, source_size, target,
       cast(size * epochs
         + greatest(0, least(pos + size, least(start + rest, blocks) * 32) - greatest(pos, start * 32))
         + greatest(0, least(pos + size, greatest(start + rest - blocks, 0) * 32) - pos) as bigint) as taken
from lined
"""


OP8 = r"""
with docs as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), grams as (
  select doc_id, i, hash(list_slice(words, i, i + 7)) as gram
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from docs)
), repeated as (
  select doc_id, i from grams qualify count(*) over (partition by doc_id, gram) > 1
), covered as (
  select doc_id, count(distinct i + k) as n from repeated, range(0, 8) t(k) group by doc_id
), base as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from docs left join covered c using (doc_id)
), lines as (
  select doc_id, source, len(string_split(norm, ' ')) as n, norm from (
    select doc_id, source, trim(regexp_replace(regexp_replace(translate(unnest(lines), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as norm from docs)
  where len(string_split(norm, ' ')) >= 3
), above as (
  select source, norm from lines l
  group by source, norm having count(distinct doc_id) > greatest(20, 0.02 * (select count(*) from documents d where d.source is not distinct from l.source))
), lost as (
  select l.doc_id, sum(l.n) as lost from lines l join above a on l.norm = a.norm and l.source is not distinct from a.source group by l.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(lost, 0) <= 0.5 * n_words as kept
from base left join lost using (doc_id)
"""


OP11 = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, min(turn) over (partition by conv_id) as first,
         cast('0x' || substr(sha256(coalesce(cast(conv_id as varchar), '') || ':' || turn), 1, 8) as bigint) as h
  from conversations where turn is not null
), sent as (
  select conv_id, turn, first, h % 12 as batch, role, role || '|' || text as payload from turns
  union all select conv_id, turn, first, (h + 3) % 12, 'user', 'user|' || text from turns where h % 7 < 2
), arrived as (
  select * from sent qualify row_number() over (partition by conv_id, turn, batch order by payload, role) = 1
), heard as (
  select conv_id, batch, lead(batch) over (partition by conv_id order by batch) as next from (select distinct conv_id, batch from arrived)
), closed as (
  select conv_id, coalesce(min(batch + 3) filter (where coalesce(next, 12) - batch > 3), 12) as closing from heard group by conv_id
), kept as (
  select a.*, closing, a.batch <= closing as live from arrived a join closed c on a.conv_id is not distinct from c.conv_id
), first_kept as (
  select *, turn - row_number() over w + 1 as start, max(batch) over w as released,
         coalesce(lag(turn) over w = turn - 1 and lag(role) over w = role, false) as breaks
  from (select * from kept where live qualify row_number() over (partition by conv_id, turn order by batch) = 1)
  window w as (partition by conv_id order by turn)
)
select 'release' as event, sha256(payload) as sha256, conv_id, turn, released as batch, cast(null as bigint) as n_missing, cast(null as bigint) as n_breaks
from first_kept where start = first
union all
select 'reject', sha256(payload), conv_id, turn, batch, null, null from kept where not live
union all
select 'close', sha256(coalesce(string_agg(cast(turn as varchar), ',' order by turn) filter (where start <> first), '')), conv_id, -1, closing,
       max(turn) - first + 1 - count(*), count(*) filter (where breaks)
from first_kept group by conv_id, first, closing
"""

OP12 = """
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d
  from documents
), drawn as (
  select *, cast(len(tokens) as bigint) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
         cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4
  from cut
), parts as (
  select doc_id, text, n, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:], '') as suffix,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from drawn)
)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""


def op1() -> str:
    from tessera.llm.hilbert_shards import curve_table

    curve = curve_table(3, 4)
    text_code = lambda col: f"cast('0x' || rpad(substr(hex(encode({col})), 1 + 2 * skip_{col}, 12), 12, '0') as bigint)"
    # length of the common prefix of the smallest and largest value, in bytes
    skip = lambda col: f"(select coalesce(max(i), 0) from range(0, 64) t(i) where i <= least(octet_length(encode(min_{col})), octet_length(encode(max_{col}))) and substr(hex(encode(min_{col})), 1, 2 * i) = substr(hex(encode(max_{col})), 1, 2 * i))"
    number = "(length(bin(v + 4)) - 1) * 4 + ((v + 4) >> (length(bin(v + 4)) - 3)) % 4"
    scale = lambda col: f"case when lo_{col} = hi_{col} or {col}_code is null then 0 else (({col}_code - lo_{col}) * 15) // (hi_{col} - lo_{col}) end"
    return f"""
with bounds as (
  select min(source) as min_source, max(source) as max_source, min(lang) as min_lang, max(lang) as max_lang from documents
), skips as (
  select {skip("source")} as skip_source, {skip("lang")} as skip_lang from bounds
), coded as (
  select doc_id, encode(coalesce(text, '')) as raw, {text_code("source")} as source_code, {text_code("lang")} as lang_code,
         (select {number} from (select case when n_chars is not null then greatest(n_chars, 0) end as v)) as n_code
  from documents, skips
), scaled as (
  select *, min(source_code) over () as lo_source, max(source_code) over () as hi_source,
         min(lang_code) over () as lo_lang, max(lang_code) over () as hi_lang, min(n_code) over () as lo_n, max(n_code) over () as hi_n
  from coded
), crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as crcs from range(256) t(n)
), celled as (
  select doc_id, cast(octet_length(raw) + 16 as bigint) as size,
         xor(list_reduce(list_transform(range(octet_length(raw)), lambda i: cast('0x' || substr(hex(raw), 2 * i + 1, 2) as bigint)),
             lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) as text_crc32,
         ({curve})[1 + {scale("source")} * 256 + {scale("lang")} * 16 + {scale("n")}] as cell,
         cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 2) as int) % 64 as sub
  from scaled, crc_table
), ranked as (
  select *, row_number() over (order by cell, sub, doc_id, size, text_crc32) - 1 as rank, count(*) over () as total from celled
)
select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast(rank * 40 // total as int) as shard,
       cast(row_number() over (partition by rank * 40 // total order by rank) - 1 as bigint) as slot, cast(null as int) as grown_shard
from ranked
"""


def sql() -> dict[str, str]:
    return {"op1_hilbert_shards": op1(), "op2_line_spread": OP2, "op7_source_mix": OP7, "op8_line_quality": OP8, "op11_turn_reassembly": OP11, "op12_fill_middle": OP12}
