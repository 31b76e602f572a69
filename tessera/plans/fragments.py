"""SQL of the derived corpus: sentences, tokens, entities by rule and their pairs."""

SENT = "select doc_id, sent, cast(b as int) as begin, cast(b + length(s) as int) as end, s as text from (select doc_id, sent, s, coalesce(sum(length(s) + 1) over (partition by doc_id order by sent rows between unbounded preceding and 1 preceding), 0) as b from (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(len(string_split(text, chr(10))))) as sent from documents)) where s <> ''"
TOK = f"select doc_id, sent, unnest(p) as token, unnest(range(len(p))) as idx from (select doc_id, sent, regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]') as p from ({SENT}))"
CAPS = f"select doc_id, sent, min(idx) as first, max(idx) as last from (select *, idx - row_number() over (partition by doc_id, sent order by idx) as run from ({TOK}) where idx > 0 and regexp_matches(token, '^[A-Z]')) group by doc_id, sent, run"
PAIRS = f"select a.doc_id, a.sent, a.first as first_a, b.first as first_b, b.first - a.last as distance from ({CAPS}) a join ({CAPS}) b on a.doc_id = b.doc_id and a.sent = b.sent and a.first < b.first"
