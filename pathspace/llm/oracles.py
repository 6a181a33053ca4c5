"""DuckDB SQL for what it can express of the operators' results, written from their contracts."""

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"xor(list_reduce([4294967295::bigint] || list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), lambda s, c: list_reduce([xor(s, c)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


URL_RULES = r"""with p as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') path from pages)
select page_id, host, path, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/' when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
 when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from p"""

QUALITY_COUNTS = rf"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {_WORD}) w from documents),
win as materialized (select rid, i, array_to_string(w[i:i + 4], ' ') x from (select rid, w, unnest(range(1, len(w) - 3)) i from d)),
again as (select rid, unnest(range(i, i + 5)) k from win semi join (select rid, x from win group by rid, x having count(*) > 1) using (rid, x)),
rep as (select rid, count(distinct k) n from again group by rid),
c as (select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
 len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})))) n_dup_lines, coalesce(rep.n, 0) n_repeat_words from d left join rep using (rid))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from c"""

JACCARD = rf"""with recursive d as materialized (select row_number() over () rid, doc_id, regexp_extract_all({_LOW}, {_WORD}) w from documents),
s as materialized (select distinct rid, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end x from (select rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as materialized (select rid, count(*) n from s group by rid),
met as materialized (select a.rid a, b.rid b, count(*) k from s a join s b using (x) where a.rid <> b.rid group by a.rid, b.rid),
link as materialized (select a, b from met join n x on x.rid = a join n y on y.rid = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select rid a, rid b from d union select r.a, l.b from reach r join link l on l.a = r.b)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(o.doc_id) component_id from reach join d on d.rid = reach.a join d o on o.rid = reach.b left join n on n.rid = d.rid group by d.rid, d.doc_id"""

WORD_SCORES = rf"""with d as materialized (select row_number() over () rid, doc_id, {_crc32("doc_id::varchar")} % 7 = 2 held_out, list_append(regexp_extract_all({_LOW}, {_WORD}), 'the end') w from documents),
t as materialized (select rid, held_out, unnest(w) x from d), c as materialized (select x, count(*) c from t where not held_out group by x), total as (select sum(c) n, count(*) v from c)
select d.doc_id, d.held_out, count(*) n_tokens, count(c.c) n_known, any_value(total.n)::bigint train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (total.n + total.v + 1))), 4) base_score from t join d using (rid) left join c using (x), total group by d.rid, d.doc_id, d.held_out"""

EDITED_TEXTS = """with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, coalesce(lead(coalesce(text, '')) over (order by doc_id), first_value(coalesce(text, '')) over (order by doc_id)) following from documents)
select doc_id, n n_chars, sha256(left(t, n - n // 2) || left(following, n // 2)) edited_sha256 from d"""

ORACLES = {"url_rules": URL_RULES, "quality_counts": QUALITY_COUNTS, "op8_ngram_jaccard": JACCARD, "word_scores": WORD_SCORES, "edited_texts": EDITED_TEXTS}
