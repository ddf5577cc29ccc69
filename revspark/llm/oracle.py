"""DuckDB SQL for the operators whose whole result SQL can express.

The others (byte windows, templates, weak credentials, classifiers, page text) are held against plain Python in tests/llm.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_DECONTAMINATION = f"""
with items as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
phrases as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select item, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
lengths as (select distinct n from phrases),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
places as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)),
found as (select p.r, p.i, p.n, q.item from places p join phrases q on p.n = q.n and p.phrase = q.phrase),
hits as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from found) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids
          from (select distinct r, item from found where item is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (r) left join named using (r)
"""

_JACCARD = f"""
with recursive docs as (select row_number() over () as r, doc_id, {_BLANK_WORDS.format(_LOWER)} as w from documents),
shingles as (
  select distinct r, s from (
    select r, array_to_string(w[i:i + 2], ' ') as s
    from (select r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from docs where len(w) > 0))),
sizes as (select r, count(*) as n from shingles group by r),
pairs as (
  select a.r as x, b.r as y, count(*) as shared from shingles a join shingles b on a.s = b.s
  join sizes m on m.r = a.r join sizes n on n.r = b.r
  where a.r < b.r and 10 * least(m.n, n.n) >= 9 * greatest(m.n, n.n) group by 1, 2),
links as (
  select x, y from pairs join sizes m on m.r = x join sizes n on n.r = y
  where 100 * shared >= 90 * (m.n + n.n - shared)),
sides as (select x, y from links union all select y, x from links),
reach(a, b) as (
  select r, r from sizes
  union
  select reach.a, sides.y from reach join sides on sides.x = reach.b)
select d.doc_id, cast(coalesce(any_value(n), 0) as bigint) as n_shingles,
       coalesce(min(e.doc_id), d.doc_id) as component_id
from docs d left join sizes using (r) left join reach on reach.a = d.r left join docs e on e.r = reach.b
group by d.r, d.doc_id
"""

_QUALITY = rf"""
with docs as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, {_BLANK_WORDS.format("coalesce(text, '')")} as w from documents),
lines as (
  select r, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as l from docs)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
windows as (
  select r, i, array_to_string(w[i:i + 4], ' ') as s from (select r, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) >= 5)),
twice as (select r, i from (select r, i, count(*) over (partition by r, s) as c from windows) where c > 1),
repeats as (select r, count(distinct k) as n_repeat_words from (select r, unnest(range(i, i + 5)) as k from twice) group by r),
counts as (
  select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from docs left join lines using (r) left join repeats using (r)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts),
hosts as (select source, count(*) as n, count(*) filter (base_failed) as f from judged where source is not null group by source),
sums as (
  select sum(n) as n, sum(f) / sum(n) as mean, sum(n * (f / n) * (f / n)) as q, sum(cast(n as double) * n) as squares, count(*) as k from hosts),
moments as (
  select mean, mean * (1 - mean) as spread, q - n * mean * mean - (k - 1) * mean * (1 - mean) as seen, n - squares / n - (k - 1) as room
  from sums),
prior as (
  select mean, case when seen <= 0 or room <= 0 then 1e6 else least(1e6, greatest(1.0, spread * room / seen - 1)) end as strength
  from moments),
verdicts as (select source, (f + mean * strength) / (n + strength) <= 0.5 as host_ok from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(host_ok, true) as kept
from judged left join verdicts using (source)
"""

_WARC = r"""
with own as (
  select page_id, regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]', '%20', 'g') as url,
         cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as first from own where payload_bytes >= 100 group by 1),
typed as (
  select own.*, case when first is not null and page_id is distinct from first then first end as refers_to
  from own left join firsts using (payload_digest))
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type,
       refers_to, url
from typed
"""

_SUBSTRINGS = f"""
with docs as (select row_number() over () as r, doc_id, {_BLANK_WORDS.format("coalesce(text, '')")} as w from documents),
windows as (
  select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as s
  from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from docs where len(w) >= 13 and doc_id is not null)),
firsts as (select s, min(doc_id) as least from windows group by s),
gone as (
  select r, list_distinct(flatten(list(range(i, i + 13)))) as k from windows join firsts using (s) where least < doc_id group by r),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as p from docs),
lost as (select r, unnest(k) as p from gone),
kept as (
  select r, string_agg(word, ' ' order by p) as t from words anti join lost using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(k), 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from docs left join gone using (r) left join kept using (r)
"""

_HARD_NEGATIVES = """
with taking as (
  select row_number() over () as r, vec_id, embedding as e, cast(label as bigint) as label from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
v as (
  select r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [cast(floor(256 * cast(y as double)) as bigint) for y in e] as x
  from taking),
scores as (
  select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as id, a.label = b.label as same,
         cast(coalesce(list_sum([a.x[i] * b.x[i] for i in range(1, least(len(a.x), len(b.x)) + 1)]), 0) as bigint) as score
  from v a join v b on a.r != b.r where a.vec_id % 100 = 0),
positives as (
  select ar, anchor_id, id as positive_id, score as positive_score,
         row_number() over (partition by ar order by score desc, id) as slot
  from scores where same qualify slot <= 5),
negatives as (
  select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score,
         row_number() over (partition by p.ar, slot order by score desc, id) as rank
  from positives p join (select ar, id, score, same from scores) s on s.ar = p.ar and not s.same
    and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
  qualify rank <= 10)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negatives
"""

_COLLOCATIONS = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from cut group by lang),
places as (
  select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
  from cut, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as c from places group by 1, 2, 3),
often as (select lang, k, phrase, string_split(phrase, ' ') as w, c from f where c >= 30),
cuts as (
  select o.lang, o.phrase, o.c as a, j, x.c as l, y.c as r,
         cast((2000000::hugeint * o.c) // (x.c + y.c) as bigint) as score
  from (select *, unnest(range(1, k)) as j from often where k > 1) o
  join often x on x.lang = o.lang and x.phrase = array_to_string(o.w[1:j], ' ')
  join often y on y.lang = o.lang and y.phrase = array_to_string(o.w[j + 1:o.k], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(c) as most
  from (select lang, w, c, m, unnest(range(1, k - m + 2)) as i
        from often, (select unnest([2, 3]) as m) where k > m) group by 1, 2),
ranked as (
  select b.lang, b.phrase, a, l, r, score, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase
  where most is null or 100::hugeint * most < 80::hugeint * a)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

SQL = {
    "op3_decontamination": _DECONTAMINATION,
    "op4_jaccard_join": _JACCARD,
    "op5_quality_rules": _QUALITY,
    "op7_warc": _WARC,
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op12_collocations": _COLLOCATIONS,
    "op13_substring_dedup": _SUBSTRINGS,
}
