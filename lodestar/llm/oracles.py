"""The queries that SQL can express, told in DuckDB's SQL."""

from __future__ import annotations

from lodestar.llm import contamination, quality, suffix, variants

TOPK = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) as v, row_number() over () as r
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.r as qr, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
      from e q join e c on q.r <> c.r where q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by qr order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from k where rank <= 5
"""


def _runs(length: int, tag: str) -> str:
    """Maximal runs (a, b) of the bytes of text ``r`` that strings of ``length`` bytes cover that start at two places or more."""
    return f"""
{tag}_parts as materialized (select r, p, substring(h, 2 * p + 1, {4 * length - 2}) as part from (select r, h, unnest(range(0, strlen(h) // 2 - {length - 1}, {length})) as p from d)),
{tag}_keys as materialized (select r, p + k as i, md5_number(substring(part, 2 * k + 1, {2 * length})) as m from (select r, p, part, unnest(range(strlen(part) // 2 - {length - 1})) as k from {tag}_parts)),
{tag}_starts as (select r, i, count(*) over (partition by m) as n from {tag}_keys),
{tag}_twice as (select r, i, i - lag(i) over (partition by r order by i) as gap from {tag}_starts where n > 1),
{tag}_runs as materialized (select r, min(i) as a, max(i) + {length} as b
         from (select r, i, sum((coalesce(gap, {length + 1}) > {length})::int) over (partition by r order by i) as run from {tag}_twice) group by r, run)"""


SUFFIX = f"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, row_number() over () as r from documents),{_runs(suffix.LENGTH, "l")},{_runs(suffix.PASSAGE, "p")},
cuts as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as since from l_runs),
sums as (select r, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' order by a) as head
         from cuts join d using (r) group by r),
short as (select r, count(*) as n from p_runs group by r)
select doc_id, (strlen(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256,
       coalesce(n_spans, short.n, 0)::bigint as n_passages, short.n is not null as has_repeat
from d left join sums using (r) left join short using (r)
"""


def _quality() -> str:
    word = r"[^\x20\x09-\x0D]"
    middle = quality.GAMMA, 2 / (1 + quality.GAMMA)
    value = "pow({0!r}, min(b) filter (m = '{m}' and b is not null and 4 * upto >= {i} * total)) * {1!r}"
    end = "min(case when b is null then 0.0 else pow({0!r}, b - {less}) end) filter (m = '{m}' and 100 * place > {of})"
    ends = {0: f"{100 - quality.TOP} * everything + 100", 4: f"{quality.TOP} * everything - 100"}

    def quartiles(tag: str, by: str, bins: str) -> str:
        found = [f"coalesce(sum(n) filter (m = '{m}' and b is not null), 0) as {tag}_n_{m}" for m in quality.MEASURES]
        found += [f"{value.format(*middle, m=m, i=i)} as {tag}_{m}_{i}" for m in quality.MEASURES for i in (1, 3)]
        found += [f"{end.format(quality.GAMMA, m=m, of=ends[i], less=int(i == 0))} as {tag}_{m}_{i}" for m in quality.MEASURES for i in (0, 4)]
        each = f"partition by {by}m"
        sums = f"sum(n) filter (b is not null) over ({each} order by b nulls first) as upto, sum(n) filter (b is not null) over ({each}) as total"
        sums += f", sum(n) over ({each} order by b nulls first) as place, sum(n) over ({each}) as everything"
        group = f"group by {by.rstrip(', ')}" if by else ""
        return f"select {by} coalesce(sum(n) filter (m = 'word_length'), 0) as {tag}_n, {', '.join(found)} from (select *, {sums} from {bins}) {group}"

    def shrunk(m: str, i: int, *tags: str) -> str:
        own = f"{tags[0]}_{m}_{i}"
        if len(tags) == 1:
            return own
        n, wider = f"{tags[0]}_n_{m}" if i in (1, 3) else f"{tags[0]}_n", shrunk(m, i, *tags[1:])
        return f"coalesce(({n} * {own} + {quality.PRIOR} * {wider}) / ({n} + {quality.PRIOR}), {wider})"

    bins = " union all ".join(f"select lang, source, '{m}' as m, case when {m} > 0 then ceil(ln({m}) / ln({quality.GAMMA!r}))::int end as b from f where not base_failed" for m in quality.MEASURES)
    fences, inside = [], ["not base_failed"]
    for m, below in quality.MEASURES.items():
        low, q1, q3, high = (shrunk(m, i, "g", "l", "c") for i in (0, 1, 3, 4))
        scaled = f"coalesce({q3} > {q1} and (g_n_{m} + {quality.PRIOR} * l_n_{m} / l_n) / (g_n + {quality.PRIOR}) >= {quality.LEAST_SHARE!r}, false)"
        for name, sign, q, plain in (("low", "-", q1, low), ("high", "+", q3, high)):
            fences.append(f"case when {scaled} then {q} {sign} {quality.SPREADS!r} * ({q3} - {q1}) else {plain} end as {m}_{name}")
        once = " or {} <= {}".format(*quality.ONCE[m]) if m in quality.ONCE else ""
        inside.append(f"(coalesce({m} <= {m}_high, true){once})")
        if below:
            inside.append(f"coalesce({m} >= {m}_low, true)")
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select *, regexp_extract_all(t, '{word}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as ls from d),
words as (select r, unnest(ws) as x, generate_subscripts(ws, 1) as i from w),
windows as (select r, i, x, lead(x) over next as y, lead(x, 2) over next as z from words window next as (partition by r order by i)),
seen as (select r, i, count(*) over (partition by r, x, y, z) as n from windows where z is not null),
again as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from seen where n > 1) group by r),
c as (select doc_id, lang, source, r, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(ls) as n_lines,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             coalesce(again.n, 0)::bigint as n_repeat_words
      from w left join again using (r)),
f as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(n_symbols / nullif(n_words, 0), 0) as symbol_rate,
             coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_rate, coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeat_rate,
             coalesce(word_chars / nullif(n_words, 0), 0) as word_length
      from c),
bins as (select lang, source, m, b, count(*) as n from ({bins}) group by all),
wide as (select lang, m, b, sum(n) as n from bins group by all),
all_bins as (select m, b, sum(n) as n from wide group by all),
g as ({quartiles("g", "lang, source, ", "bins")}),
l as ({quartiles("l", "lang, ", "wide")}),
c_row as ({quartiles("c", "", "all_bins")}),
fences as (select g.lang, g.source, {", ".join(fences)} from g join l on g.lang is not distinct from l.lang cross join c_row)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {" and ".join(inside)} as kept
from f left join fences on f.lang is not distinct from fences.lang and f.source is not distinct from fences.source
"""


QUALITY = _quality()


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaks(span: int) -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    windows = "select {keep}, i, n, array_to_string(ws[i:i + n - 1], ' ') as w from (select {keep}, ws, n, unnest(range(1, len(ws) - n + 2)) as i from {rows})"
    return f"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all({_lower("text")}, {words}) as ws from documents),
b as (select item_id::varchar as item, regexp_extract_all({_lower("text")}, {words}) as ws from benchmark),
items as (select item, ws, least(len(ws), {span}) as n from b where len(ws) > 0),
known as (select distinct item, n, w from ({windows.format(keep="item", rows="items")})),
sized as (select r, ws, n from d join (select distinct n from known) s on s.n <= len(d.ws)),
hits as materialized (select r, i, n, item from ({windows.format(keep="r", rows="sized")}) join known using (n, w)),
places as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
found as (select r, count(distinct item) as n_items, coalesce(string_agg(distinct item, ',' order by item), '') as ids from hits group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       n_hit is not null as contaminated
from d left join places using (r) left join found using (r)
"""


LEAKS = _leaks(contamination.SPAN)


def _crc_table() -> list[int]:
    """What the eight steps of crc32's polynomial make of each byte."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _variants(every: int) -> str:
    least, times = variants.LEAST_LETTERS, variants.TIMES
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::int::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint)"
    return f"""
with recursive crcs as materialized (select {_crc_table()}::bigint[] as t),
d as (select coalesce(doc_id::varchar, '') as id, regexp_extract_all({_lower("text")}, '[a-z\u00C0-\u00FF]{{{least},}}') as ws from documents),
seen as (select id, w, count(*) as n from (select id, unnest(ws) as w from d) group by id, w),
hashed as (select w, n, {crc} as h from (select w, n, hex(encode(id || ':' || w)) as x from seen), crcs),
kept as (select case when h % {every} = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end as word, n from hashed),
words as materialized (select word, sum(n)::bigint as n from kept where length(word) >= {least} group by word having sum(n) >= {variants.LEAST_COUNT}),
cuts as materialized (select word, i, word[:i - 1] || word[i + 1:] as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
pairs as materialized (
  select distinct a.word as u, a.rest as v from cuts a join words b on a.rest = b.word
  union select b.word, a.word from cuts a join words b on a.rest = b.word
  union select a.word, b.word from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word),
near as (select u as word, count(*) as n_near, arg_min(v, (-n, v)) as best, max(n) as best_n from pairs join words w on w.word = pairs.v group by u),
forms as materialized (select w.word, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= {times} * n then best end as form, case when best_n >= {times} * n then best_n end as form_n from words w left join near using (word)),
chain(word, reached, step) as (select word, word, 0 from forms union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.reached where f.form is not null),
roots as (select word, arg_max(reached, step) as root from chain group by word)
select word, form, root, n, n_near, form_n::bigint as form_n from forms join roots using (word)
"""


VARIANTS = _variants(31)
