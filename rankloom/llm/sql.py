"""The operators' results in DuckDB SQL, written from their definitions."""

OP2 = r"""
with d as (select doc_id, source as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
win as (select doc_id, i, array_to_string(words[i : i + 4], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from win) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(5) t(k) group by doc_id),
r as (select w.doc_id, host, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from w left join covered c using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from r),
f as (select host, unnest([{'rule': 'short', 'bad': n_words < 10}, {'rule': 'repeats', 'bad': 100 * n_repeat_words > 20 * n_words},
  {'rule': 'symbols', 'bad': 100 * n_symbols > 10 * n_words}, {'rule': 'lines', 'bad': 100 * n_dup_lines > 30 * n_lines}], recursive := true) from b),
h as (select host, rule, count(*) as n, count(*) filter (bad)::double as f from f group by host, rule),
m as (select rule, sum(f) / sum(n) as mean, sum(f * f / n) / sum(n) as sq, (count(*) - 1) / sum(n) as part from h group by rule),
p as (select rule, mean, case when sq - mean * mean - mean * (1 - mean) * part > 1e-12 then greatest(mean * (1 - mean) / (sq - mean * mean - mean * (1 - mean) * part) - 1, 2) end as k from m),
s as (select host, rule, mean, n, k, round(case when k is null then mean else (f + mean * k) / (n + k) end, 9) as rate from h join p using (rule)),
v as (select host, max(rate) filter (rule = 'short') as rate_short, max(rate) filter (rule = 'repeats') as rate_repeats, max(rate) filter (rule = 'symbols') as rate_symbols,
  max(rate) filter (rule = 'lines') as rate_lines, bool_or(rate - case when k is null then 0 else 2 * sqrt(rate * (1 - rate) / (n + k + 1)) end > greatest(0.2, 3 * mean)) as host_failed from s group by host)
select b.doc_id, b.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rate_short, rate_repeats, rate_symbols, rate_lines, host_failed, not base_failed and not host_failed as kept
from b join v on b.host is not distinct from v.host
"""

OP3 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id, doc_id as c from d union select r.doc_id, l.b from r join l on l.a = r.c)
select r.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.c) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""

OP4 = r"""
with l as (select doc_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
s as (select doc_id, i, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) as w from l),
k as (select doc_id, i, array_to_string(w, ' ') as k, w from s where len(w) >= 1),
f as (select k, any_value(w) as w, min(doc_id * 1000000 + i) as first from k group by k),
t as (select k, len(w) as n, unnest(w) as x from f),
df as (select x, count(*) as c from t group by x),
p as (select k, n, t.x, row_number() over (partition by k order by c, t.x) as r from t join df on df.x = t.x),
pre as (select * from p where r <= n - ceil(n * 4 / 5.0) + 1),
c as (select distinct a.k as a, b.k as b from pre a join pre b on a.x = b.x and a.k < b.k and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m as (select a, b, x.first as fa, y.first as fb from c join f x on x.k = a join f y on y.k = b where 5 * len(list_intersect(x.w, y.w)) >= 4 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))),
late as (select distinct case when fa < fb then b else a end as k from m),
gone as (select doc_id, i from k join f using (k) where k.k in (from late) or doc_id * 1000000 + i <> first),
kept as (select l.doc_id, count(*) as n_lines, count(g.i) as n_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '') as t from l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select d.doc_id, case when text is null then 0 else n_lines end as n_lines, n_removed, length(t) as n_chars, md5(t) as text_md5 from documents d join kept using (doc_id)
"""

OP8 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
  md5(coalesce(doc_id::varchar, '') || ':' || coalesce(source, '') || ':' || md5(coalesce(text, ''))) as key from documents),
s as (select source, sum(size) as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from d group by source),
c as (select *, 3 * source_size / w as stop, sum(source_size) over () as budget,
  coalesce(sum(3 * source_size) over (order by 3 * source_size / w, source rows between unbounded preceding and 1 preceding), 0) as stopped,
  sum(w) over (order by 3 * source_size / w, source rows between current row and unbounded following) as open from s),
l as (select arg_min((budget - stopped) / open, stop) as level from c where (budget - stopped) / open <= stop),
t as (select source, source_size, least(level * w, 3 * source_size)::double as target, budget from c, l),
q as (select d.*, source_size, target, budget, sum(size) over (partition by d.source order by key) as reach from d join t on d.source is not distinct from t.source),
i as (select doc_id, key, turn, size, budget, (turn * source_size + reach) / target as finish from q, range(3) r(turn) where target > 0 and turn * source_size + reach - size < target),
o as (select doc_id, size, sum(size) over (order by finish, key, turn rows between unbounded preceding and current row) <= budget as served from i),
n as (select doc_id, count(*) as times from o where served group by doc_id)
select q.doc_id, source, size, source_size::bigint as source_size, target, (size * coalesce(times, 0))::bigint as taken, coalesce(times, 0)::int as times from q left join n using (doc_id)
"""

OP9 = r"""
with tbl as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end, n::bigint)) as t),
d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as bytes from documents),
e as (select doc_id, len(bytes) + 1 as size,
  xor(list_reduce(list_transform(bytes, lambda b: ('0x' || b)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32 from d, tbl),
draws as (select doc_id, shard, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || shard), 1, 13))::bigint + 0.5) / 4503599627370496.0) as x from (select distinct doc_id from documents), range(17) r(shard)),
best as (select doc_id, arg_min(shard, x) filter (shard < 16) as shard, arg_min(shard, x) as grown_shard from draws group by doc_id)
select e.doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by e.doc_id nulls first, text_crc32) - 1 as slot, grown_shard::int as grown_shard
from e join best b on e.doc_id is not distinct from b.doc_id
"""

OP10 = r"""
with t as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, role, text) as n from conversations),
size as (select conv_id, count(*) as n, max(n) filter (role = 'assistant') as last from t group by conv_id),
reply as (select conv_id, arg_max(text, n) as text from t where role = 'assistant' group by conv_id),
c as (select t.conv_id as pair_id, t.n, t.role, t.text, s.last, r.text as other from t join size s using (conv_id) left join reply r on r.conv_id = xor(t.conv_id, 1)),
r as (select pair_id, n, role, case when n = last then other else text end as text from c where last is null or other is not null or n < last),
j as (select c.pair_id, c.n, c.role, c.text as a, r.text as b, r.n is not null as has from c left join r using (pair_id, n)),
k as (select pair_id, coalesce(min(n) filter (a is distinct from b or not has), max(n) + 1) - 1 as k from j group by pair_id),
x as (select pair_id, n, n <= k as shared, role, a, b, has, '<|im_start|>' || coalesce(role, 'none') || chr(10) as head from j join k using (pair_id)),
y as (select *, head || replace(a, '<|', '< |') || '<|im_end|>' || chr(10) as ra, case when has then head || replace(b, '<|', '< |') || '<|im_end|>' || chr(10) end as rb from x),
z as (select *, coalesce(sum(length(ra)) over (partition by pair_id, shared order by n rows between unbounded preceding and 1 preceding), 0) as sa,
  coalesce(sum(length(rb)) over (partition by pair_id, shared order by n rows between unbounded preceding and 1 preceding), 0) as sb from y)
select pair_id, count(*) filter (shared)::int as n_prompt_turns, coalesce(string_agg(ra, '' order by n) filter (shared), '') as prompt, coalesce(string_agg(ra, '' order by n) filter (not shared), '') as chosen,
  coalesce(string_agg(rb, '' order by n) filter (not shared and has), '') as rejected,
  coalesce(string_agg((sa + length(head))::bigint || '-' || (sa + length(ra) - 1)::bigint, ',' order by n) filter (not shared and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg((sb + length(head))::bigint || '-' || (sb + length(rb) - 1)::bigint, ',' order by n) filter (not shared and has and role = 'assistant'), '') as rejected_spans
from z group by pair_id
"""

OP12 = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select id, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from o group by all having count(distinct id) >= 10),
l as (select lang, count(*) as v, sum(n) as n_lang from k group by lang),
c as (select o.lang, source, o.term, count(*) as n from o join k on k.lang = o.lang and k.term = o.term group by all),
g as (select d.lang, d.source, (select coalesce(sum(n), 0) from c where c.lang = d.lang and c.source = d.source) as n from (select distinct lang, source from d) d),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.n + 2 * v) as p, 1 + 1000000000::hugeint * (k.n + 2) // (n_lang + 2 * v) as q
  from g join l on l.lang = g.lang join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pair as (select x.lang, x.source, 'pair' as part, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
none as (select x.lang, x.source, 'pair', y.source, 0 from g x join g y on x.lang = y.lang and x.source <> y.source where x.lang not in (select lang from l)),
term as (select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q),
u as (from pair union all from none union all from term)
select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u qualify part = 'pair' or rank <= 10
"""
