"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

OP1 = rf"""
with p as (
  select page_id,
    translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') as path
  from pages),
seen as (
  select host, count(*) filter (l.quality in (0, 1)) as n, coalesce(sum(l.quality) filter (l.quality in (0, 1)), 0) as k
  from p left join labels l on l.doc_id = p.page_id group by host),
hosts as (
  select host, n, k, regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '([^.]*\.)?[^.]*$') as domain,
    regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '[^.]*$') as suffix
  from seen),
domains as (select suffix, domain, sum(n) as n, sum(k) as k from hosts group by suffix, domain),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by suffix),
s0 as (select suffix, n, k, 1.0::double as u, (select (sum(k) + 1) / (sum(n) + 2)::double from suffixes) as m from suffixes),
s1 as (select * replace (case when n > 0 then 1 else u * c / (c + 1) end as u) from (select *, (select 1 / greatest(least(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1 / 3.0::double), 1 / 1001.0::double) - 1 from s0) as c from s0)),
d0 as (select d.suffix, domain, d.n, d.k, u, (s1.k + c * m) / (s1.n + c) as m from domains d join s1 using (suffix)),
d1 as (select * replace (case when n > 0 then 1 else u * c / (c + 1) end as u) from (select *, (select 1 / greatest(least(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1 / 3.0::double), 1 / 1001.0::double) - 1 from d0) as c from d0)),
h0 as (select h.host, h.n, h.k, u, (d1.k + c * m) / (d1.n + c) as m from hosts h join d1 using (domain)),
h1 as (select * replace (case when n > 0 then 1 else u * c / (c + 1) end as u) from (select *, (select 1 / greatest(least(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1 / 3.0::double), 1 / 1001.0::double) - 1 from h0) as c from h0)),
h2 as (select host, (k + c * m) / (n + c) as mean, case when n > 0 then n + c else 1 / (1 - u) - 1 end as strength from h1),
rules(verdict, rule) as (values ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
parts as (select verdict, rule, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp from rules),
keyed as (select p.*, row_number() over () as r from p),
best as (
  select r, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from keyed join parts on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by r)
select page_id, host, path, rule,
  coalesce(verdict, case when mean + 2 * sqrt(mean * (1 - mean) / (strength + 1)) < 0.5 then 'block' else 'allow' end) as verdict
from keyed left join best using (r) join h2 using (host)
"""

OP4 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as rep from p where n >= 1000 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when rep is not null and page_id is distinct from rep then 'revisit' else 'response' end as record_type,
  case when rep is not null and page_id is distinct from rep then rep end as refers_to
from p left join g on p.d = g.d and p.n >= 1000
"""

_STOP = "the of and to in is that was for on with as are this from by at be a der die das und ist von zu mit den dem ein eine nicht auf für sich im le la les de des et est un une dans que pour qui sur avec pas du au el los las y en por con se su una para del es"

OP9 = rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
grams as (
  select r, i, md5(array_to_string(ws[i:i + 7], ' ')) as g from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from grams) where c > 1),
rep as (select r, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words from (select r, i, lead(i) over (partition by r order by i) as nxt from twice) group by r),
m as (
  select r, doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) as n_letters, length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_upper,
    len(list_filter(ws, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in _STOP.split())}))) as n_stop, len(list_distinct(ws)) as n_distinct
  from t join w using (r) left join rep using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 1.5 and 25 and n_symbols / nullif(word_chars, 0) <= 0.1 and n_stop / n_words >= 0.02
  and coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 and coalesce(n_upper / nullif(n_letters, 0), 0) <= 0.7 and n_distinct / n_words >= 0.02 as kept
from b
"""

OP6 = r"""
with recursive w as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select distinct r, g from (select r, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w)),
n as (select r, count(*) as n from s group by r),
p as (select a.r as a, b.r as b, count(*) as c from s a join s b using (g) where a.r < b.r group by a.r, b.r),
l as (select a, b from p join n x on x.r = a join n y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from l union all select b, a from l),
reach(r, t) as (select r, r from w union select reach.r, b from reach join both_ways on a = t)
select w.doc_id, coalesce(n, 0) as n_shingles, (select min(o.doc_id) from reach join w o on o.r = t where reach.r = w.r) as component_id
from w left join n using (r)
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
with d as (select row_number() over () as r, doc_id, unnest({_TERMS}) as term from documents),
i as (select i, item_id, term, count(*) as c from (select row_number() over () as i, item_id, unnest({_TERMS}) as term from benchmark) group by all),
f as (select r, doc_id, term, count(*) as tf from d group by all),
s as (select r, sum(tf)::bigint as n from f group by r),
g as (select count(*) as docs, sum(n)::bigint as terms from s),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double))::bigint as w from f, g where term in (select term from i) group by term, docs),
u as (
  select r, doc_id, f.term, w, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)) as u
  from f join w using (term) join s using (r), g),
scored as (select i, item_id, r, doc_id, sum(c * w * u)::bigint as score from i join u using (term) group by all),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""

# crc32 of the id as text, bit by bit, the lowest bit of a byte first
_CRC = """xor(list_reduce(flatten(list_transform(string_split(x::varchar, ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k) & 1))),
  lambda crc, b: xor(crc >> 1, 3988292384 * (xor(crc, b) & 1)), 4294967295::bigint), 4294967295)"""

OP13 = rf"""
with c as (select conv_id::bigint as c, turn, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as d,
    octet_length(encode(coalesce(text, '')))::bigint as b from conversations where conv_id is not null),
own as (select c, list({{'d': d, 'b': b}} order by turn nulls first, substr(d, 1, 30)) as ts, c - c % 5 as base from c group by c),
cut as (select *, {_CRC.replace("x::varchar", "c::varchar")} % 9 as h from own),
built as (select x.c, list_concat(coalesce(y.ts[1:x.h], []), x.ts[x.h + 1:]) as ts from cut x left join own y on y.c = x.base),
members as (select c, len(ts) as size, unnest(range(0, len(ts) + 1)) as depth, ts from built),
keyed as (select c, size, depth, array_to_string(list_transform(ts[1:depth], lambda t: t.d), '') as key, coalesce(ts[depth].b, 0) as b from members),
nodes as (select depth, key, min(c) as conv_id, count(*) as n, min(b) as b, coalesce(string_agg(c::varchar, ',' order by c) filter (size = depth), '') as ends from keyed group by all),
kids as (select depth - 1 as depth, left(key, (depth - 1) * 64) as key, count(*) as n_children from nodes where depth > 0 group by all),
below as (select n.*, unnest(range(0, depth + 1)) as up, coalesce(n_children, 0) as n_children from nodes n left join kids using (depth, key)),
sums as (select up as depth, left(key, up * 64) as key, sum((n_children = 0)::bigint)::bigint as n_leaves, sum((n - 1) * b)::bigint as saved_tokens from below group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, sha256(n.ends) as ends_sha256
from nodes n left join kids using (depth, key) join sums using (depth, key) left join nodes p on p.depth = n.depth - 1 and p.key = left(n.key, p.depth * 64)
"""

ORACLES: dict[str, str] = {
    "op1_host_reputation": OP1,
    "op4_warc_round_trip": OP4,
    "op6_ngram_join": OP6,
    "op9_quality_rules": OP9,
    "op11_ball_search": OP11,
    "op13_prefix_trie": OP13,
}
