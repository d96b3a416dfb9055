"""SQL (DuckDB) for the queries that SQL can express, written in another form than the operators."""

from __future__ import annotations

# CRC-32 bit by bit: the table of 256 remainders follows from the reflected polynomial 0xEDB88320.
CRC32 = """
remainders as (
  select list(c order by n) as t from (
    select n, list_reduce([n::bigint, 1, 2, 3, 4, 5, 6, 7, 8],
        lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c
    from range(256) r(n))
)"""


def crc32(hexadecimal: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits; needs the remainders in the from clause."""
    byte = f"('0x' || substr({hexadecimal}, 2 * i + 1, 2))::bigint"
    codes = f"list_transform(range(length({hexadecimal}) // 2), lambda i: {byte})"
    step = "lambda a, b: xor(a >> 8, remainders.t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), {step}), 4294967295::bigint)"


JUMPS = """
jumps as (
  select k0, n, 0::bigint as hop, -1::bigint as shard, k0::hugeint as k from keys, (values (24), (25)) s(n)
  union all
  select k0, n, floor((hop + 1)::double * (2147483648.0::double / ((nk // 8589934592)::double + 1.0::double)))::bigint, hop, nk
  from (select *, (k * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint as nk from jumps where hop < n)
)"""

ORACLES: dict[str, str] = {
    "op3_sharding": f"""
with recursive {CRC32},
rowsin as (
  select doc_id, octet_length(encode(text)) as bytes, hex(encode(text)) as body, hex(encode(doc_id::varchar)) as name from documents),
measured as (
  select doc_id, coalesce(bytes, 0) + 8 as size, {crc32('body')} as text_crc32, coalesce({crc32('name')}, 0) as name_crc32,
    coalesce(doc_id, 0) as k0
  from rowsin, remainders),
keys as (select distinct k0 from measured),
{JUMPS},
ends as (select k0, max(shard) filter (n = 24 and hop >= 24) as shard, max(shard) filter (n = 25 and hop >= 25) as grown_shard from jumps group by k0),
buckets as (select greatest(1, ceil(count(*) / 48000.0))::bigint as b from measured)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  (row_number() over (partition by shard order by name_crc32 % b, doc_id nulls first, text_crc32 nulls first, size) - 1)::bigint as slot,
  grown_shard::int as grown_shard
from measured join ends using (k0), buckets""",
    "op7_topk": """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
components as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from whole),
scores as (
  select a.vec_id as query_id, b.vec_id, sum(a.x * b.x) as score
  from components a join components b on a.d = b.d and a.vec_id <> b.vec_id
  where a.vec_id % 50 = 0 group by all)
select query_id, rank::int as rank, vec_id, score::bigint as score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 5""",
    "op13_negatives": """
with named as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings),
whole as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from named
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
components as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from whole),
products as (
  select a.vec_id as anchor_id, b.vec_id, sum(a.x * b.x)::bigint as score
  from components a join components b on a.d = b.d and a.vec_id <> b.vec_id
  where a.vec_id % 100 = 0 group by all),
scores as (
  select p.*, a.label = b.label as same from products p
  join whole a on a.vec_id = p.anchor_id join whole b on b.vec_id = p.vec_id),
positives as (
  select * from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
  row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10""",
    "op11_spelling": f"""
with recursive {CRC32},
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
each as (select doc_id, run, count(*) as times from runs where length(run) >= 7 group by all),
hashed as (select *, {crc32("hex(encode(coalesce(doc_id::varchar, '') || ':' || run))")} as h from each, remainders),
changed as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed),
words as (select word, sum(times)::bigint as n from changed where length(word) >= 7 group by word having sum(times) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1)) as pos from words),
gaps as (select word, n, substr(word, 1, pos - 1) as head, substr(word, pos + 1) as tail from places),
near as (
  select a.word, b.word as other, b.n from gaps a join gaps b on a.head = b.head and a.tail = b.tail and a.word <> b.word
  union select g.word, w.word, w.n from gaps g join words w on w.word = g.head || g.tail
  union select w.word, g.word, g.n from gaps g join words w on w.word = g.head || g.tail),
best as (select word, count(*) as n_near, arg_min(other, struct_pack(a := -n, b := encode(other))) as other, max(n) as other_n from near group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * w.n then other end as form, case when other_n >= 10 * w.n then other_n end as form_n
  from words w left join best using (word)),
chains as (
  select word, word as root from forms
  union all select c.word, f.form from chains c join forms f on f.word = c.root where f.form is not null),
ends as (select c.word, c.root from chains c join forms f on f.word = c.root where f.form is null)
select f.word, form, root, n, n_near, form_n from forms f join ends using (word)""",
}
