"""DuckDB SQL for op11 to op13, written from their contracts and not from their methods."""

from __future__ import annotations

#: crc32 of bytes, bit by bit: the table of 256 values follows from the polynomial.
_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"

SPELLING_SQL = rf"""
with crc as materialized (select {_CRC_TABLE} as t),
runs as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as r from documents) where length(r) >= 7 group by 1, 2),
hashed as (
  select r, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(b) + 1), lambda i: cast('0x' || hex(b)[2 * i - 1 : 2 * i] as bigint))),
    lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) as h
  from (select *, encode(concat(doc_id, ':', r)) as b from runs), crc),
words as materialized (
  select word, cast(sum(times) as bigint) as n from (
    select case when h % 31 = 0 then r[1 : h % length(r)] || r[h % length(r) + 2 :] else r end as word, times from hashed)
  where length(word) >= 7 group by word having sum(times) >= 2),
less as materialized (select word, n, i, word[1 : i - 1] || word[i + 1 :] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word, b.word as near, b.n as near_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word and length(a.word) = length(b.word)
  union select l.word, w.word, w.n from less l join words w on l.rest = w.word
  union select w.word, l.word, l.n from less l join words w on l.rest = w.word),
best as (
  select word, count(*) as n_near, max(near_n) as most, min(near) filter (where near_n = top) as near
  from (select *, max(near_n) over (partition by word) as top from pairs) group by word),
formed as materialized (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.most >= 10 * w.n then b.near end as form, case when b.most >= 10 * w.n then b.most end as form_n
  from words w left join best b on w.word = b.word),
walk as (
  with recursive r(word, here) as (select word, word from formed union all select r.word, f.form from r join formed f on r.here = f.word where f.form is not null) select * from r),
ends as (select r.word, r.here as root from walk r join formed f on r.here = f.word where f.form is null)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n from formed f join ends e on f.word = e.word
"""

WINDOWS_SQL = r"""
with texts as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as materialized (
  select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from texts where len(ws) >= 50)),
least as (select h, min(doc_id) as first from windows group by h having min(doc_id) < max(doc_id)),
gone as (select doc_id, i from windows join least using (h) where first < doc_id),
words as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from texts),
flagged as (
  select w.doc_id, w.w, w.i, max(g.i) over (partition by w.doc_id order by w.i rows between 49 preceding and current row) is not null as removed
  from words w left join gone g on w.doc_id = g.doc_id and w.i = g.i),
sums as (select doc_id, count(*) filter (where removed) as n_removed, string_agg(w, ' ' order by i) filter (where not removed) as kept from flagged group by doc_id)
select t.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from texts t left join sums s on t.doc_id = s.doc_id
"""


def _centroids_sql(dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64) -> str:
    distance = "cast(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    parts = [
        f"""v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"c0 as materialized (select row_number() over (order by h) - 1 as j, v as c from (select v, sha256('1:' || vec_id) as h from v order by h limit {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select v.rid, min({{'d': {distance}, 'j': c.j}}) as m from v cross join c{r} c group by v.rid)")
        if r < rounds:
            parts.append(f"""s{r} as (select j, i, sum(x) as s, count(*) as n from (select a.m.j as j, unnest(range(1, {dims + 1})) as i, unnest(v.v) as x from a{r} a join v on a.rid = v.rid) group by j, i),
m{r} as (select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{r} group by j),
c{r + 1} as materialized (select c.j, coalesce(m.c, c.c) as c from c{r} c left join m{r} m on c.j = m.j)""")
    return (
        "with " + ",\n".join(parts) + f"""
select v.vec_id, cast(a.m.j as integer) as cluster, a.m.d as distance, cast(sum(a.m.d) over (partition by a.m.j) as bigint) as cluster_inertia, cast(sum(a.m.d) over () as bigint) as inertia,
  sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join v on a.rid = v.rid join c{rounds} c on a.m.j = c.j"""
    )


CENTROIDS_SQL = _centroids_sql()
