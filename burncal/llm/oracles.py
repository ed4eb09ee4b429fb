"""DuckDB SQL of the manifest, the mix and the centroids."""

from __future__ import annotations

#: The bytes of a value with their number before them, or a dash.
_TOLD = "coalesce(strlen({0})||':'||{0}, '-')"
_LEAF = "sha256(" + "||".join(_TOLD.format(c) for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", "{text}")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "xor(list_reduce(list_transform(range(1, len(cast(doc_id as varchar))+1), lambda i: cast(ascii(substr(cast(doc_id as varchar), cast(i as int), 1)) as bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)+1]), 4294967295), 4294967295)"


def _levels(name: str, base: str) -> str:
    """All levels of the trees of `base` (g, p, d, n): eight consecutive nodes become one."""
    return f"{name}(g, l, p, d, n) as (select g, 0, p, d, n from {base} union all select g, l+1, p//8, sha256(string_agg(d, '' order by p)), (n+7)//8 from {name} where n > 1 group by g, l, p//8, n)"


def _steps(tree: str, rows: str, first: str) -> str:
    """For each row (id, g, p) and level of its tree: what stands before and after its ancestor in the run of eight."""
    return f"""select w.id, {first} + w.l as k, coalesce(string_agg(q.d, '' order by q.p) filter (q.p < w.own), '') as before, coalesce(string_agg(q.d, '' order by q.p) filter (q.p > w.own), '') as after
 from (select r.id, r.g, r.base, h.l, r.p >> (3*h.l) as own from {rows} r join (select g, unnest(range(max(l))) as l from {tree} group by g) h on h.g=r.g) w
 join {tree} q on q.g=w.g and q.l=w.l and q.p//8=w.own//8 group by w.id, w.l, w.base"""


OP11 = f"""with recursive tab as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1)*3988292384), i)) as tab),
rw as materialized (select doc_id, coalesce('1'||lang, '0') as g, {_LEAF.format(text="text")} as leaf, case when {_CRC} % 3 = 0 then {_LEAF.format(text=_LOWER)} end as changed from documents, tab),
pl as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf)-1 as p, count(*) over (partition by g) as n, row_number() over (order by g, doc_id nulls first, leaf) as id from rw),
lv as (select g, p, leaf as d, n from pl), {_levels("t", "lv")},
tm as materialized (select * from t),
sr as materialized (select g as lang, d as subroot, l as height, row_number() over (order by g)-1 as p, count(*) over () as n from tm where n = 1),
tb as (select '' as g, p, subroot as d, n from sr), {_levels("u", "tb")},
um as materialized (select * from u),
root as (select d as root from um where n = 1),
d1 as (select id, g, p, 0 as base from pl), d2 as (select pl.id, '' as g, sr.p, sr.height as base from pl join sr on sr.lang=pl.g),
st as materialized ({_steps("tm", "d1", "w.base")} union all {_steps("um", "d2", "w.base")}),
f(id, k, d) as (select id, 0, coalesce(changed, leaf) from pl union all select f.id, f.k+1, sha256(before||f.d||after) from f join st on st.id=f.id and st.k=f.k),
fo as (select id, arg_max(d, k) as folded_root from f group by id),
pf as (select id, sha256(string_agg(before||after, '' order by k)) as proof from st group by id)
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root=root as verified
from pl join sr on sr.lang=pl.g join fo using (id) left join pf using (id), root"""

OP12 = """with recursive s as materialized (select doc_id, coalesce('1'||source, '2') as g, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents),
so as materialized (select *, [5, 2, 1][cast((i-1)%3+1 as int)] as w, cast(sum(z) over () as bigint) as tot, count(*) over () as m from (select g, cast(sum(size) as bigint) as z, row_number() over (order by g) as i from s group by g) x),
fill(k, i, fixed, z, w, tot, m) as (select 0, i, false, z, w, tot, m from so union all
 select k+1, i, fixed or rest*w > 4*z*ws, z, w, tot, m from (select *, 3*tot - 4*sum(case when fixed then z else 0 end) over () as rest, sum(case when fixed then 0 else w end) over () as ws from fill where k < m) x),
fr as (select *, 3*tot - 4*sum(case when fixed then z else 0 end) over () as rest, sum(case when fixed then 0 else w end) over () as ws from fill where k = m),
tg as (select i, tot, case when fixed then 2*z else rest*w end as num, case when fixed then 1 else 2*ws end as den from fr),
bl as (select greatest(1, cast(min(num//den) as bigint)//256) as block from tg where num > 0),
sb as materialized (select so.g, so.i, z, cast(num as double)/cast(den as double) as target, cast(num as hugeint) as num, cast(den as hugeint) as den, coalesce(block, 1) as block, (z+coalesce(block, 1)-1)//coalesce(block, 1) as b, (3*so.tot+coalesce(block, 1))//(2*coalesce(block, 1)) as whole from so join tg using (i) left join bl on true),
q as (select *, row_number() over (order by (num*cast(100000000000000000000 as hugeint))//(den*(2*s+1)) desc, i) as r from (select i, num, den, whole, unnest(range(2*b)) as s from sb) x),
se as (select i, count(*) as seats from q where r <= whole group by i),
od as materialized (select sb.*, coalesce(seats, 0) as seats, list_filter(range(cast(a0 as bigint), cast(a0 as bigint)+500), lambda x: gcd(x, b) = 1)[1] as step, cast(c0 as bigint) as start
 from (select *, 1+cast('0x'||substr(md5('12:'||g), 1, 8) as ubigint) % greatest(1, b) as a0, cast('0x'||substr(md5('12:'||g), 9, 8) as ubigint) % greatest(1, b) as c0 from sb) sb left join se using (i)),
pl as materialized (select row_number() over () as id, s.*, cast(sum(size) over (partition by g order by doc_id nulls first, size rows unbounded preceding) - size as bigint) as first from s),
wd as (select pl.id, least((j+1)*block, first+size) - greatest(j*block, first) as words, greatest(0, (seats - ((j%b)*step+start)%b + b - 1)//b) as turns from
 (select id, g, first, size, unnest(range(first//block, (first+size-1)//block+1)) as j from (select pl.*, block from pl join od using (g) where size > 0) x) pl join od using (g)),
tk as (select id, cast(sum(words*turns) as bigint) as taken from wd group by id)
select doc_id, size, z as source_size, target, coalesce(taken, 0) as taken from pl join od using (g) left join tk using (id)"""


def _centroids(rounds: int = 10) -> str:
    near = "select vec_id, c, d from (select *, row_number() over (partition by vec_id order by d, c) as r from (select v.vec_id, c, cast(sum((v.x-c.x)*(v.x-c.x)) as bigint) as d from v join {0} c on c.i=v.i group by 1, 2) x) y where r = 1"
    parts = [
        """k as materialized (select vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
v as materialized (select vec_id, i, cast(floor(1024*cast(embedding[i] as double)) as bigint) as x from k, range(1, 65) g(i)),
c0 as materialized (select c, i, x from (select vec_id, row_number() over (order by sha256('3:'||vec_id))-1 as c from k order by sha256('3:'||vec_id) limit 8) s join v using (vec_id))"""
    ]
    for n in range(rounds):
        parts.append(f"a{n} as materialized ({near.format(f'c{n}')})")
        parts.append(
            f"c{n + 1} as materialized (select c.c, c.i, coalesce(m.x, c.x) as x from c{n} c left join (select c, i, cast((s - ((s % n) + n) % n)//n as bigint) as x from (select c, i, sum(x) as s, count(*) as n from a{n} join v using (vec_id) group by 1, 2) y) m on m.c=c.c and m.i=c.i)"
        )
    parts.append(f"a as materialized ({near.format(f'c{rounds}')})")
    parts.append(f"h as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by c)")
    return f"with {', '.join(parts)} select vec_id, cast(c as int) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256 from a join h using (c)"


OP13 = _centroids()
