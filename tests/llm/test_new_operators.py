"""The manifest, the mix and the centroids against plain versions, and on awkward tables."""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burncal.llm import centroids, merkle, mixing, order
from burncal.llm.common import cut

WIDE = "doc_id long, source string, lang string, n_chars long, text string, group string, pos long, n long, digest string, path string, size long, total long, before long, tie long, part int, cluster int, v array<int>"


def wide(spark, rows):
    """Rows (doc_id, source, lang, n_chars, text) with further columns whose names the operators use themselves."""
    rest = ("g", 1, 2, "d", "p", 3, 4, 5, 6, 7, 8, [9])
    return spark.createDataFrame([(*r, *rest) for r in rows], WIDE).repartition(5)


def H(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf(row) -> bytes:
    return H(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in row))


def levels(nodes: list[bytes]) -> list[list[bytes]]:
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([H(b"".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def climb(tree: list[list[bytes]], p: int):
    """(before, after) of the place p on each level."""
    for nodes in tree[:-1]:
        run = p // 8 * 8
        yield b"".join(nodes[run:p]), b"".join(nodes[p + 1 : run + 8])
        p //= 8


def plain_manifest(rows) -> Counter:
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    placed = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf((r[0], r[1], r[2], r[3], r[4])))) for g in names}
    trees = {g: levels([leaf(r) for r in placed[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names]) if names else []
    out = Counter()
    for k, g in enumerate(names):
        for p, r in enumerate(placed[g]):
            path = [*climb(trees[g], p), *climb(top, k)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf((*r[:4], text))
            for a, b in path:
                folded = H(a + folded + b)
            out[(r[0], trees[g][0][p].decode(), trees[g][-1][0].decode(), top[-1][0].decode(), H(b"".join(a + b for a, b in path)).decode(), folded.decode(), folded == top[-1][0])] += 1
    return out


DOCS = [
    (1, "s", "en", 3, "Abc"), (2, None, "en", None, None), (3, "s", None, 0, ""), (3, "s", None, 0, ""), (None, "s", "en", 1, "N"), (None, "s", "en", 2, "nn"), (-7, "ß", "é", -1, "日本 Z"),
    (9, "s", "", 5, "x " * 30_000), *((i, "hot", "de", i % 5, f"Text {i % 7} É") for i in range(100, 180)), *((i, "t", f"l{i:03d}", 1, "Q") for i in range(200, 212)), *[(500, "dup", "xx", 1, "Same")] * 40,
]
MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("depth", [1, 2, 4])  # trees of many blocks, and of one
@pytest.mark.parametrize("rows", [DOCS, DOCS[:1], DOCS[2:4], []], ids=["all", "one", "copies", "none"])
def test_manifest(spark, depth, rows):
    found = merkle.manifest(wide(spark, rows), depth).select(*MANIFEST).collect()
    assert Counter(map(tuple, found)) == plain_manifest(rows)


def test_proofs_show_changes(spark):
    found = {r.doc_id: r.verified for r in merkle.manifest(wide(spark, [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(300)])).collect()}
    assert {i for i, v in found.items() if not v} == {i for i in range(300) if i % 2 and zlib.crc32(str(i).encode()) % 3 == 0}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700), st.integers(0, 10**6))
def test_siblings_by_index(n, seed):
    digests = [H(b"%d %d" % (seed, i)).decode() for i in range(n)]
    tree = levels([d.encode() for d in digests])
    paths = merkle.paths_of(merkle.matrices(digests, merkle.levels_of(n, 9)))
    assert paths == [list(climb(tree, p)) for p in range(n)]


def test_running(spark):
    """Totals inside a group, with many equal rows and nulls."""
    rows = [("a", i % 5 if i % 4 else None, i % 3) for i in range(500)] + [("b", 1, 1)] * 300 + [("c", None, 7)]
    found = order.running(cut(spark.createDataFrame(rows, "g string, k long, n long").repartition(6)), "g", ["k"], "n").collect()
    for g in "abc":
        own = sorted((r for r in found if r.g == g), key=lambda r: (r.before, r.n))
        assert [r.k is not None and r.k + 1 for r in own if r.n] == sorted(r.k is not None and r.k + 1 for r in own if r.n)
        assert all(a.before + a.n == b.before for a, b in zip(own, own[1:])) and own[0].before == 0
        assert {r.total for r in own} == {sum(n for x, _, n in rows if x == g)}
    counted = order.running(cut(spark.createDataFrame(rows, "g string, k long, n long")), "g", ["k"]).collect()
    assert sorted((r.g, r.before) for r in counted) == sorted([("a", i) for i in range(500)] + [("b", i) for i in range(300)] + [("c", 0)])


def test_targets():
    assert mixing.targets_of([100, 100, 100], [5, 2, 1]) == [200, Fraction(500, 3), Fraction(250, 3)]  # 281 is over 200; the excess is shared anew
    assert mixing.targets_of([0, 10], [5, 2]) == [0, 15]
    assert mixing.targets_of([], []) == []
    assert sum(mixing.targets_of([3, 1, 4, 1, 5, 9, 2, 6], [5, 2, 1, 5, 2, 1, 5, 2])) == Fraction(3, 2) * 31


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 7), st.integers(1, 40)), min_size=1, max_size=9), st.integers(0, 120))
def test_apportion(sources, seats):
    """Seat by seat: the highest quotient gets the next one."""
    targets, most = [Fraction(a, b) for a, b, _ in sources], [m for _, _, m in sources]
    heap = [(-t, i, 0) for i, t in enumerate(targets) if t > 0]
    heapq.heapify(heap)
    expected = [0] * len(targets)
    for _ in range(seats):
        if heap:
            _, i, s = heapq.heappop(heap)
            expected[i] += 1
            if s + 1 < most[i]:
                heapq.heappush(heap, (-targets[i] / (2 * s + 3), i, s + 1))
    assert mixing.apportion(targets, seats, most) == expected


def test_seats_grow():
    """More seats take none away, so quotas of shards are differences."""
    targets = [Fraction(1000, 7), Fraction(50), Fraction(1, 3), Fraction(50)]
    each = [mixing.apportion(targets, n, [10**9] * 4) for n in range(400)]
    assert all(sum(x) == n for n, x in enumerate(each)) and all(a <= b for x, y in zip(each, each[1:]) for a, b in zip(x, y))


def test_apportion_without_walking_seats():
    found = mixing.apportion([Fraction(10**15), Fraction(10**9), Fraction(1)], 10**12, [10**14] * 3)
    assert sum(found) == 10**12 and abs(found[1] - 10**6) <= 1


def plain_mix(rows, shards=mixing.SHARDS, seed=mixing.SEED):
    """Word by word: every word of every source in order, its block, and the seats of the block."""
    words = {k: len((r[4] or "").encode().split()) for k, r in enumerate(rows)}
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(words[k] for k, r in enumerate(rows) if r[1] == s) for s in names]
    targets = mixing.targets_of(size, [(5, 2, 1)[i % 3] for i in range(len(names))])
    block = max(1, int(min((t for t in targets if t > 0), default=1)) // 256)
    whole = math.floor(sum(targets) / block + Fraction(1, 2))
    blocks = [-(-s // block) for s in size]
    got = mixing.apportion(targets, whole, [2 * b for b in blocks])
    out = Counter()
    for i, s in enumerate(names):
        step, start = mixing.order_of(seed, "2" if s is None else "1" + s, blocks[i])
        order_ = sorted(range(blocks[i]), key=lambda j: (j * step + start) % blocks[i])
        turns = Counter(order_[n % blocks[i]] for n in range(got[i]))
        at = 0
        for k in sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, words[k])):
            taken = sum(turns[w // block] for w in range(at, at + words[k]))
            at += words[k]
            out[(rows[k][0], s, words[k], size[i], float(targets[i]), taken)] += 1
    return out


@pytest.mark.parametrize("rows", [DOCS, DOCS[:8], DOCS[1:4], [(None, None, "x", 1, "a b c")] * 9 + [(4, "z", "x", 1, "d")], []], ids=["all", "few", "empty", "nulls", "none"])
def test_mix(spark, rows):
    found = mixing.mix(wide(spark, rows)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in found) == plain_mix(rows)
    assert all(r.taken == sum(s.words for s in r.shards) <= 2 * r.size for r in found)


def test_mix_reaches_targets(spark):
    rows = [(i, f"s{i % 4}" if i % 5 else "big", "en", 1, "word " * (17 * i % 400 + 1)) for i in range(3000)]
    found = mixing.mix(wide(spark, rows)).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target
    shards = Counter()
    for r in found:
        for s in r.shards:
            shards[(s.shard, r.source)] += s.words
    each = [sum(n for (k, _), n in shards.items() if k == shard) for shard in range(mixing.SHARDS)]
    assert max(each) - min(each) <= 0.02 * max(each)
    assert {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in mixing.mix(wide(spark, rows[::-1])).collect()}


def near(x, c):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, row)) for row in c]
    return min(range(len(c)), key=lambda i: (d[i], i)), min(d)


def plain_clusters(rows, k=8, rounds=10):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in first]
    for _ in range(rounds):
        at = [near(v, c)[0] for _, v in good]
        for n in set(at):
            own = [v for (_, v), a in zip(good, at) if a == n]
            c[n] = [sum(col) // len(own) for col in zip(*own)]
    last = [near(v, c) for _, v in good]
    sums = Counter()
    for n, d in last:
        sums[n] += d
    return Counter((i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (n, d) in zip(good, last))


def vectors():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(5, 64))
    rows = [(i, [float(x) for x in (middle[i % 5] + rng.normal(size=64) * 0.3).astype(np.float32)]) for i in range(160)]
    same = [0.5] * 64
    rows += [(1000 + i, same) for i in range(90)] + [(77, same), (77, rows[3][1]), (None, rows[4][1]), (None, same)]
    return rows + [(2001, None), (2002, []), (2003, same[:63]), (2004, [*same, 0.5]), (2005, [None, *same[1:]]), (2006, [float("nan"), *same[1:]]), (2007, [float("-inf"), *same[1:]]), (2008, [-0.0] * 64), (2009, [-1e-5] * 64)]


VECTOR = "vec_id long, embedding array<float>, label int, cluster string, v string, x int, n int, s int, distance string"


@pytest.mark.parametrize("rows", [vectors(), vectors()[:3], [(1, [0.25] * 64)] * 12, vectors()[-9:-2], []], ids=["all", "few", "copies", "bad", "none"])
def test_clusters(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "c", "v", 2, 3, 4, "d") for r in rows], VECTOR).repartition(4)
    found = centroids.cluster(frame).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert Counter(map(tuple, found)) == plain_clusters(rows)


def test_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="component too large"):
        centroids.cluster(frame).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 60), st.integers(1, 5))
def test_sorted_scan(seed, k, n, spread):
    """Small coordinates, so that ties and distances of exactly twice are frequent; any centroid may be the one before."""
    rng = np.random.default_rng(seed)
    x, c, before = rng.integers(-spread, spread + 1, (n, 2)), rng.integers(-spread, spread + 1, (k, 2)), rng.integers(0, k, n)
    number, distance, tested = centroids.assign(x, before, c)
    assert [(a, d) for a, d in zip(number.tolist(), distance.tolist())] == [near(v, c.tolist()) for v in x.tolist()]
    assert tested <= n * k


def test_far_centroids_are_skipped():
    rng = np.random.default_rng(1)
    c = rng.integers(-10_000, 10_000, (8, 64))
    at = rng.integers(0, 8, 2000)
    _, _, tested = centroids.assign(c[at] + rng.integers(-100, 100, (2000, 64)), at, c)
    assert tested == 2000  # each vector lies so near its own centroid that no other is looked at


def test_sketches_join_node_by_node(spark):
    """A large group of near copies is in nearly every bucket of all tables; its sketches are joined once for each node, before buckets are split."""
    from burncal.llm import simhash

    rows = [(k, 1 << (k % 60), k) for k in range(60)]
    nodes = spark.createDataFrame(rows, "node long, f0 long, s0 long")
    found = simhash.near_edges(nodes, 4, 3, ("f0",), ("s0",), 64)
    assert " Join " not in found._jdf.queryExecution().optimizedPlan().toString().replace("+-", " ")
    root = list(range(60))
    for a, b in found.collect():
        low = min(root[a], root[b])
        root = [low if r in (root[a], root[b]) else r for r in root]
    assert set(root) == {0}


def test_pieces_are_made_in_small_turns(spark):
    """However long or short the texts of the incoming batches are, a worker segments about a megabyte at once, all rows in order; only a single longer text comes whole."""
    from types import SimpleNamespace

    import pyarrow as pa
    from burncal.llm import pieces

    rng = np.random.default_rng(3)
    lengths = [*rng.integers(0, 60_000, 300), 3_000_000, 0, *[0] * 700, *rng.integers(0, 900, 3000), 2_500_000]
    rows = [(k, None if k % 97 == 5 else "é" * (n // 2)) for k, n in enumerate(lengths)]
    whole = pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    for n in (1, 512, len(rows)):
        given = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema, n=n: list(run(iter(whole.to_batches(n)))))
        seen = pieces._gathered(given, lambda batch: batch, "doc_id long, text string", "text")
        assert pa.Table.from_batches(seen).equals(whole.combine_chunks())
        assert all(sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= 1_000_000 or b.num_rows == 1 for b in seen)
        assert len(seen) < 25  # many at a time
        assert pieces._gathered(SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: list(run(iter([])))), None, "", "text") == []


def test_secret_scans_hold_one_worker_a_task(spark, monkeypatch):
    """No step on Python workers feeds another one in the same task: both would hold a worker, and Spark keeps all workers for the steps after it."""
    from burncal.llm import common, secrets
    from tests.llm.data import frame
    from tests.llm.test_operators import planted

    steps = []

    def step(df, *given):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        steps.append("InArrow" in plan and "Repartition" not in plan)
        return common.map_batches(df, *given)

    monkeypatch.setattr(secrets, "map_batches", step)
    monkeypatch.setattr(secrets, "MAX_FINDINGS", 60)
    assert secrets.redact_secrets(frame(spark, planted()[0])).count() == len(planted()[0])
    assert len(steps) >= 5 and not any(steps)
