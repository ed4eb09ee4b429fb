"""SimHash near-dedup: covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes of word shingles. To link all pairs within radius r without comparing all pairs, every bit
position i gets a non-zero vector m(i) of r+1 bits, and every non-zero vector v gives one table whose mask keeps the bits
with <m(i), v> = 1. The at most r bits in which two fingerprints differ span at most r dimensions, so some v is orthogonal
to all of them: that table's mask drops every differing bit and the pair collides there. No pair within the radius is lost.

Scale. Rows with one fingerprint are one node (the smallest doc_id), so copies never meet each other. Buckets are counted
before their members are gathered. A bucket with more than HEAVY fingerprints is split by a second, independent family of
masks over the same bits, with the same guarantee; as both masks together keep about 48 bits, what is left of a bucket has
a bound of about 2^16 fingerprints. Inside a bucket pairs are compared in numpy and only a spanning star is emitted.

Near copies. Fingerprints of shingles differ in about 10 bits at a similarity of 0.8, too many for a mask of every pattern, but those of
the distinct words differ less, as a changed word touches one word and five shingles. `near_copies` therefore looks for pairs within the
radius in any of PRINTS independent fingerprints of the distinct words, each with its covering masks. SKETCH further SimHash bits of the five-word
shingles then estimate a pair's similarity: at 0.8 they differ in 39 bits on average, with a deviation of 6, and pairs of up to MOST_BITS go on. All this
only proposes: of the proposed pairs of a bucket those of a spanning forest, the likest first, are taken, and each is a link only if the shingles of
its two texts, counted with repeats, are similar to 0.8 or more. So what is dropped has a near copy that counts show; a group of n texts costs each bucket n - 1
comparisons. Texts with the same shingles are one node.

Cases: null and empty texts, and texts without words, have fingerprint zero, linked like any other; very long texts count whole; ties
(a bit set in just half the hashes) are 0; rows with a null
doc_id keep their fingerprint and join the component of their fingerprint; repeated rows are kept; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burncal.llm.common import cut, id_and_text, map_batches, small_batches
from burncal.operators.components import connected_components

BITS = 64
HEAVY = 512
SHINGLE, PRINTS, SKETCH, MOST_BITS = 5, 4, 256, 50
SIMILAR = 0.8
WORDS = 200_000  # whose hashes a task keeps
CHUNK_ROWS = 65_536
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, words_per_shingle: int = 4, seed: int = 42) -> bytes:
    """The SimHash as 8 bytes, most significant first: a bit is 1 if it is set in over half the shingle hashes."""
    words = text.encode().lower().split()  # bytes: A-Z and the ASCII white space only
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) < words_per_shingle:
        raw = digest(b" ".join(words), seed)
    else:
        raw = b"".join([digest(s, seed) for s in map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle))))])
    return majority(raw, 8)


def majority(raw: bytes, size: int) -> bytes:
    """The bits that are set in over half of some hashes of `size` bytes each."""
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, size)
    counts = np.bincount((hashes + np.arange(0, 256 * size, 256)).ravel(), minlength=256 * size).reshape(size, 256) @ _BYTE_BITS
    return np.packbits(counts.ravel() * 2 > len(hashes)).tobytes()


def shingles_of(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    return list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))) if len(words) >= SHINGLE else [b" ".join(words)] if words else []


def similarity(a: Counter, b: Counter) -> float:
    """Common shingles by all shingles, counted with repeats; texts without words are alike."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    common = sum(min(n, many[s]) for s, n in few.items())
    return common / (a.total() + b.total() - common) if a or b else 1.0


def describe(text: str, known: dict[bytes, bytes]) -> bytes:
    """PRINTS fingerprints of the distinct words, SKETCH bits of the five-word shingles, and 8 bytes that all texts with the same shingles share; zero for a
    text without words."""
    words = text.encode().lower().split()
    if not words:
        return bytes(8 * PRINTS + SKETCH // 8 + 8)
    own = []
    for w in set(words):
        if (h := known.get(w)) is None:
            if len(known) >= WORDS:
                known.clear()
            h = known[w] = xxhash.xxh3_128_digest(w, 1) + xxhash.xxh3_128_digest(w, 2)
        own.append(h)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(s, 3) + digest(s, 4) for s in shingles_of(text)])
    same = np.frombuffer(raw, np.uint64).reshape(-1, 4)[:, 0].sum(dtype=np.uint64)  # wraps
    return majority(b"".join(own), 8 * PRINTS) + majority(raw, SKETCH // 8) + same.tobytes()


def covering_masks(radius: int, family: int = 0) -> list[int]:
    """One mask for each non-zero vector of radius+1 bits, as signed longs. Families assign vectors to bits differently."""
    vectors = (1 << (radius + 1)) - 1
    order = np.random.RandomState(1000 + family).permutation(BITS)
    of_bit = {int(bit): 1 + k % vectors for k, bit in enumerate(order)}
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << bit for bit, m in of_bit.items() if (m & v).bit_count() & 1)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join(fingerprint(t or "", words_per_shingle) for t in batch.column("text").to_pylist())
        return pa.record_batch([batch.column("doc_id"), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return map_batches(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, fp long")


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member) after the components of a and b have become one."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _stars(group: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) of the components that pairs of one group within the radius form. Groups are runs."""
    label = np.arange(len(fp))
    active, lag, held, size = np.arange(len(fp)), 1, [], 0
    while True:
        active = active[active + lag < len(fp)]
        active = active[group[active + lag] == group[active]]
        if not len(active):
            break
        near = active[np.bitwise_count(fp[active] ^ fp[active + lag]) <= radius]
        if len(near):
            held.append((near, near + lag))
            size += len(near)
        if size > 1 << 20:
            label = joined(label, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held, size = [], 0
        lag += 1
    if held:
        label = joined(label, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return node[linked], node[label[linked]]


def forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Which pairs form a spanning forest, the shortest first: every component takes its shortest pair to another one, again and again."""
    label, taken = np.arange(n), []
    weight = distance.astype(np.int64) * len(a) + np.arange(len(a))  # no two alike
    open_ = np.arange(len(a))
    while True:
        open_ = open_[label[a[open_]] != label[b[open_]]]
        if not len(open_):
            return np.concatenate(taken) if taken else open_
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[a[open_]], weight[open_])
        np.minimum.at(best, label[b[open_]], weight[open_])
        chosen = np.unique(best[best < np.iinfo(np.int64).max]) % len(a)
        taken.append(chosen)
        label = joined(label, a[chosen], b[chosen])


def _forest_edges(group: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, node) of one group within the radius, and within `most` bits of their sketches, that connect what all such pairs connect. Groups are runs."""
    active, lag = np.arange(len(fp)), 1
    a = b = d = np.zeros(0, np.int64)
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    while True:
        active = active[active + lag < len(fp)]
        active = active[group[active + lag] == group[active]]
        near = active[np.bitwise_count(fp[active] ^ fp[active + lag]) <= radius]
        bits = np.bitwise_count(sketch[near] ^ sketch[near + lag]).sum(1, dtype=np.int64)
        near, bits = near[bits <= most], bits[bits <= most]
        new.append((near, near + lag, bits))
        size += len(near)
        if size > 1 << 20 or not len(active):
            a, b, d = (np.concatenate([x, *(h[k] for h in new)]) for k, x in enumerate((a, b, d)))
            kept = forest(a, b, d, len(fp))  # a forest of forests spans the same
            a, b, d, new, size = a[kept], b[kept], d[kept], [], 0
        if not len(active):
            return node[a], node[b]
        lag += 1


def _link(batches: Iterator[pa.RecordBatch], radius: int, keys: int, most: int) -> Iterator[pa.RecordBatch]:
    """Reads rows (keys, fp, node, sketch) sorted by bucket, a whole number of buckets at a time, and yields star edges; with a sketch those of a forest of true pairs."""

    def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, fp, node, sketch = rows[:keys], rows[keys], rows[keys + 1], rows[keys + 2 :]
        sketch = np.stack(sketch, 1).view(np.uint64) if sketch else np.zeros((len(fp), 0), np.uint64)
        changes = np.zeros(len(fp), bool)
        for k in key:
            changes[1:] |= k[1:] != k[:-1]
        a, b = (_forest_edges if sketch.shape[1] else _stars)(np.cumsum(changes), fp.view(np.uint64), node, radius, sketch, most)
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        if len(held[0]) >= CHUNK_ROWS:
            last = np.ones(len(held[0]), bool)
            for k in held[:keys]:
                last &= k == k[-1]
            stop = len(last) - int(last.sum())  # the last bucket may go on in the next batch
            if stop:
                yield edges([h[:stop] for h in held])
                held = [h[stop:] for h in held]
    if held and len(held[0]):
        yield edges(held)


def near_edges(nodes: DataFrame, radius: int = 4, heavy: int = HEAVY, prints: tuple[str, ...] = ("fp",), sketch: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """(a, b): edges that connect exactly what pairs within the radius in one of the prints, and with at most so many different bits of
    all sketch columns, connect. `nodes` has node and these columns; rows are distinct in them."""

    def tables(columns: tuple[str, ...], family: int, number: str, key: str):
        masks = covering_masks(radius, family)
        every = [(j * len(masks) + i, p, m) for j, p in enumerate(columns) for i, m in enumerate(masks)]
        return F.explode(F.array(*(F.struct(F.lit(t).alias(number), F.col(p).bitwiseAND(F.lit(m)).alias(key), F.col(p).alias("fp")) for t, p, m in every)))

    keyed = nodes.select("node", tables(prints, 0, "t", "k").alias("s")).select("s.t", "s.k", "s.fp", "node")
    met = cut(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("t", "k"))).filter("n > 1").select("t", "k", "fp", "node", (F.col("n") > heavy).alias("is_heavy")))
    if sketch:  # joined node by node, not once for every bucket that a node is in: a node has at most as many as there are tables
        buckets = met.groupBy("node").agg(F.collect_list(F.struct("t", "k", "fp", "is_heavy")).alias("buckets"))
        met = cut(nodes.select("node", *sketch).join(buckets, "node")).select("node", *sketch, F.inline("buckets"))
    light = met.filter("not is_heavy").select("t", "k", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("k2"), "fp", "node", *sketch)
    second = met.filter("is_heavy").select("t", "k", "node", *sketch, tables(("fp",), 1, "t2", "k2").alias("s"))
    split = light.unionByName(second.select("t", "k", "s.t2", "s.k2", "s.fp", "node", *sketch))
    key = ["t", "k", "t2", "k2"]
    return split.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(lambda batches: _link(batches, radius, len(key), most), "a long, b long")


def near_components(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id reachable over links within the radius."""
    rows = cut(fingerprints(docs, words_per_shingle, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("node")))
    components = connected_components(near_edges(nodes.filter("node is not null"), radius, heavy))
    of_fp = nodes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Reads rows (pair, doc_id, text) sorted by pair and yields the pairs of doc_id whose texts are similar enough."""
    last: tuple[int, int, Counter] | None = None
    for batch in batches:
        a, b = [], []
        for pair, doc, text in zip(*(batch.column(c).to_pylist() for c in ("pair", "doc_id", "text"))):
            own = Counter(shingles_of(text or ""))
            if last is not None and last[0] == pair:
                if similarity(last[2], own) >= least:
                    a.append(last[1])
                    b.append(doc)
                last = None
            else:
                last = (pair, doc, own)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def true_links(docs: DataFrame, pairs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of doc_id whose texts are similar by their counted shingles. Texts go to the pairs that they are in; of rows with one doc_id one counts."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    ends = cut(once.withColumn("pair", F.monotonically_increasing_id()).select("pair", F.explode(F.array("a", "b")).alias("doc_id")))
    texts = docs.join(ends.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    small_batches(docs.sparkSession, 64)
    met = ends.join(texts, "doc_id").select("pair", "doc_id", "text").repartition("pair").sortWithinPartitions("pair", "doc_id")
    return met.mapInArrow(lambda batches: _verified(batches, least), "a long, b long")


def near_copies(docs: DataFrame, radius: int = 4, most_bits: int = MOST_BITS, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, component_id for every row: the smallest doc_id reachable over links between near copies. Rows with a null doc_id join the
    component of their text."""
    prints, sketch = tuple(f"f{k}" for k in range(PRINTS)), tuple(f"s{k}" for k in range(SKETCH // 64))
    own = [*prints, *sketch, "same"]
    known: dict[bytes, bytes] = {}

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join(describe(t or "", known) for t in batch.column("text").to_pylist())
        values = np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, len(own))
        return pa.record_batch([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], ["doc_id", *own])

    named = id_and_text(docs, id_col, text_col)
    rows = cut(map_batches(named, per_batch, "doc_id long, " + ", ".join(f"{c} long" for c in own)))
    nodes = cut(rows.groupBy(*own).agg(F.min("doc_id").alias("node")))
    proposed = near_edges(nodes.filter("node is not null"), radius, heavy, prints, sketch, most_bits)
    components = connected_components(true_links(named, proposed, least))
    of = nodes.join(components, "node", "left").select(*own, F.coalesce("component", "node").alias("component_id"))
    return rows.join(of, own, "left").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the smallest doc_id of each component, once each; rows without a doc_id can't be named and stay."""
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null"))


def deduplicate(docs: DataFrame, radius: int = 4, most_bits: int = MOST_BITS) -> DataFrame:
    """One row of each group of near copies, all columns."""
    return one_of_each(docs, near_copies(docs, radius, most_bits))
