"""Mixing sources to target weights: Sainte-Laguë apportionment.

Each source's words, its documents one after another, are cut into blocks of equally many words. The blocks of the whole mix are seats that go
to the sources by the highest quotients target / (2 * seats + 1). As more seats never take one away, the first m * k seats are the first m shards of
k seats, and the quota of a shard is the difference of two apportionments: an integer for each source and shard. A source's seats take its blocks in a
seeded order, from the start again once all are taken; its target is at most CAP times its size, so no block is taken more than CAP times.

The order of a source's b blocks is block j at place (a * j + c) mod b, with a (coprime to b) and c from a hash of seed and source: one block follows
from its number, so no task needs the list of the blocks, and reruns agree.

Scale. Words are counted where the texts lie; then a row has some 60 bytes. Where a document's words begin in its source comes from range partitions
and the sums of the ranges before (`order.running`), so a hot source is spread over all tasks. The driver has one row for each source (the table
of weights), and finds the quotas by bisection over the quotient, never by walking seats; a task has the quotas of all sources.

A block has 1/BLOCKS of the smallest target, so that all sources come within about a hundredth of theirs; one word at least.

Cases: null texts have no words; a null source is a source, the last; empty texts and sources without words take nothing; rows with one doc_id are
rows of their own, alike ones too; a null doc_id comes first in its source; ties of quotients go to the source that comes first; very long texts
span many blocks; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import cut, map_batches
from burncal.llm.order import running

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
CAP = 2
BLOCKS = 256
SHARDS = 24
SEED = 12
_STEPS = 200


@dataclass
class Source:
    """What a task has to know of a source: words, target, blocks, the order of its blocks, and how many seats it has after each shard."""

    size: int
    target: float
    blocks: int
    step: int
    start: int
    seats: list[int]


def targets_of(sizes: list[int], weights: list[int], share: Fraction = SHARE, cap: int = CAP) -> list[Fraction]:
    """Each source's target: `share` of all sizes by weight, stopped at `cap` times its size, the excess shared anew by the weights of the others."""
    found: list[Fraction] = [Fraction(0)] * len(sizes)
    rest, free = share * sum(sizes), list(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] > cap * sizes[i] * whole]
        if not over:
            for i in free:
                found[i] = rest * weights[i] / whole
            break
        for i in over:
            found[i] = Fraction(cap * sizes[i])
        rest -= sum(found[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return found


def apportion(targets: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Seats of each source by the highest quotients target / (2 * s + 1), s from 0, of equals the first source's; no source gets more than `most`.
    Bisection finds a quotient that leaves only few seats, and a heap gives these."""

    def over(quotient: Fraction) -> list[int]:
        return [min(m, math.floor((t / quotient + 1) / 2)) for t, m in zip(targets, most)]

    seats = min(seats, sum(m for t, m in zip(targets, most) if t > 0))
    if seats <= 0:
        return [0] * len(targets)
    low, high = Fraction(0), 2 * max(targets) + 1  # at `high` nobody has a seat, and at `low` all that there are
    for _ in range(_STEPS):
        middle = (low + high) / 2
        if sum(over(middle)) > seats:
            low = middle
        else:
            high = middle
        if seats - sum(over(high)) <= len(targets):
            break
    found = over(high)
    heap = [(-t / (2 * s + 1), i) for i, (t, s, m) in enumerate(zip(targets, found, most)) if t > 0 and s < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(found)):
        _, i = heapq.heappop(heap)
        found[i] += 1
        if found[i] < most[i]:
            heapq.heappush(heap, (-targets[i] / (2 * found[i] + 1), i))
    return found


def order_of(seed: int, source: str, blocks: int) -> tuple[int, int]:
    """step and start of the seeded order of a source's blocks."""
    digest = hashlib.md5(f"{seed}:{source}".encode()).hexdigest()
    step = 1 + int(digest[:8], 16) % max(1, blocks)
    while math.gcd(step, blocks) != 1:
        step += 1
    return step, int(digest[8:16], 16) % max(1, blocks)


def plan(sizes: dict[str, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, shards: int = SHARDS, seed: int = SEED) -> tuple[int, dict[str, Source]]:
    """Words of a block, and what each source gives to each shard. Sources (keys that sort as they should) take the weights in turn."""
    names = sorted(sizes)
    size = [sizes[n] for n in names]
    targets = targets_of(size, [weights[i % len(weights)] for i in range(len(names))], share, cap)
    block = max(1, math.floor(min((t for t in targets if t > 0), default=1)) // BLOCKS)
    blocks = [-(-s // block) for s in size]
    whole = math.floor(sum(targets) / block + Fraction(1, 2))
    seats = [apportion(targets, whole * (k + 1) // shards, [cap * b for b in blocks]) for k in range(shards)]
    return block, {n: Source(s, float(t), b, *order_of(seed, n, b), [x[i] for x in seats]) for i, (n, s, t, b) in enumerate(zip(names, size, targets, blocks))}


def taken(first: int, size: int, block: int, source: Source) -> np.ndarray:
    """Words that each shard takes of those from `first` on, repeats counted."""
    if not size:
        return np.zeros(len(source.seats), np.int64)
    number = np.arange(first // block, (first + size - 1) // block + 1)
    words = np.minimum((number + 1) * block, first + size) - np.maximum(number * block, first)
    place = ((number % source.blocks) * source.step + source.start) % source.blocks  # under blocks squared
    held, ends = np.zeros(len(source.seats), np.int64), np.array(source.seats)
    for turn in range(-(-source.seats[-1] // source.blocks)):
        seat = place + turn * source.blocks
        at = np.searchsorted(ends, seat, "right")  # the first shard that ends after the seat
        inside = at < len(ends)
        np.add.at(held, at[inside], words[inside])
    return held


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, group (the source, sorting as it should), size: words, which ASCII white space parts."""
    source = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("2"))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("group"), F.col(text_col).cast("string").alias("text"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(t.split()) if t else 0 for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.record_batch([batch.column("doc_id"), batch.column("group"), pa.array(sizes, pa.int64())], ["doc_id", "group", "size"])

    return map_batches(read, per_batch, "doc_id long, group string, size long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shards: an array of (shard, words) of the shards that take something of the document."""
    rows = cut(sizes_of(docs, id_col, text_col, source_col))
    sizes = {r.group: r.size for r in rows.groupBy("group").agg(F.sum("size").alias("size")).collect()}  # a row for each source
    block, sources = plan(sizes, weights, share, cap, shards, seed)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = [sources[g] for g in batch.column("group").to_pylist()]
        held = [taken(first, size, block, s) for first, size, s in zip(batch.column("before").to_pylist(), batch.column("size").to_pylist(), of)]
        parts = [[{"shard": int(k), "words": int(h[k])} for k in np.flatnonzero(h)] for h in held]
        kind = pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.int64())]))
        columns = [pa.array([s.size for s in of], pa.int64()), pa.array([s.target for s in of], pa.float64()), pa.array([int(h.sum()) for h in held], pa.int64()), pa.array(parts, kind)]
        names = [None if g == "2" else g[1:] for g in batch.column("group").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), batch.column("size"), *columns], ["doc_id", "source", "size", "source_size", "target", "taken", "shards"])

    placed = running(rows, "group", ["doc_id", "size"], "size")
    return map_batches(placed, per_batch, "doc_id long, source string, size long, source_size long, target double, taken long, shards array<struct<shard: int, words: long>>")
