"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Texts are lower-cased word sequences (letters and digits); shingles are five words. For every size (in shingles) that some
benchmark item has, windows of that size slide over a document word by word. A window's 128-bit SimHash (each shingle weighted by its
count) is looked up in a multi-index: fingerprints are cut into 8 blocks of 16 bits, the index holds, for each block, all values within
INDEX_ERRORS bits of an item's, and a look-up asks for all values within QUERY_ERRORS bits of the window's. Two fingerprints within
RADIUS = 31 bits differ by at most 3 = 1 + 2 in some block (8 * 4 = 32 > 31), so all items within the radius are found, and a
fingerprint that has nothing to do with an item meets it in some block with a chance of 0.08. Items come from the index alone. An item
that some window retrieves is verified by the weighted Jaccard similarity of shingle counts, at least 0.8, on every window of the run
of starts around that window.

Recall. At a similarity of exactly 0.8 two fingerprints differ in 19.4 bits on average, with a deviation of 4.1, so a window at the bound is
retrieved with a chance of 0.998, a copy always, and a run holds several windows.

Windows that can't reach the similarity are not hashed: with an item of their size they share at least 8/9 of its shingles, so
windows with fewer shingles that stand in any item of their size are left out, which loses nothing.

Scale. One pass over the documents for each block of items, no shuffle. The items are the only thing sent to all tasks; BLOCK_BYTES
bounds what is sent at once, and a larger benchmark is taken in blocks of items (a stated query set against all rows, in blocks), which
the driver builds one after the other.

Cases: null and empty texts on either side match nothing; items with fewer than five words have no shingle and match nothing, and
items with a null id can't be named and are left out; a document shorter than an item is one window; very long texts are cut into
windows like any other, in memory in proportion to the text; repeated rows give repeated matches; items with equal texts each match;
of several windows the most similar, then the first, is reported; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import id_and_text, map_batches, texts

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
BLOCKS, BLOCK_BITS = 8, 16
INDEX_ERRORS, QUERY_ERRORS = 1, 2
RADIUS = BLOCKS * (INDEX_ERRORS + QUERY_ERRORS + 1) - 1
BLOCK_BYTES = 4 << 20  # of item texts at once; a worker holds about 30 bytes for each of them
LOOK_UPS = 1024  # fingerprints that are looked up at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[str]) -> np.ndarray:
    """XXH3 of each shingle of five words, as two 64-bit numbers."""
    joined = [" ".join(words[i : i + SHINGLE]).encode() for i in range(len(words) - SHINGLE + 1)]
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, joined)), ">u8").reshape(-1, 2).astype(np.uint64)


def fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of `width` shingles, as BLOCKS numbers of 16 bits; a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int32)
    total = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(bits, 0)])
    return np.packbits((total[width:] - total[:-width]) * 2 > width, axis=1).view(">u2").astype(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of blocks."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of shingle counts."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (a.total() + b.total() - shared)


def needed(item: int, window: int) -> int:
    """The shingles that a window has to share with an item, both of so many shingles, to be similar."""
    return math.ceil(SIMILARITY * (item + window) / (1 + SIMILARITY) - 1e-9)


def near_values(errors: int) -> np.ndarray:
    """The differences of up to so many bits in a block."""
    return np.array([sum(1 << b for b in bits) for k in range(errors + 1) for bits in combinations(range(BLOCK_BITS), k)], np.uint16)


class MultiIndex:
    """The items whose fingerprints may lie within the radius of a given one; none within it is missing."""

    def __init__(self, prints: np.ndarray):
        self.starts, self.items = [], []
        near = near_values(INDEX_ERRORS)
        for b in range(BLOCKS):
            value = (prints[:, b, None] ^ near).ravel()
            order = np.argsort(value, kind="stable")
            self.starts.append(np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32))
            self.items.append(np.repeat(np.arange(len(prints), dtype=np.int32), len(near))[order])
        self.probes = near_values(QUERY_ERRORS)

    def look_up(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of prints, item), each pair once, sorted."""
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            value = (prints[:, b, None] ^ self.probes).astype(np.int64)
            first = self.starts[b][value].ravel()
            count = self.starts[b][value + 1].ravel() - first
            hit = np.flatnonzero(count)
            count, first = count[hit], first[hit]
            ends = np.cumsum(count)
            at = np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
            rows.append(np.repeat(hit // len(self.probes), count))
            items.append(self.items[b][at].astype(np.int64))
        n = max(1, int(max(x.max(initial=0) for x in items)) + 1)
        pair = np.unique(np.concatenate(rows) * n + np.concatenate(items))
        return pair // n, pair % n


class Benchmark:
    """The items of one block, with their multi-index."""

    def __init__(self, items: list[tuple[int, str | None]]):
        split = [(item_id, WORD.findall((text or "").lower())) for item_id, text in items]
        split = [(item_id, words) for item_id, words in split if len(words) >= SHINGLE]
        hashes = [shingle_hashes(words) for _, words in split]
        self.ids = [item_id for item_id, _ in split]
        self.widths = np.array([len(h) for h in hashes], np.int64)
        self.counts = [Counter(h[:, 0].tolist()) for h in hashes]
        self.prints = np.array([fingerprints(h, len(h))[0] for h in hashes], np.uint16).reshape(-1, BLOCKS)
        self.index = MultiIndex(self.prints)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, words in split for w in words}))}
        # shingle codes by size of item: what any window of that size may be made of
        pairs = {(c, width) for (_, words), width in zip(split, self.widths.tolist()) for c in self.codes(words)[0].tolist()}
        self.shingles = np.array(sorted(pairs), np.uint64).reshape(-1, 2)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A number for each shingle of known words, and the places of those shingles."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        n = len(ids) - SHINGLE + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = np.convolve(ids > 0, np.ones(SHINGLE, np.int64), "valid") == SHINGLE
        at = np.flatnonzero(known)
        code = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            code = (code ^ ids[at + k]) * _MIX
            code ^= code >> np.uint64(29)
        return code, at

    def starts(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(size of item, starts of the windows of that size with enough shingles of items of that size)."""
        code, at = self.codes(words)
        first, last = np.searchsorted(self.shingles[:, 0], code), np.searchsorted(self.shingles[:, 0], code, "right")
        hit = np.flatnonzero(last > first)
        if not len(hit):
            return
        count = (last - first)[hit]
        ends = np.cumsum(count)
        width = self.shingles[np.repeat(first[hit] - (ends - count), count) + np.arange(ends[-1]), 1].astype(np.int64)
        place, shingles = np.repeat(at[hit], count), len(words) - SHINGLE + 1
        for own in np.unique(width).tolist():
            size = min(own, shingles)
            own_places = place[width == own]
            if len(own_places) >= (least := needed(own, size)):
                # the windows of which a place is the last one: enough places lie within the size before it
                low = np.maximum(own_places[least - 1 :] - size + 1, 0)
                high = np.minimum(own_places[: len(own_places) - least + 1], shingles - size)
                runs = [np.arange(a, b + 1) for a, b in zip(low.tolist(), high.tolist()) if a <= b]
                if runs:
                    yield own, np.unique(np.concatenate(runs))

    def matches(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, Hamming distance, first word, number of words) of the best window for each item."""
        words = WORD.findall(text.lower())
        found: dict[int, tuple[float, int, int, int, int]] = {}
        for own, starts in self.starts(words):
            size = min(own, len(words) - SHINGLE + 1)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                hashes = shingle_hashes(words[run[0] : run[-1] + size + SHINGLE - 1])
                prints = fingerprints(hashes, size)
                retrieved: set[int] = set()
                for k in range(0, len(prints), LOOK_UPS):
                    row, item = self.index.look_up(prints[k : k + LOOK_UPS])
                    near = (self.widths[item] == own) & (distances(prints[k + row], self.prints[item]) <= RADIUS)
                    retrieved.update(item[near].tolist())
                for i in sorted(retrieved):
                    window = Counter(hashes[:size, 0].tolist())
                    for s in range(len(prints)):
                        if s:  # one shingle leaves the window, one comes in
                            window[gone] -= 1
                            window[int(hashes[s + size - 1, 0])] += 1
                        gone = int(hashes[s, 0])
                        alike = similarity(self.counts[i], window)
                        if alike >= SIMILARITY and (i not in found or alike > found[i][0]):
                            found[i] = alike, int(distances(prints[s], self.prints[i])), int(run[0]) + s, size + SHINGLE - 1
        return sorted((i, *best) for i, best in found.items())


def _item_blocks(benchmark: DataFrame, limit: int) -> Iterator[Benchmark]:
    """The items in blocks of about `limit` bytes at most, one after the other; each is sent to all tasks at once."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield Benchmark(sorted((r.doc_id, r.text or "") for r in benchmark.filter((part == b) & F.col("doc_id").isNotNull()).collect()))


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start, end (code points of the window) for every document that holds an item."""
    own, out = id_and_text(docs, id_col, text_col), None
    schema = "doc_id long, item_id long, similarity double, hamming int, start long, end long"
    for items in _item_blocks(id_and_text(benchmark, item_col, item_text_col), block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def per_batch(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                if found := shared.value.matches(text):
                    spans = [m.span() for m in _lowered_words(text)]
                    rows += [(doc_id, shared.value.ids[i], round(s, 6), d, spans[at][0], spans[at + n - 1][1]) for i, s, d, at, n in found]
            columns = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "similarity", "hamming", "start", "end"])

        part = map_batches(own, per_batch, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _lowered_words(text: str) -> list[re.Match]:
    """Words of a text as places in the text itself. Lower-casing can lengthen it; then places of the lower-cased text hold."""
    low = text.lower()
    return list(WORD.finditer(text if len(low) == len(text) else low))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. Row by row, so no text is shuffled."""
    kept = docs
    for items in _item_blocks(id_and_text(benchmark, "item_id"), BLOCK_BYTES):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def per_batch(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            return batch.filter(pa.array([not shared.value.matches(t) for t in texts(batch)], pa.bool_()))

        kept = map_batches(kept, per_batch, docs.schema)
    return kept
