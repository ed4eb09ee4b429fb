"""Suffix-array dedup: repeated strings of LENGTH bytes, found by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. The question for every
suffix is thus its bucket at depth LENGTH. Refining all suffixes of a corpus would shuffle many times its size, so:

1. Initial buckets. Of the Q-grams in each window of LENGTH bytes the one with the smallest hash (leftmost among equals) is
   the window's anchor; equal windows have equal anchors at equal places, so all suffixes that can be equal to depth LENGTH
   meet in the bucket of one Q-gram. Each anchor is one small record (bucket identifier, checksum of all bytes its windows
   cover, checks of the bytes left and right of it, document); about one byte in sixteen is an anchor.
2. Where the same bytes stand around an anchor in a smaller document, all its windows are repeats. An anchor whose bucket holds
   other contexts that agree with it on one side is ambiguous.
3. Refinement. The contexts of ambiguous anchors meet bucket by bucket. Their suffixes are sorted into buckets of 8 bytes, and
   these are refined by sorting on pairs (own bucket, bucket at a later offset): 8 -> 16 -> 32 -> LENGTH, each pass reusing the
   identifiers that the one before has made, and only for suffixes that still share a bucket. These buckets are exact. Suffixes whose LENGTH bytes no other document
   has by a checksum, and from which no others are refined, are not sorted at all.
4. Every document marks what its repeated windows cover.

What hashes decide. Where all bytes around an anchor (its context) stand in a smaller document, which holds for most repeats, the context's
64-bit hash stands for them, with the Q-gram's 32 bits, and up to 14 bits of its two sides; in the marks of one document 61 bits. No bytes are compared
there, so a wrong removal has a chance of some 1e-19 for each pair of contexts of one Q-gram. All ambiguous contexts are compared byte by byte.

Scale. Records are packed by task and bucket; records with the same bytes around them are reduced to the smallest document
before they are shuffled, so copies do not gather. A Q-gram with many different contexts (a line that very many documents share, with
their own text on both sides) is hot: a task sends one record for it, and its contexts are compared window by window, dealt by
the bytes of each window, equal ones reduced to the smallest document of the part. Buckets, and the parts into which documents are dealt, are as many as the
bytes demand. Texts are shuffled once, to meet the marks of their part, packed by bucket; nothing is collected.

Cases: null texts are empty; texts under LENGTH bytes keep all; copies of a document with a smaller id lose all; repeats
inside one document, and rows with the same doc_id, do not count; rows with a null doc_id neither lose nor claim anything;
repeated rows are kept; very long texts are read in pieces that overlap by a window; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import cut, id_and_text, small_batches

LENGTH = 50
Q = 20
SIDE = (LENGTH - Q) // 2
WINDOW = LENGTH - Q + 1  # Q-grams in a window
CHUNK = 4 << 20
PIECE = 1 << 18
HOT = 64  # contexts of one Q-gram in a chunk, from which on the Q-gram is hot
HOT_RECORDS = 4096  # records of one Q-gram in its bucket, likewise
WHOLE, AMBIGUOUS, SPREAD = 0, 1, 3  # the two low bits of a mark
BUCKET_BYTES = 10 << 20  # of text for each bucket of anchors
PART_BYTES = 6 << 20  # of text for each part of the documents
_RECORD = np.dtype([("key", "<u4"), ("context", "<u8"), ("left", "u1"), ("right", "u1"), ("hot", "u1")])
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each byte, powers of the base, and powers of its inverse modulo 2**64."""
    size = PIECE + (1 << 18)
    byte = np.random.RandomState(3).randint(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def powers(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return byte, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Anchors:
    """The anchors of some texts: document (index), place, first and last window start, in bytes of the document."""

    def __init__(self, raw: list[bytes]):
        self.parts: list[tuple[np.ndarray, ...]] = []
        group: list[int] = []
        size = 0
        for i, text in enumerate(raw):
            if len(text) < LENGTH:
                continue
            if size and size + len(text) > PIECE:
                self._add(raw, group)
                group, size = [], 0
            group.append(i)
            size += len(text)
        if group:
            self._add(raw, group)
        names = ("doc", "at", "first", "last", "key", "context", "left", "right")
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint8, np.uint8)
        for k, (name, kind) in enumerate(zip(names, kinds)):
            setattr(self, name, np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, kind))
        del self.parts

    def _add(self, raw: list[bytes], group: list[int]) -> None:
        if len(group) == 1 and len(raw[group[0]]) > PIECE:  # a very long text goes in pieces that overlap by a window
            text, i, step = raw[group[0]], group[0], PIECE - LENGTH + 1
            for begin in range(0, len(text) - LENGTH + 1, step):
                self._hash([text[begin : begin + PIECE]], [i], begin)
        else:
            self._hash([raw[i] for i in group], group, 0)

    def _hash(self, texts: list[bytes], docs: list[int], shift: int) -> None:
        byte, up, down = _powers()
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[data] * up[:n], out=sums[1:])
        grams = _mix((sums[Q:] - sums[:-Q]) * down[: n - Q + 1])
        low = (grams >> np.uint64(32)).astype(np.uint32)
        place = np.zeros(len(low), np.uint8)
        span = 1
        while span < WINDOW:  # minima over 1, 2, 4, ... grams and then the window; the left one among equals
            step = min(span, WINDOW - span)
            right = low[step:] < low[: len(low) - step]
            new = np.where(right, low[step:], low[: len(low) - step])
            place = np.where(right, place[step:] + np.uint8(step), place[: len(place) - step])
            low, span = new, span + step
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        inside = np.zeros(len(place) + 1, np.int32)
        inside[begins] += 1
        np.subtract.at(inside, np.minimum(ends - LENGTH + 1, len(place)), 1)
        windows = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        at = windows + place[windows]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(at)) - 1
        at, first, last = at[begin], windows[begin], windows[stop]

        def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

        context = run(first, last + LENGTH)
        # a shared window shares SIDE bytes on the left or on the right of the gram; 0: no window reaches so far
        left = (run(np.maximum(at - SIDE, 0), at + Q) >> np.uint64(40)).astype(np.uint8) | np.uint8(1)
        right = (run(at, np.minimum(at + Q + SIDE, n)) >> np.uint64(40)).astype(np.uint8) | np.uint8(1)
        left[at - first < SIDE] = 0
        right[last < at - SIDE] = 0
        owner = np.searchsorted(ends, at, "right")
        here = begins[owner] - shift
        self.parts.append((np.array(docs)[owner], at - here, first - here, last - here, grams[at], context, left, right))

    def codes(self) -> np.ndarray:
        """61 bits that stand for bucket and context in the marks of a document."""
        return code(_short(self.key), self.context)


def _short(key: np.ndarray) -> np.ndarray:
    """The 32 bits of a Q-gram's hash that records carry: Q-grams that share them and a bucket only meet in the exact comparison."""
    return (key >> np.uint64(16)) & np.uint64(0xFFFFFFFF)


def code(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    return (_mix(_mix(key * np.uint64(_BASE)) ^ context) >> np.uint64(3)).astype(np.int64)


def _differs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in any column; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _packs(bucket: np.ndarray, docs: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The records of each bucket, sorted by document: number of documents, their ids and counts, then the records. A bucket costs some slices, as buckets are many."""
    heads = np.flatnonzero(_differs(bucket, docs)) if len(docs) else np.zeros(0, np.int64)
    ids, counts = docs[heads].astype("<i8"), np.diff(np.append(heads, len(docs))).astype("<u4")
    firsts = np.flatnonzero(_differs(bucket[heads])) if len(heads) else heads
    ends = np.append(firsts[1:], len(heads))
    for b, i, j, s, e in zip(bucket[heads[firsts]].tolist(), firsts.tolist(), ends.tolist(), heads[firsts].tolist(), np.append(heads, len(docs))[ends].tolist()):
        yield b, np.int64(j - i).tobytes() + ids[i:j].tobytes() + counts[i:j].tobytes() + records[s:e].tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    ids, counts = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<u4", n, 8 + 8 * n)
    return np.repeat(ids, counts), np.frombuffer(blob, _RECORD, -1, 8 + 12 * n)


def part_of(doc_id: Column, parts: int) -> Column:
    """The part of a document; `_parts` gives the same."""
    return F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 13)).bitwiseXOR(F.shiftright(doc_id, 29)), F.lit(parts))


def _parts(docs: np.ndarray, parts: int) -> np.ndarray:
    return (docs ^ (docs >> 13) ^ (docs >> 29)) % parts


def _by_part(rows: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed rows) of rows whose first column is a document."""
    part = _parts(rows[:, 0], parts)
    order = np.argsort(part, kind="stable")
    stops = np.flatnonzero(np.append(part[order][1:] != part[order][:-1], True)) + 1 if len(order) else []
    for s, e in zip([0, *stops], stops):
        yield int(part[order[s]]), rows[order[s:e]].astype("<i8").tobytes()


def _packed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The packed rows of a column, sorted by document."""
    rows = np.frombuffer(b"".join(x for x in column.to_pylist() if x), "<i8").reshape(-1, width)
    return rows[np.lexsort(rows.T[::-1])]


def _to_buckets(raw: list[bytes], ids: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, packed records, packed marks): records of distinct contexts with their smallest document, marks of the others."""
    a = Anchors(raw)
    doc = ids[a.doc]
    order = np.lexsort((doc, a.right, a.left, a.context, a.key))
    key, context, left, right, doc = a.key[order], a.context[order], a.left[order], a.right[order], doc[order]
    if not len(key):
        return
    heads = np.flatnonzero(_differs(key, context, left, right))
    smallest = np.repeat(doc[heads], np.diff(np.append(heads, len(key))))
    resolved = np.flatnonzero(doc > smallest)
    k, own_context, docs = key[heads], context[heads], doc[heads]
    hot, first = _crowded(k, docs, np.zeros(len(k), bool), HOT)
    keep = np.flatnonzero(~hot | first)
    records = np.zeros(len(keep), _RECORD)
    records["key"], records["context"] = _short(k[keep]), own_context[keep]
    records["left"], records["right"], records["hot"] = left[heads][keep], right[heads][keep], hot[keep]
    bucket = (k[keep] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((docs[keep], bucket))
    yield from ((b, blob, b"") for b, blob in _packs(bucket[order], docs[keep][order], records[order]))
    known = np.concatenate([np.stack([doc[resolved], (code(_short(key[resolved]), context[resolved]) << 2) | WHOLE], 1), np.stack([docs[hot], (code(_short(k[hot]), own_context[hot]) << 2) | SPREAD], 1)])
    if len(known):
        yield int(known[0, 0] % buckets), b"", known.astype("<i8").tobytes()


def _crowded(key: np.ndarray, doc: np.ndarray, said: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are of a hot key (`most` rows or more of several documents, or said to be hot), and which are their key's first by document."""
    order = np.lexsort((doc, key))
    new = np.append(True, key[order][1:] != key[order][:-1]) if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(key)))
    several = doc[order][starts] != doc[order][starts + sizes - 1] if len(starts) else new
    crowded = (several & (sizes >= most)) | (np.logical_or.reduceat(said[order], starts) if len(starts) else several)
    hot, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
    hot[order], first[order[starts]] = np.repeat(crowded, sizes), True
    return hot, first


def _compare(table: pa.Table, parts: int) -> pa.Table:
    """All records of a bucket: marks (code << 2, and what the anchor is) for the documents."""
    docs, codes = [], []
    records, owners = [np.zeros(0, _RECORD)], [np.zeros(0, np.int64)]
    for blob, marks in zip(table.column("records").to_pylist(), table.column("marks").to_pylist()):
        if blob:
            own, rec = _unpack(blob)
            owners.append(own)
            records.append(rec)
        if marks:
            pair = np.frombuffer(marks, "<i8").reshape(-1, 2)
            docs.append(pair[:, 0])
            codes.append(pair[:, 1])
    r, doc = np.concatenate(records), np.concatenate(owners)
    order = np.lexsort((doc, r["right"], r["left"], r["context"], r["key"]))
    r, doc = r[order], doc[order]
    key = r["key"].astype(np.uint64)
    if len(r):
        heads = np.flatnonzero(_differs(key, r["context"], r["left"], r["right"]))
        smallest = np.repeat(doc[heads], np.diff(np.append(heads, len(key))))
        copies = np.flatnonzero(doc > smallest)
        docs.append(doc[copies])
        codes.append((code(key[copies], r["context"][copies]) << 2) | WHOLE)
        said = np.logical_or.reduceat(r["hot"] > 0, heads)  # a hot task's only record can be a copy of a smaller document's
        r, doc, key = r[heads], doc[heads], key[heads]
        unsure = np.zeros(len(r), bool)
        for side in ("left", "right"):
            there = np.flatnonzero(r[side] > 0)
            there = there[np.lexsort((doc[there], r[side][there], key[there]))]
            if len(there):
                start = np.append(True, (key[there][1:] != key[there][:-1]) | (r[side][there][1:] != r[side][there][:-1]))
                starts = np.flatnonzero(start)
                sizes = np.diff(np.append(starts, len(there)))
                several = doc[there][starts] != doc[there][starts + sizes - 1]
                unsure[there[np.repeat(several, sizes)]] = True
        hot, _ = _crowded(key, doc, said, HOT_RECORDS)
        for chosen, mark in ((unsure & ~hot, AMBIGUOUS), (hot, SPREAD)):
            docs.append(doc[chosen])
            codes.append((code(key[chosen], r["context"][chosen]) << 2) | mark)
    rows = list(_by_part(np.stack([np.concatenate(docs), np.concatenate(codes)], 1), parts)) if docs else []
    return pa.table({"part": pa.array([x for x, _ in rows], pa.int64()), "marks": pa.array([x for _, x in rows], pa.binary())})


def _marked(a: Anchors, ids: list[int | None], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which anchors are repeats as a whole, which are ambiguous, and which of these are of hot Q-grams. marks: (doc, mark), sorted."""
    own = a.codes()
    found = [np.zeros(len(own), bool) for _ in range(3)]
    stops = np.searchsorted(a.doc, np.arange(len(ids) + 1))
    named = np.array([i for i, x in enumerate(ids) if x is not None], np.int64)
    values = np.array([x for x in ids if x is not None], np.int64)
    begin, end = np.searchsorted(marks[:, 0], values), np.searchsorted(marks[:, 0], values, "right")
    for i, s, e in zip(named.tolist(), begin.tolist(), end.tolist()):
        if s < e and stops[i] < stops[i + 1]:
            codes, part = marks[s:e, 1], slice(stops[i], stops[i + 1])
            for mark, into in zip((WHOLE, AMBIGUOUS, SPREAD), found):
                into[part] = np.isin(own[part], codes[codes & 3 == mark] >> 2)
    whole, unsure, hot = found
    # a context that is a repeat as a whole stands in a smaller document too, and that one answers for it
    return whole, (unsure | hot) & ~whole, hot & ~whole


def _steps(depth: int) -> list[tuple[int, int]]:
    """Of each pass of a refinement the depth before and the offset of the second bucket of a pair."""
    steps, reach = [], min(8, depth)
    while reach < depth:
        steps.append((reach, min(reach, depth - reach)))
        reach += steps[-1][1]
    return steps


def refine(data: np.ndarray, room: np.ndarray, depth: int = LENGTH, asked: np.ndarray | None = None) -> np.ndarray:
    """Bucket identifiers of suffixes at a depth: equal if and only if the next `depth` bytes are; -1 for a suffix without
    that many bytes, or whose bucket no other suffix shares. room: the bytes that each suffix has. With `asked`, the suffixes whose buckets are wanted, only these and
    those that the pairs of their passes reach are sorted, and only equal ones that are asked for meet."""
    n, reach = len(data), min(8, depth)
    value = _words(data, reach)
    live = room >= reach
    if asked is not None:
        reached = np.zeros(n, bool)
        reached[asked] = True
        for _, offset in reversed(_steps(depth)):
            reached[np.flatnonzero(reached) + offset] = True
        live = live & reached
    bucket, live, alone = np.full(n, -1, np.int64), np.flatnonzero(live), np.zeros(n, bool)
    steps = dict(_steps(depth))
    while len(live):
        values = value[live]
        order = np.argsort(values, kind="stable")
        starts = np.append(True, values[order][1:] != values[order][:-1])
        number = np.cumsum(starts) - 1
        counts = np.bincount(number)[number]
        # a bucket is named after its first suffix, so a suffix that is alone keeps a name that no other bucket gets
        bucket[live[order]] = np.minimum.reduceat(live[order], np.flatnonzero(starts))[number]
        alone[live[order][counts == 1]] = True
        shared = np.sort(live[order][counts > 1])
        if reach == depth:
            out = np.full(n, -1, np.int64)
            out[shared] = bucket[shared]
            return out
        offset = steps[reach]  # pairs of buckets, the second at this later offset
        exact = alone.copy()  # suffixes whose bucket is that of this depth
        exact[live] = True
        live = shared[room[shared] >= reach + offset]
        live = live[exact[live + offset]]
        value[live] = bucket[live].astype(np.uint64) * np.uint64(n) + bucket[live + offset].astype(np.uint64)
        reach += offset
    return np.full(n, -1, np.int64)


def _words(data: np.ndarray, size: int = 8) -> np.ndarray:
    """The next bytes of each suffix, up to eight, as a number."""
    padded, value = np.append(data, np.zeros(8, np.uint8)), np.zeros(len(data), np.uint64)
    for k in range(size):  # the initial buckets
        value = (value << np.uint64(8)) | padded[k : k + len(data)]
    return value


def _met(data: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Those of the windows at `starts` that may also be in another document: equal windows have equal sums of their words, and sums of one document alone go."""
    words, sums = _words(data), np.zeros(len(starts), np.uint64)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        sums = _mix(sums * np.uint64(_BASE) + words[starts + k])
    order = np.argsort(sums, kind="stable")
    if not len(order):
        return starts
    heads = np.flatnonzero(_differs(sums[order]))
    several = np.minimum.reduceat(doc[order], heads) != np.maximum.reduceat(doc[order], heads)
    return np.sort(starts[order[np.repeat(several, np.diff(np.append(heads, len(order))))]])


_PLACE = np.dtype([("doc", "<i8"), ("first", "<i8"), ("windows", "<i4")])


def _resolve(table: pa.Table, parts: int) -> pa.Table:
    """All contexts of a bucket: the windows that repeat in a smaller document, as packed (doc, first, last) runs."""
    places = np.concatenate([np.frombuffer(b, _PLACE) for b in table.column("places").to_pylist()] or [np.zeros(0, _PLACE)])
    data = np.frombuffer(b"".join(table.column("contexts").to_pylist()), np.uint8)
    sizes = places["windows"].astype(np.int64) + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(places)), sizes)
    offset = np.arange(len(data)) - starts[of]
    room = sizes[of] - offset
    windows = np.flatnonzero(room >= LENGTH)
    bucket = refine(data, room, asked=_met(data, windows, places["doc"][of[windows]]))
    shared = np.flatnonzero(bucket >= 0)
    doc = places["doc"][of[shared]]
    smallest = np.full(int(bucket.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, bucket[shared], doc)
    repeats = shared[doc > smallest[bucket[shared]]]
    doc, at = places["doc"][of[repeats]], places["first"][of[repeats]] + offset[repeats]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)) if len(doc) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = at[np.append(begin[1:], len(at)) - 1] if len(at) else at
    known = np.frombuffer(b"".join(x for x in table.column("runs").to_pylist() if x), "<i8").reshape(-1, 3)
    rows = list(_by_part(np.concatenate([np.stack([doc[begin], at[begin], last], 1), known]), parts))
    return pa.table({"part": pa.array([x for x, _ in rows], pa.int64()), "runs": pa.array([x for _, x in rows], pa.binary())})


def _records(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, records, marks: the anchors of all texts, CHUNK bytes of text at a time."""
    small_batches(docs.sparkSession)

    def rows(raw: list[bytes], ids: list[int]) -> pa.RecordBatch:
        out = list(zip(*_to_buckets(raw, np.array(ids, np.int64), buckets))) or [[]] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "records", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, ids, size = [], [], 0
        for batch in batches:
            raw += _bytes(batch.column("text"))
            ids += batch.column("doc_id").to_pylist()
            size += batch.column("text").nbytes
            if size >= CHUNK:
                yield rows(raw, ids)
                raw, ids, size = [], [], 0
        if raw:
            yield rows(raw, ids)

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, records binary, marks binary")


def _contexts(texts: pa.Table, marks: pa.Table, buckets: int) -> pa.Table:
    """A part's texts and marks: bucket, places and bytes of its ambiguous anchors."""
    rows = _packed(marks.column("marks"), 2)
    asked = np.unique(rows[rows[:, 1] & 1 == 1, 0])
    some = texts.filter(pc.is_in(texts.column("doc_id"), pa.array(asked, pa.int64())))
    raw, ids = _bytes(some.column("text")), some.column("doc_id").to_pylist()
    a = Anchors(raw)
    _, unsure, hot = _marked(a, ids, rows)
    doc_of, out = np.array(ids, np.int64), []
    keep = np.flatnonzero(unsure & ~hot)
    of = (a.key[keep] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    of, keep = of[order], keep[order]
    places = np.zeros(len(keep), _PLACE)
    places["doc"], places["first"], places["windows"] = doc_of[a.doc[keep]], a.first[keep], a.last[keep] - a.first[keep] + 1
    contexts = [raw[d][f : e + LENGTH] for d, f, e in zip(a.doc[keep].tolist(), a.first[keep].tolist(), a.last[keep].tolist())]
    begin = np.flatnonzero(_differs(of)).tolist() if len(of) else []
    for s, e in zip(begin, [*begin[1:], len(of)]):
        out.append((int(of[s]), places[s:e].tobytes(), b"".join(contexts[s:e]), b""))
    out += _spread(raw, doc_of, a, np.flatnonzero(hot), buckets)
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "places", "contexts", "runs"])


def _spread(raw: list[bytes], doc_of: np.ndarray, a: Anchors, hot: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Anchors of hot Q-grams window by window, dealt by the window's own bytes. Of the part's equal windows only those of the smallest document
    go on; the others are repeats already."""
    least: dict[bytes, int] = {}
    sent: dict[int, tuple[list, list]] = {}
    runs = []
    for x in hot[np.argsort(doc_of[a.doc[hot]], kind="stable")].tolist():
        text, doc = raw[a.doc[x]], int(doc_of[a.doc[x]])
        for p in range(int(a.first[x]), int(a.last[x]) + 1):
            window = text[p : p + LENGTH]
            if least.setdefault(window, doc) == doc:
                places, contexts = sent.setdefault(zlib.crc32(window) % buckets, ([], []))
                places.append((doc, p, 1))
                contexts.append(window)
            else:
                runs.append((doc, p, p))
    out = [(b, np.array(places, _PLACE).tobytes(), b"".join(contexts), b"") for b, (places, contexts) in sent.items()]
    return out + ([(runs[0][0] % buckets, b"", b"", np.array(runs, "<i8").tobytes())] if runs else [])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(texts: pa.Table, found: pa.Table, keep_text: bool) -> pa.Table:
    """A part's texts, marks and runs of repeated windows: what each document loses."""
    marks, runs = _packed(found.column("marks"), 2), _packed(found.column("runs"), 3)
    raw, ids = _bytes(texts.column("text")), texts.column("doc_id").to_pylist()
    touched = set(np.unique(marks[:, 0]).tolist())
    a = Anchors([t if d in touched else b"" for t, d in zip(raw, ids)])
    whole = np.flatnonzero(_marked(a, ids, marks)[0])
    stops, rows = np.searchsorted(a.doc[whole], np.arange(len(raw) + 1)), []
    for i, (text, doc_id) in enumerate(zip(raw, ids)):
        own, (s, e) = whole[stops[i] : stops[i + 1]], (0, 0) if doc_id is None else (np.searchsorted(runs[:, 0], doc_id, side) for side in ("left", "right"))
        first, last = np.append(a.first[own], runs[s:e, 1]).astype(np.int64), np.append(a.last[own], runs[s:e, 2]).astype(np.int64)
        kept, spans = text, 0
        if len(first):
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    columns = (list(zip(*rows)) or [[]] * 5)[: 4 + keep_text]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table([texts.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with keep_text also kept, the bytes that stay."""
    own = id_and_text(docs, id_col, text_col)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    parts = max(buckets, -(-size // PART_BYTES)) | 1
    records = _records(own.filter("doc_id is not null"), buckets)
    marks = cut(records.groupBy("bucket").applyInArrow(lambda t: _compare(t, parts), "part long, marks binary"))
    # rows without an id are dealt by their text
    dealt = own.withColumn("part", F.coalesce(part_of(F.col("doc_id"), parts), F.pmod(F.xxhash64("text"), F.lit(parts)))).groupBy("part")
    ambiguous = dealt.cogroup(marks.groupBy("part")).applyInArrow(lambda t, m: _contexts(t, m, buckets), "bucket int, places binary, contexts binary, runs binary")
    runs = ambiguous.groupBy("bucket").applyInArrow(lambda t: _resolve(t, parts), "part long, runs binary")
    none = F.lit(None).cast("binary")
    found = marks.select("part", "marks", none.alias("runs")).unionByName(runs.select("part", none.alias("marks"), "runs"))
    return dealt.cogroup(found.groupBy("part")).applyInArrow(lambda t, f: _finish(t, f, keep_text), RESULT + ", kept binary" * keep_text)
