"""SentencePiece encoding and decoding, with N-best segmentation over the piece lattice.

The vocabulary is a public SentencePiece model file; nothing is trained. A text gets the usual marker for spaces (one in
front, one for each space), so it falls into chunks that begin with the marker; no piece of positive use crosses a
chunk, so the lattice of a text is the chain of its chunks' lattices (the file's pieces of several markers are left out).

The model of the file is a BPE, whose scores are ranks of merges and no likelihoods. Nothing is trained for it either: pieces are
ranked by frequency, so the law of Zipf and Mandelbrot gives each a probability, 1 / ((rank + SHIFT) * norm), and the score of an
edge is its logarithm, in whole units of 1 / UNIT nats so that sums are exact. A character that is no piece is an edge of its
UTF-8 byte pieces, 10 nats under the least piece. The best segmentation has the highest sum of scores, thus the highest likelihood,
ties going to the longest last piece, then the longest before it, and so on.

Forward Viterbi runs on all new chunks of a batch at once (numpy, one column of characters after the other; substrings are
looked up by rolling hash and compared with the vocabulary's). Its scores are the exact heuristic of the backward A-star search:
a hypothesis that ends at some position is worth its own score plus the forward score there, so hypotheses come off the
queue in order of their final score. For the second best the frontier of the search is evaluated in numpy along the best
path; for more, the search runs on the few chunks of a document whose alternatives cost least, and their sums are merged.

Cases: null and empty texts have no pieces; a literal marker in a text is written as bytes, so decoding always gives the
text back; very long chunks are segmented one by one in bounded memory; repeated rows are kept; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import id_and_text, map_batches, small_batches, texts

#: Where the public model file lies; a parameter of everything below.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHIFT = 300  # of the ranks: with 0 the few first ranks outweigh all others and words fall into letters
UNIT = 10_000  # parts of a nat
NEVER = -(1 << 60)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA9B0C7EBA1DA115))
TABLE_BITS = 20
LENGTHS = (5, 7, 9, 11, 13, 16, 20, 26, 34)  # chunks are padded to one of these; longer ones are segmented one by one
CACHE = 300_000
BLOCK = 8192
TEXT = 1_000_000  # bytes that a task segments at once; words and pieces take some ten times as much in a worker, which keeps it


@dataclass
class Vocabulary:
    """Pieces by id as bytes, and the scores of those that the lattice uses."""

    raw: list[bytes]
    scores: dict[str, tuple[int, int]]  # piece -> id, score
    byte_ids: list[int]
    longest: int = 0
    unknown: int = 0

    @classmethod
    def read(cls, path: str = MODEL_PATH) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, ranks, byte_ids = [], {}, [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                raw.append(bytes([int(piece[1:-1], 16)]))
            else:
                normal = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
                raw.append(piece.replace(MARK, " ").encode() if normal else b"")
                if normal and MARK not in piece[1:] and model.get_score(i) > -1e8:
                    ranks[piece] = -model.get_score(i), i
        if MARK not in ranks:  # the lone marker has no rank of its own in some models
            ranks[MARK] = max(ranks.values())[0], model.piece_to_id(MARK)
        norm = math.fsum(1 / (rank + SHIFT) for rank, _ in ranks.values())
        scores = {piece: (i, -round(UNIT * math.log((rank + SHIFT) * norm))) for piece, (rank, i) in ranks.items()}
        return cls(raw, scores, byte_ids, max(map(len, scores)), min(s for _, s in scores.values()) - 10 * UNIT)

    def edges_into(self, chunk: str, end: int):
        """(start, score, ids) of the edges that end at a position of a chunk, longest first. A marker after the first character is a literal one: no piece."""
        for start in range(max(0, end - self.longest), end):
            piece = chunk[start:end]
            if (found := self.scores.get(piece)) and (start == 0 or piece[0] != MARK):
                yield start, found[1], (found[0],)
            elif end - start == 1:
                yield start, self.unknown, tuple(self.byte_ids[b] for b in piece.encode())


def forward(vocabulary: Vocabulary, chunk: str) -> list[int]:
    """The best score of each beginning of the chunk."""
    best = [0] + [NEVER] * len(chunk)
    for end in range(1, len(chunk) + 1):
        best[end] = max(best[start] + score for start, score, _ in vocabulary.edges_into(chunk, end))
    return best


def best_path(vocabulary: Vocabulary, chunk: str, best: list[int]) -> tuple[int, ...]:
    ids: list[tuple[int, ...]] = []
    end = len(chunk)
    while end:
        start, _, own = next(e for e in vocabulary.edges_into(chunk, end) if best[e[0]] + e[1] == best[end])
        ids.append(own)
        end = start
    return tuple(i for own in reversed(ids) for i in own)


def n_best(vocabulary: Vocabulary, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best segmentations (score, ids), best first: backward A-star with forward Viterbi scores as heuristic.

    Hypotheses of the queue have no segmentation in common, and each has one that is worth what it says, so only the best n that are
    still to be found can matter. Among equals the newest comes first: it goes straight on to the start, longest pieces first."""
    best = forward(vocabulary, chunk)
    found, order = [], 0
    queue: list[tuple[int, int, int, int, tuple]] = [(best[-1], 0, len(chunk), 0, ())]  # ascending
    while queue and len(found) < n:
        _, _, end, score, path = queue.pop()
        if not end:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((score, tuple(ids)))
            continue
        for start, own, ids in reversed(list(vocabulary.edges_into(chunk, end))):
            order += 1
            queue.append((best[start] + own + score, order, start, score + own, (ids, path)))
        queue.sort()
        del queue[: max(0, len(queue) - n + len(found))]
    return found


class Columns:
    """Arrays that grow together; one row for each known chunk."""

    def __init__(self):
        self.n, self.used = 0, 0
        self.start, self.size, self.score, self.gap = (np.zeros(1024, np.int64) for _ in range(4))
        self.flat = np.zeros(4096, np.int32)

    def append(self, ids: list[np.ndarray] | np.ndarray, sizes: np.ndarray, score: np.ndarray, gap: np.ndarray) -> None:
        m, total = len(sizes), int(sizes.sum())
        while self.n + m > len(self.start):
            self.start, self.size, self.score, self.gap = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.score, self.gap))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        rows = slice(self.n, self.n + m)
        self.start[rows] = self.used + np.cumsum(sizes) - sizes
        self.size[rows], self.score[rows], self.gap[rows] = sizes, score, gap
        self.flat[self.used : self.used + total] = ids
        self.n, self.used = self.n + m, self.used + total


@dataclass
class Codec:
    """Encodes and decodes batches of texts; keeps the chunks it has seen, up to CACHE."""

    vocabulary: Vocabulary
    known: dict[str, int] = field(default_factory=dict)
    columns: Columns = field(default_factory=Columns)
    options: dict[tuple[str, int], list[tuple[int, tuple[int, ...]]]] = field(default_factory=dict)

    def __post_init__(self):
        pieces = list(self.vocabulary.scores)
        self.ids = np.array([self.vocabulary.scores[p][0] for p in pieces] + [-1], np.int32)
        self.scores = np.array([self.vocabulary.scores[p][1] for p in pieces] + [NEVER], np.int64)
        self.power = np.ones(self.vocabulary.longest + 1, np.uint64)
        self.power[1:] = BASE
        self.power = np.multiply.accumulate(self.power)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.hashes = np.append(hashes, np.uint64(0))
        self.tables, left = [], np.arange(len(pieces))
        for spread in SPREAD:  # what finds its place taken in the first table goes to the second
            table = np.full(1 << TABLE_BITS, len(pieces), np.int32)
            slots = (hashes[left] * spread) >> np.uint64(64 - TABLE_BITS)
            order = np.unique(slots, return_index=True)[1]
            table[slots[order]] = left[order]
            left = np.delete(left, order)
            self.tables.append((spread, table))
        if len(left):
            raise ValueError("the piece tables are too small")
        self.raw = np.array(self.vocabulary.raw, object)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return np.uint64(h)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Positions in hashes; the last one where no piece has the hash."""
        found = np.full(len(h), len(self.ids) - 1, np.int32)
        for spread, table in self.tables:
            at = table[(h * spread) >> np.uint64(64 - TABLE_BITS)]
            found = np.where(self.hashes[at] == h, at, found)
        return found

    def _segment(self, chunks: list[str], length: int) -> None:
        """Adds chunks of at most one length: forward Viterbi, best path, and the gap to the second best."""
        n, none = len(chunks), len(self.ids) - 1
        sizes = np.fromiter(map(len, chunks), np.int64, n)
        codes = np.frombuffer("".join([c.ljust(length, "\0") for c in chunks]).encode("utf-32-le"), np.uint32).reshape(n, length).T.astype(np.uint64)
        codes[1:][codes[1:] == MARK_POINT] = 0x110000  # a literal marker is no piece
        longest, rows = min(self.vocabulary.longest, length), np.arange(n)
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * BASE + codes[j] + np.uint64(1)
        best = np.full((length + 1, n), NEVER, np.int64)
        best[0] = 0
        edge = np.full((longest + 1, length + 1, n), none, np.int32)
        taken = np.zeros((length + 1, n), np.int8)
        for j in range(1, length + 1):
            for size in range(min(j, longest), 0, -1):
                at = edge[size, j] = self._look_up(prefix[j] - prefix[j - size] * self.power[size])
                score = self.scores[at]
                if size == 1:
                    score[at == none] = self.vocabulary.unknown
                score += best[j - size]
                better = score > best[j]
                np.copyto(best[j], score, where=better)
                taken[j][better] = size
        # along the best path from the end: its pieces, and the frontier of the search
        place, own, second, steps = sizes.copy(), np.zeros(n, np.int64), np.full(n, NEVER, np.int64), []
        live = np.arange(n)  # the chunks whose path has not reached the start
        while len(live):
            at_place = place[live]
            chosen = taken[at_place, live].astype(np.int64)
            flat = at_place * n + live
            for size in range(1, min(longest, int(at_place.max())) + 1):
                at = edge[size].ravel()[flat]
                score = self.scores[at]
                if size == 1:
                    score[at == none] = self.vocabulary.unknown
                score += best[np.maximum(at_place - size, 0), live] + own[live]
                score[(size == chosen) | (size > at_place)] = NEVER
                np.maximum(second[live], score, out=score)
                second[live] = score
            at = edge[chosen, at_place, live]
            piece = np.where(at == none, -2 - codes[at_place - 1, live].astype(np.int64), self.ids[at])
            step = np.full(n, -1, np.int64)
            step[live] = piece
            steps.append(step)
            own[live] += np.where(at == none, self.vocabulary.unknown, self.scores[at])
            place[live] -= chosen
            live = live[place[live] > 0]
        grid = np.stack(steps[::-1], 1)
        counts = (grid != -1).sum(1)
        ids = grid[grid != -1]
        if (ids < -1).any():  # characters that are no piece
            rows_of = np.repeat(rows, counts)
            out, counts = [], np.zeros(n, np.int64)
            for row, i in zip(rows_of.tolist(), ids.tolist()):
                own_ids = [i] if i >= 0 else [self.vocabulary.byte_ids[b] for b in chr(MARK_POINT if -2 - i == 0x110000 else -2 - i).encode()]
                out += own_ids
                counts[row] += len(own_ids)
            ids = np.array(out, np.int32)
        total = best[sizes, rows]
        self.columns.append(ids, counts, total, np.where(second < NEVER // 2, -1, total - second))

    def _segment_long(self, chunk: str) -> None:
        best = forward(self.vocabulary, chunk)
        ids = best_path(self.vocabulary, chunk, best)
        # the frontier along the best path, as for short chunks
        end, own, second = len(chunk), 0, NEVER
        while end:
            edges = list(self.vocabulary.edges_into(chunk, end))
            on = next(e for e in edges if best[e[0]] + e[1] == best[end])
            second = max([second, *(best[s] + x + own for s, x, _ in edges if s != on[0])])
            own, end = own + on[1], on[0]
        gap = best[-1] - second if second > NEVER // 2 else -1
        self.columns.append(np.array(ids, np.int32), np.array([len(ids)]), np.array([best[-1]]), np.array([gap]))

    def learn(self, words: set[str]) -> None:
        """Segments the chunks of words that are not known yet."""
        if len(self.known) + len(words) > CACHE:
            self.known, self.columns = {}, Columns()
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in self.known:
                by_length.setdefault(next((x for x in LENGTHS if len(w) < x), 0), []).append(w)
        for length, own in by_length.items():
            for i in range(0, len(own), BLOCK):
                block = own[i : i + BLOCK]
                first = self.columns.n
                if length:
                    self._segment([MARK + w for w in block], length)
                else:
                    for w in block:
                        self._segment_long(MARK + w)
                self.known.update(zip(block, range(first, first + len(block))))

    def encode(self, batch: list[str], n: int = 1) -> list[tuple[np.ndarray, int, list]]:
        """For each text: the ids of the best segmentation, its score, and the n best as (score, {chunk: ids that replace it})."""
        out = []
        split = [t.split(" ") if t else [] for t in batch]
        at = 0
        while at < len(batch):  # as many texts at once as the cache can hold
            stop, words = at, set()
            while stop < len(batch) and (stop == at or len(words) + len(split[stop]) <= CACHE):
                words.update(split[stop])
                stop += 1
            self.learn(words)
            get, c = self.known.__getitem__, self.columns
            for own in split[at:stop]:
                index = np.fromiter(map(get, own), np.int64, len(own))
                sizes = c.size[index]
                first = np.cumsum(sizes) - sizes
                ids = c.flat[np.repeat(c.start[index] - first, sizes) + np.arange(int(sizes.sum()))] if len(own) else np.zeros(0, np.int32)
                score = int(c.score[index].sum())
                out.append((ids, score, self._alternatives(own, index, score, n)))
            at = stop
        return out

    def _alternatives(self, words: list[str], index: np.ndarray, score: int, n: int) -> list[tuple[int, dict[int, tuple[int, ...]]]]:
        """Only the n-1 chunks with the smallest gaps can differ from the best in the n best segmentations."""
        best: list[tuple[int, dict[int, tuple[int, ...]]]] = [(0, {})]
        if n > 1 and len(index):
            gap = self.columns.gap[index]
            could = np.flatnonzero(gap >= 0)
            near = could[np.argsort(gap[could], kind="stable")[: n - 1]] if len(could) <= 64 else could[_smallest(gap[could], n - 1)]
            for place in near.tolist():
                options = self._options(words[place], n)
                merged = [(a + d, {**x, place: ids} if k else x) for a, x in best for k, (d, ids) in enumerate(options)]
                best = heapq.nsmallest(n, merged, key=lambda m: m[0])
        return [(score - cost, changed) for cost, changed in best]

    def _options(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations of a chunk with what each costs against the best; kept for chunks that can come again."""
        if (known := self.options.get((word, n))) is None:
            found = n_best(self.vocabulary, MARK + word, n)
            known = [(found[0][0] - s, ids) for s, ids in found]
            if len(word) < max(LENGTHS, default=0):
                if len(self.options) >= CACHE:
                    self.options.clear()
                self.options[word, n] = known
        return known

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.raw[ids].tolist())[1:].decode() if len(ids) else ""


MARK_POINT = ord(MARK)


def _smallest(values: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest values, first ones first among equals."""
    bound = np.partition(values, k - 1)[k - 1]
    near = np.flatnonzero(values <= bound)
    return near[np.argsort(values[near], kind="stable")[:k]]


def _gathered(df: DataFrame, per_batch, schema: str, column: str) -> DataFrame:
    """mapInArrow over turns of about TEXT bytes, so that new chunks are segmented many at a time and a worker stays small."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: map(per_batch, turns(batches, column, TEXT)), schema)


def turns(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, put together or cut so that each batch has about `most` bytes of a column (8 more for each row); a longer text is not cut."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths.astype(np.int64) + 8), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + most - size, "right"))
            if stop > start or not held:  # else the next text goes to the next turn
                stop = max(stop, start + 1)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
            if start < batch.num_rows or size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _codec(docs: DataFrame, path: str):
    """A broadcast of the vocabulary (its size is the model file's) and a function that gives the task's codec."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    own: list[Codec] = []

    def codec() -> Codec:
        if not own:
            own.append(Codec(shared.value))
        return own[0]

    return codec


def encode_documents(docs: DataFrame, n: int = 1, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, score, alternatives: the n best as score and the chunks that differ from the best with their ids."""
    codec = _codec(docs, path)
    alternative = pa.list_(pa.struct([("score", pa.int64()), ("chunks", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int32())))]))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = codec().encode(texts(batch), n)
        others = [[{"score": s, "chunks": sorted(c), "ids": [list(c[k]) for k in sorted(c)]} for s, c in found] for _, _, found in coded]
        return pa.record_batch(
            [batch.column("doc_id"), pa.array([ids for ids, _, _ in coded], pa.list_(pa.int32())), pa.array([s for _, s, _ in coded], pa.int64()), pa.array(others, alternative)],
            ["doc_id", "ids", "score", "alternatives"],
        )

    schema = "doc_id long, ids array<int>, score long, alternatives array<struct<score:long,chunks:array<int>,ids:array<array<int>>>>"
    return _gathered(id_and_text(docs, id_col, text_col), per_batch, schema, "text")


def decode_documents(encoded: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts that the ids were made from; a null list of ids gives an empty text."""
    codec = _codec(encoded, path)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        back = [codec().decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(back, pa.string())], ["doc_id", "text"])

    own = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_batches(own, per_batch, "doc_id long, text string")


def digest_documents(docs: DataFrame, n: int = 3, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: length, number and checksum of the ids, the n best scores, and whether decoding gives the text back."""
    codec = _codec(docs, path)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, c = texts(batch), codec()
        rows = []
        for text, (ids, score, others) in zip(own, c.encode(own, n)):
            back = c.decode(ids)
            rows.append((len(text), len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), score, ",".join(str(s) for s, _ in others), hashlib.sha256(back.encode()).hexdigest(), back == text))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        names = ["n_chars", "n_pieces", "ids_sha256", "score", "best_scores", "decoded_sha256", "round_trip"]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(col, t) for col, t in zip(zip(*rows), types))], ["doc_id", *names])

    schema = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, score long, best_scores string, decoded_sha256 string, round_trip boolean"
    return _gathered(id_and_text(docs, id_col, text_col), per_batch, schema, "text")
