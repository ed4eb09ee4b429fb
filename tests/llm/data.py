"""Small documents with every awkward case, and brute-force versions of what the operators give."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash

random.seed(4)
VOCABULARY = [f"{a}{b}{c}" for a in ("th", "er", "on", "é", "St") for b in ("an", "re", "ou", "ing") for c in ("", "s", "ly", "tion")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE, LONG, PASSAGE = prose(120, 1), prose(9000, 2), prose(30, 3)
ROWS: list[tuple[int | None, str | None]] = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, BASE), (6, BASE), (6, BASE), (7, BASE.replace(" ", " x ", 1)), (8, BASE.upper()),
    (9, LONG), (10, "ab " * 400), (11, "ab " * 90 + "c"), (12, prose(40, 5) + "\n" + PASSAGE + "\n" + prose(40, 6)), (13, PASSAGE + " " + prose(20, 7)),
    (14, "日本語 ▁ İstanbul é́ \U0001f525 end"), (15, "x" * 49), (16, "x" * 50), (17, "y" + "x" * 60), (18, prose(500, 8) + BASE[:300]), (None, BASE), (None, "alone"),
    (19, prose(70, 9)), (20, "Released under the MIT License. " + prose(30, 10)), (21, prose(30, 11) + " licensed under CC BY-NC 4.0 " + prose(5, 12)), (-3, prose(60, 13) + " " + PASSAGE),
]
SCHEMA = "doc_id long, text string, score double, label int, fp string, shard int, key string, codes string, part int, media string"


def frame(spark, rows=None):
    """With further columns whose names the operators use themselves."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, 0.5, 1, "f", 7, "k", "c", 3, "m") for i, t in rows], SCHEMA).repartition(3)


def removed(rows) -> dict[tuple, tuple]:
    """What each document keeps if every byte under a 50-byte string of a smaller document goes."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[(i, t)] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text: str | None, k: int = 4) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints: list[tuple[int, int]], radius: int = 4) -> dict[int, int]:
    """(doc, fingerprint) -> smallest doc reachable, by comparing all pairs."""
    parent = {d: d for d, _ in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(prints):
        for b, y in prints[i:]:
            if (x ^ y).bit_count() <= radius:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d, _ in prints}


def counted_shingles(text: str | None) -> Counter:
    words = (text or "").encode().lower().split()
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] * bool(words))


def jaccard(a: Counter, b: Counter) -> float:
    common = (a & b).total()
    return common / (a.total() + b.total() - common) if a or b else 1.0


def near_copies(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """doc -> smallest doc reachable over near copies, by comparing the shingles of all pairs."""
    own = [(doc, counted_shingles(text)) for doc, text in rows]
    parent = {d: d for d, _ in own}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(own):
        for b, y in own[i:]:
            if min(x.total(), y.total()) >= least * max(x.total(), y.total()) and jaccard(x, y) >= least:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d, _ in own}
