"""Merkle manifest of a dataset: contiguous numpy digest matrices.

A row's leaf is the SHA-256 of its columns, each with its length before it, so no two rows can be taken for each other. The leaves of a language
stand in the order of doc_id; every FANOUT consecutive nodes become one, level by level, down to the language's subroot, and the subroots of all
languages, in the order of their bytes, give the root in the same way.

A tree is cut into aligned blocks of FANOUT ** DEPTH nodes. A block is a matrix of 64-byte hexadecimal digests: a level is reshaped to one row for each
run of FANOUT nodes and hashed row by row to the next level's matrix. The siblings of all leaves of a block are gathered from these matrices by
index arithmetic: at level k leaf p lies in run (p >> 3k) >> 3, whose other members are its siblings.

Scale. Leaves are hashed where the texts lie; after that a row has some 200 bytes. The position of a row in its language comes from range
partitions and the counts of the ranges before (`order.running`). Blocks are dealt by (language, block), each of bounded size, so a hot
language is spread over all tasks; a table that is 4096 times smaller goes on to the next round, until every language has one node. Paths come
down the same way, a block's path joined to the block. Nothing is gathered on the driver but the root and, each round, whether a language has more than one node.

Cases: nulls count as `-`; a null lang is a language of its own, the first; rows with a null doc_id come first in their language; rows with
one doc_id go by their leaves, and rows that are alike in all columns are leaves of their own; empty texts have length 0; very long texts are
hashed whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import cut, map_batches
from burncal.llm.order import running

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
DEPTH = 4
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "path array<struct<before: string, after: string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf_bytes(values: list[bytes | None]) -> bytes:
    """The digest of a row: `-` for a null, else length, colon and value."""
    return sha(b"".join(b"-" if v is None else b"%d:%s" % (len(v), v) for v in values))


def levels_of(n: int, depth: int) -> int:
    """Levels of a block in a tree of n nodes: all `depth` of them if the tree has further blocks, else as many as lead to one node."""
    levels = 0
    while levels < depth and n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def parents(nodes: np.ndarray) -> np.ndarray:
    """The next level: every run of FANOUT rows hashed as one; the last run may be shorter."""
    whole = len(nodes) // FANOUT
    runs = [*nodes[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
    if len(nodes) % FANOUT:
        runs.append(nodes[whole * FANOUT :].ravel())
    return np.frombuffer(b"".join([sha(r.data) for r in runs]), np.uint8).reshape(-1, HEX)


def matrices(digests: list[str], levels: int) -> list[np.ndarray]:
    """A matrix of digests for each level of a block, leaves first."""
    found = [np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)]
    for _ in range(levels):
        found.append(parents(found[-1]))
    return found


def siblings(nodes: np.ndarray, position: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """For each position of a level the other members of its run, left to right: one buffer with FANOUT - 1 places for each, how many bytes of
    its places are in use, and how many of those stand to the left."""
    own, others = position & (FANOUT - 1), np.arange(FANOUT - 1)
    at = (position >> FANOUT_BITS << FANOUT_BITS)[:, None] + others + (others >= own[:, None])
    used = np.minimum(len(nodes) - (position >> FANOUT_BITS << FANOUT_BITS), FANOUT) - 1
    return nodes[np.minimum(at, len(nodes) - 1)].tobytes(), used * HEX, own * HEX


def paths_of(levels: list[np.ndarray]) -> list[list[tuple[bytes, bytes]]]:
    """For each leaf of a block what stands to the left and to the right of its ancestors in their runs, level by level."""
    position, step = np.arange(len(levels[0])), (FANOUT - 1) * HEX
    found: list[list[tuple[bytes, bytes]]] = [[] for _ in position]
    for k, nodes in enumerate(levels[:-1]):
        held, used, left = siblings(nodes, position >> (FANOUT_BITS * k))
        for i, (u, own) in enumerate(zip(used.tolist(), left.tolist())):
            found[i].append((held[i * step : i * step + own], held[i * step + own : i * step + u]))
    return found


def _block(depth: int):
    return F.shiftright("pos", FANOUT_BITS * depth)


def _in_order(rows: pa.Table) -> tuple[pa.Table, int, int]:
    rows = rows.sort_by("pos")
    return rows, rows.column("pos")[0].as_py(), rows.column("n")[0].as_py()


def climb(nodes: DataFrame, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """nodes: group, pos, n (nodes of the group), digest. All rounds of them, the given ones first, and (group, digest) of the roots."""
    stages = [nodes]

    def one(rows: pa.Table) -> pa.Table:
        rows, first, n = _in_order(rows)
        root = matrices(rows.column("digest").to_pylist(), levels_of(n, depth))[-1]
        size = 1 << FANOUT_BITS * depth
        return pa.table({"group": [rows.column("group")[0].as_py()], "pos": [first // size], "n": [-(-n // size)], "digest": [root.tobytes().decode()]})

    while True:
        found = cut(stages[-1].groupBy("group", _block(depth).alias("block")).applyInArrow(one, "group string, pos long, n long, digest string"))
        if (found.agg(F.max("n")).first()[0] or 1) == 1:
            return stages, found.select("group", "digest")
        stages.append(found)


def _with_paths(rows: pa.Table, above: pa.Table, depth: int, named: bool = False) -> pa.Table:
    """(group, pos, subroot, path) of the nodes of one block: their siblings up to the block's root, then the block's own path. Nodes that are
    named are subroots; the name is the next group."""
    rows, _, n = _in_order(rows)
    rest, digest = above.column("path")[0].as_py(), rows.column("digest")
    own = [[{"before": a.decode(), "after": b.decode()} for a, b in p] + rest for p in paths_of(matrices(digest.to_pylist(), levels_of(n, depth)))]
    if named:
        return pa.table({"group": rows.column("name"), "pos": pa.array([0] * len(rows), pa.int64()), "subroot": digest, "path": pa.array(own, _PATH)})
    return pa.table({"group": rows.column("group"), "pos": rows.column("pos"), "subroot": [above.column("subroot")[0].as_py()] * len(rows), "path": pa.array(own, _PATH)})


def descend(stages: list[DataFrame], path: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(group, pos, subroot, path) of the blocks of the first stage, from those of the roots: the siblings on the way from a block's root to the last root."""
    for nodes in reversed(stages[1:]):
        both = nodes.groupBy("group", _block(depth)).cogroup(path.groupBy("group", "pos"))
        path = cut(both.applyInArrow(lambda rows, above: _with_paths(rows, above, depth), f"group string, pos long, subroot string, {PATH}"))
    return path


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, group (the language; sorts as the manifest wants it), leaf, and tampered: the leaf with A-Z of the text in lower case, for the
    rows whose crc32(doc_id) 3 divides."""
    columns = [F.col(c).cast("string") if c != "doc_id" else F.col(c).cast("long") for c in COLUMNS]
    read = docs.select(*(c.alias(n) for c, n in zip(columns, COLUMNS)), (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("chosen"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").cast(pa.string()).cast(pa.binary()).to_pylist()
        rest = [batch.column(c).cast(pa.binary()).to_pylist() for c in COLUMNS[1:]]
        leaf, tampered, group = [], [], []
        for i, (row, chosen) in enumerate(zip(zip(ids, *rest), batch.column("chosen").to_pylist())):
            leaf.append(leaf_bytes(row).decode())
            tampered.append(leaf_bytes([*row[:-1], row[-1] and row[-1].lower()]).decode() if chosen else None)  # bytes.lower: A-Z only
            group.append("0" if row[2] is None else "1" + row[2].decode())
        return pa.record_batch([batch.column("doc_id"), pa.array(group), pa.array(leaf), pa.array(tampered, pa.string())], ["doc_id", "group", "leaf", "tampered"])

    return map_batches(read, per_batch, "doc_id long, group string, leaf string, tampered string")


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, lang, pos (place in the language), leaf, subroot, root, proof_sha256 (digest of all siblings from leaf to root), folded_root (the root as
    the tampered leaf, or the own one, and the siblings give it), verified (that is the root)."""
    placed = running(cut(leaves(docs)), "group", ["doc_id", "leaf"])
    placed = cut(placed.select("doc_id", "group", F.col("before").alias("pos"), F.col("total").alias("n"), F.col("leaf").alias("digest"), "tampered"))
    stages, subroots = climb(placed, depth)
    languages = running(cut(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")), "group", ["name"])
    tops, roots = climb(cut(languages.select("group", "name", F.col("before").alias("pos"), F.col("total").alias("n"), "digest")), depth)
    root = (roots.first() or [None, ""])[1]
    start = roots.select("group", F.lit(0).cast("long").alias("pos"), F.lit("").alias("subroot"), F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("path"))
    of_languages = tops[0].groupBy("group", _block(depth)).cogroup(descend(tops, start, depth).groupBy("group", "pos"))
    named = cut(of_languages.applyInArrow(lambda rows, above: _with_paths(rows, above, depth, True), f"group string, pos long, subroot string, {PATH}"))

    def one(rows: pa.Table, over: pa.Table) -> pa.Table:
        rows, _, n = _in_order(rows)
        rest = [(s["before"].encode(), s["after"].encode()) for s in over.column("path")[0].as_py()]
        leaf, tail = rows.column("digest").to_pylist(), b"".join([a + b for a, b in rest])
        proof, folded = [], []
        for path, own, changed in zip(paths_of(matrices(leaf, levels_of(n, depth))), leaf, rows.column("tampered").to_pylist()):
            proof.append(sha(b"".join([a + b for a, b in path]) + tail).decode())
            digest = (changed or own).encode()
            for a, b in path + rest:
                digest = sha(a + digest + b)
            folded.append(digest.decode())
        lang = [None if g == "0" else g[1:] for g in rows.column("group").to_pylist()]
        found = {"doc_id": rows.column("doc_id"), "lang": pa.array(lang, pa.string()), "pos": rows.column("pos"), "leaf": leaf, "subroot": [over.column("subroot")[0].as_py()] * len(leaf)}
        return pa.table(found | {"root": [root] * len(leaf), "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

    schema = "doc_id long, lang string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return placed.groupBy("group", _block(depth)).cogroup(descend(stages, named, depth).groupBy("group", "pos")).applyInArrow(one, schema)
