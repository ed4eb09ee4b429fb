"""Sharding: vector bin packing.

Rows with equal texts form a group, a vector of (bytes, tokens, rows). Groups are placed in descending order of size, each
into the shard where the dot product of its vector with the shard's residual capacity is highest, so bytes, tokens and
rows are balanced jointly.

Scale. A group with at least 1/UNITS of a shard's capacity in some dimension is a unit of its own; there are at most
3 * shards * UNITS of those, whatever the size of the corpus. All smaller groups are hashed into shards * UNITS bundles
that are placed as one group each, with a bundle's vector (a documented switch: single small groups are not placed one by one). So the placement works on a bounded list of units; everything that grows with the rows
is a Spark aggregation with map-side combine or a broadcast join with that bounded list. A group over half a shard's
capacity (a hot group of copies) is split by doc_id into pieces of about a twentieth of a shard (PIECE), as no shard could hold it evenly.

Tokens are counted as single white-space characters and one, so two spaces in a row hold an empty token.

Cases: a null text has no bytes and no tokens and is a group of its own (size 8, checksum 0), unlike the empty text; an empty table gives an
empty result; repeated rows each take a slot; ties go to the lowest shard; slots follow doc_id within a part of a shard; a very long text
counts whole and lies in one shard; rows with a null doc_id are packed like any other; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burncal.llm.common import cut, id_and_text

OVERHEAD = 8
UNITS = 512
SPLIT_OVER = 0.5
PIECE = 0.05
WEIGHTS = (4.0, 1.0, 1.0)  # bytes have to come out near equal; tokens and rows as well as they can
SLOT_ROWS = 50_000


def place(units: np.ndarray, capacity: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit, by highest weighted dot product of its vector with the residual capacity, largest unit first."""
    load = units / capacity
    weights = np.array(WEIGHTS)
    residual = np.ones((shards, load.shape[1]))
    chosen = np.zeros(len(load), np.int64)
    for i in np.lexsort((np.arange(len(load)), -load.sum(1), -load.max(1))):
        best = int(np.argmax(residual @ (weights * load[i])))
        chosen[i] = best
        residual[best] -= load[i]
    return chosen


def pack_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and OVERHEAD), tokens (white-space separators and one), text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.translate(text, " \n\t\r", "")) + 1)
    rows = cut(
        id_and_text(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            tokens.cast("long").alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")))).alias("key"),
        )
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    capacity = np.maximum(np.array([total.bytes or 0, total.tokens or 0, total.rows or 0], float) / shards, 1e-9)
    share = F.greatest(*(F.col(c) / F.lit(float(max(x, 1e-9))) for c, x in zip(("bytes", "tokens", "rows"), capacity)))
    # at most 3 * shards * units rows, see above
    large = rows.groupBy("key").agg(*sums).select("key", share.alias("share")).filter(F.col("share") >= 1.0 / units).collect()
    bundles, first, own = shards * units, shards * units, []
    for r in sorted(large, key=lambda r: bytes(r.key)):
        pieces = 1 if r.share <= SPLIT_OVER else math.ceil(r.share / PIECE)
        own.append((r.key, first, pieces))
        first += pieces
    owners = F.broadcast(spark.createDataFrame(own, "key binary, first long, pieces long"))
    tagged = rows.join(owners, "key", "left").withColumn(
        "unit",
        F.when(F.col("first").isNull(), F.pmod(F.xxhash64("key"), F.lit(bundles))).otherwise(F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("pieces"))),
    )
    vectors = sorted(tuple(r) for r in tagged.groupBy("unit").agg(*sums).collect())
    chosen = place(np.array([v[1:] for v in vectors], float).reshape(-1, 3), capacity, shards)
    shard_of = F.broadcast(spark.createDataFrame([(v[0], int(s)) for v, s in zip(vectors, chosen)], "unit long, shard int"))
    parts = max(16, math.ceil((total.rows or 0) / (shards * SLOT_ROWS)))
    placed = tagged.join(shard_of, "unit").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    # slots: a running count over the parts of a shard, then row numbers inside each part, which has a bounded number of rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("slot")
    )
