"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.session import cut

LEAST_PART = 512  # rows of one node that are never dealt


def _minima(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, m (the least value), rows: pre-aggregated before they are shuffled."""
    return cut(rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("rows")))


def _with_minimum(rows: DataFrame, minima: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """The rows with m of their key. A key with more than `limit` rows (a hub) is dealt into parts of about so many by a hash of `by`, and
    its minimum is sent to each part. As rows are limit times the partitions at most, hubs are no more than partitions, and can be broadcast."""
    hubs = minima.filter(F.col("rows") > limit).select(key, F.ceil(F.col("rows") / limit).alias("parts")).collect()
    if not hubs:
        return rows.join(minima.drop("rows"), key)
    parts = F.broadcast(rows.sparkSession.createDataFrame(hubs, f"{key} long, parts long"))
    dealt = rows.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("parts")
    each = minima.join(parts, key, "left").select(key, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(each, [key, "part"]).drop("part")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node reachable.

    Each round links every node to the smallest neighbour it knows; rounds grow with the logarithm of the longest path.
    Minima are pre-aggregated before they are shuffled, and a hub's neighbours are dealt to many tasks. Rounds end when no edge changes.
    """
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).filter("hi <> lo").distinct()
    pairs, seen = cut(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = tuple(state)
        limit = max(LEAST_PART, 2 * state[0] // partitions)
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        near = _with_minimum(both.filter("v > u"), _minima(both, "u", "v"), "u", "v", limit)
        large = cut(near.select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct())
        small = _with_minimum(large, _minima(large, "hi", "lo"), "hi", "lo", limit)
        pairs = cut(small.select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())
