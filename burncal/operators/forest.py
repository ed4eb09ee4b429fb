"""Scores of a forest from its nodes as flat arrays.

The nodes of all trees are one table, bounded by trees times 2 ** (depth + 1): it goes to every task once, as arrays, and a batch of rows walks
down all trees level by level, without a vector or a tree object for any row. The same table is there for other engines: a row goes left where its
feature is at most the threshold, and a leaf's weights, divided by their sum, are the tree's vote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.session import discard, shared_folder

MAX_NODES = 4_000_000  # some 300 MB of arrays with five classes


@dataclass
class Nodes:
    """Of every node: the feature (-1: leaf), the threshold, the places of its two children, and the classes' shares; roots first of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' votes for each row of x."""
        total = np.zeros((len(x), self.shares.shape[1]))
        for root in self.roots:
            at, open_ = np.full(len(x), root), np.arange(len(x))
            while True:
                feature = self.feature[at[open_]]
                open_ = open_[feature >= 0]
                if not len(open_):
                    break
                node = at[open_]
                goes = x[open_, self.feature[node]] <= self.threshold[node]
                at[open_] = np.where(goes, self.left[node], self.right[node])
            total += self.shares[at]
        return total / len(self.roots)


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a saved tree model (a stage that was written to a path), for use elsewhere: tree, node (in order from the root), feature (-1: leaf),
    threshold (go left up to it), left, right, and the weights of the classes."""
    node = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    leaf = F.col("leftChild") < 0
    return node.select(
        "tree", F.col("id").alias("node"), F.when(leaf, -1).otherwise(F.col("split.featureIndex")).alias("feature"), F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("impurityStats").alias("weights"),
    )


def nodes_of(spark: SparkSession, stage) -> DataFrame:
    """The node table of a fitted tree stage, by way of the shared folder."""
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    stage.write().save(path)
    return node_table(spark, path)


def flat(table: DataFrame) -> Nodes:
    """The table as arrays; its size is checked before it is gathered."""
    n = table.count()
    if n > MAX_NODES:
        raise ValueError(f"{n} nodes are more than {MAX_NODES}")
    rows = table.toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    tree, number = rows.column("tree").to_numpy(), rows.column("node").to_numpy()
    key = tree.astype(np.int64) << 32 | number
    place = lambda c: np.searchsorted(key, tree.astype(np.int64) << 32 | np.maximum(rows.column(c).to_numpy(), 0))
    weights = np.stack(rows.column("weights").to_pylist())
    sums = weights.sum(1, keepdims=True)
    return Nodes(np.flatnonzero(number == 0), rows.column("feature").to_numpy(), rows.column("threshold").fill_null(0.0).to_numpy(), place("left"), place("right"), weights / np.where(sums > 0, sums, 1))


def score(rows: DataFrame, nodes: Nodes, features: list[str], classes: list[str], keep: tuple[str, ...] = ("pt_seq", "day")) -> DataFrame:
    """The columns to keep, behavior (the class with the largest mean vote, of equals the first) and p, to three decimals. Nulls count as 0."""
    held = rows.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(classes)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(f).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for f in features], 1)
                p = held.value.probabilities(x)
                best = p.argmax(1)
                columns = [batch.column(c) for c in keep] + [pa.array(names[best].tolist(), pa.string()), pa.array(np.floor(p[np.arange(len(p)), best] * 1000 + 0.5) / 1000)]
                yield pa.record_batch(columns, [*keep, "behavior", "p"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, *features).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", behavior string, p double")
