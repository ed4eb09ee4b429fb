"""Quality classifier: random Fourier features over document statistics.

Each document becomes a vector of statistics (lengths, character classes, repetition). Standardized with mean and deviation
over all documents, it is mapped to cosines of random projections, whose inner products approximate a Gaussian kernel.
Ridge regression is fitted by its normal equations: every partition sums its own outer products, Spark adds the sums, and
only the matrix, whose size is fixed by the number of features, reaches the driver. Scores are calibrated by isotonic
regression on labelled rows that the fit did not see (crc32 of the id modulo 5 is 4), binned before they are collected.

Cases: null and empty texts have zero statistics and are scored like any other; labels that are null or not 0/1 are not
learnt from; without labels of both kinds every score is 0.5; repeated rows each get a row; a label counts once per row of
its id, and repeated label rows count each; very long texts are read whole; equal texts get equal scores; further columns are ignored; an
empty table gives an empty result. Sums of doubles come in the order of tasks, so scores, of six decimals, can differ in the last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import cut, held_out, id_and_text, map_batches, texts

FEATURES = 256
STATS = 15
BINS = 1000
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 sentence marks, 6 symbols, 7 not ASCII
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 7 if _c > 127 else 1 if _ch.isupper() else 2 if _ch.islower() else 3 if _ch.isdigit() else 4 if _ch.isspace() else 5 if _ch in ".,;:!?'\"()-" else 6 if _ch.isprintable() else 0


def statistics(text: str) -> list[float]:
    """STATS numbers that describe the text, none of which depends on what it is about."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    n, nw = len(raw), len(words)
    if not nw:
        return [0.0] * STATS
    counts = np.bincount(raw, minlength=256)
    of_class = np.bincount(_CLASS, weights=counts, minlength=8)
    share = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.float64, nw)
    return [
        np.log1p(n), np.log1p(nw), of_class[1] / max(1, of_class[1] + of_class[2]), of_class[3] / n, of_class[4] / n, of_class[5] / n,
        of_class[6] / n, of_class[7] / n, counts[10] / n, counts[33] / nw, min(lengths.mean(), 40.0), min(lengths.std(), 40.0),
        len(set(words)) / nw, len(set(zip(words, words[1:]))) / max(1, nw - 1), float(-(share * np.log(share)).sum()),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[float(x) for x in statistics(t)] for t in texts(batch)]
        return pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return map_batches(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, stats array<double>")


class FourierMap:
    """Standardizes statistics and maps them to cosines whose inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = 7):
        rng = np.random.RandomState(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)


def normal_equations(rows: DataFrame, fourier: FourierMap) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y of (stats, label): each task sums its own rows, Spark sums the tasks' cells."""
    size = len(fourier.b) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = fourier(_matrix(batch.column("stats")))
                y = batch.column("label").to_numpy(zero_copy_only=False)
                total += x.T @ np.hstack([x, y[:, None]])
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    cells = rows.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(size * (size + 1))
    for cell, value in cells.collect():  # (FEATURES + 1) * (FEATURES + 2) cells, whatever the input
        total[cell] = value
    total = total.reshape(size, size + 1)
    return total[:, :-1], total[:, -1]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centres and values of the blocks, both ascending."""
    blocks: list[list[float]] = []
    for xi, yi, wi in sorted(zip(x, y, weight)):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    fourier: FourierMap
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]  # raw score to share of label 1

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.interp(self.raw(stats), *self.curve), 0, 1), 6)


def _scored(frame: DataFrame, keep: str, kind: str, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The column to keep and the score of stats."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(keep), pa.array(score(_matrix(batch.column("stats"))))], [keep, "score"])

    return map_batches(frame.select(keep, "stats"), per_batch, f"{keep} {kind}, score double")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", ridge: float = 1e-3) -> Model:
    """The model from the statistics of all documents and the labels that are not held out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())
    learnt = stats.join(known, "doc_id").select("stats", "label", (F.crc32(F.col("doc_id").cast("string")) % 5 == 4).alias("calibrates"))
    moments = stats.select(*(c for i in range(STATS) for c in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i])))).first()
    moments = np.array([m or 0.0 for m in moments]).reshape(STATS, 2)
    fourier = FourierMap(moments[:, 0], moments[:, 1])
    xx, xy = normal_equations(learnt.filter("not calibrates"), fourier)
    n = xx[-1, -1]
    weights = np.linalg.solve(xx + ridge * max(n, 1.0) * np.eye(len(xx)), xy)
    model = Model(fourier, weights, (np.array([0.0]), np.array([0.5])))
    raw = _scored(learnt.filter("calibrates"), "label", "int", model.raw)
    bin_of = F.floor(F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(2.0)) * BINS)
    bins = raw.groupBy(bin_of.alias("bin")).agg(F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()  # 3 * BINS rows at most
    if 0 < xy[-1] < n and bins:
        model.curve = isotonic(np.array([(b.bin + 0.5) / BINS for b in bins]), np.array([b.y for b in bins], float), np.array([b.w for b in bins], float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score for every row of docs; labels of held-out rows are never read."""
    stats = cut(document_statistics(docs, id_col, text_col))
    model = fit(stats, labels, label_col, id_col)
    return _scored(stats, "doc_id", "long", model.score).select("doc_id", held_out().alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, with a score of at least the threshold. Texts are scored where they lie."""
    model = fit(cut(document_statistics(docs)), labels)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([statistics(t) for t in texts(batch)], float).reshape(-1, STATS)
        return batch.filter(pa.array(model.score(stats) >= threshold))

    return map_batches(docs, per_batch, docs.schema)
