"""Balanced logistic regression by iteratively reweighted least squares.

Features are standardized by their population deviations; a weight makes both labels count the same; the penalty is half the squared length of the
coefficients without the intercept. Each step is one pass: every task adds the outer products of its rows (a matrix as large as the features are
many), these are summed by place on Spark, and the driver solves for the step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burncal.functions.scalars import linear, sigmoid
from burncal.session import cut


@dataclass
class Fitted:
    features: list[str]
    mean: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float
    steps: int

    def probability(self) -> Column:
        return sigmoid(linear([F.col(f).cast("double") for f in self.features], self.mean, self.scale, self.coef, self.intercept))


def standards(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Means, deviations (1 where a feature is constant) and the weight of each label."""
    row = df.agg(*(f(c) for c in features for f in (F.avg, F.stddev_pop)), F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    mean, scale, (ones, zeros) = np.array(row[0:-2:2], float), np.array(row[1:-2:2], float), row[-2:]
    return mean, np.where(scale > 0, scale, 1.0), {1: (ones + zeros) / (2 * max(ones, 1)), 0: (ones + zeros) / (2 * max(zeros, 1))}


def step_sums(df: DataFrame, features: list[str], label: str, mean: np.ndarray, scale: np.ndarray, weights: dict[int, float], beta: np.ndarray) -> DataFrame:
    """(i, j, hessian) for i <= j, and gradient in the rows with i = j, of the loss at beta; place 0 is the intercept."""
    d = len(features) + 1
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hessian, gradient, some = np.zeros((d, d)), np.zeros(d), False
        for batch in batches:
            x = np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1).reshape(batch.num_rows, d - 1)
            y = batch.column(label).to_numpy(zero_copy_only=False).astype(float)
            x = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
            w = np.where(y == 1, weights[1], weights[0])
            p = 1 / (1 + np.exp(-(x @ beta)))
            hessian += x.T @ (x * (w * p * (1 - p))[:, None])
            gradient += x.T @ (w * (p - y))
            some |= bool(len(y))
        if some:
            diagonal = np.where(upper[0] == upper[1], gradient[upper[0]], 0.0)
            yield pa.record_batch([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(hessian[upper]), pa.array(diagonal)], ["i", "j", "hessian", "gradient"])

    partial = df.select(*features, label).mapInArrow(run, "i int, j int, hessian double, gradient double")
    return partial.groupBy("i", "j").agg(F.sum("hessian").alias("hessian"), F.sum("gradient").alias("gradient"))


def fit(df: DataFrame, features: list[str], label: str = "y", penalty: float = 1.0, steps: int = 50, tolerance: float = 1e-9) -> Fitted:
    """Rows with a null feature or label are left out."""
    df = cut(df.select(*features, label).na.drop())
    mean, scale, weights = standards(df, features, label)
    beta, ridge = np.zeros(len(features) + 1), np.diag([0.0] + [penalty] * len(features))
    for k in range(1, steps + 1):
        hessian, gradient = np.zeros((len(beta), len(beta))), np.zeros(len(beta))
        for r in step_sums(df, features, label, mean, scale, weights, beta).collect():  # as many rows as places in the upper half
            hessian[r.i, r.j] = hessian[r.j, r.i] = r.hessian
            gradient[r.i] += r.gradient if r.i == r.j else 0.0
        change = np.linalg.lstsq(hessian + ridge, gradient + ridge @ beta, rcond=None)[0]
        beta = beta - change
        if np.abs(change).max() < tolerance:
            break
    return Fitted(list(features), mean.tolist(), scale.tolist(), beta[1:].tolist(), float(beta[0]), k)
