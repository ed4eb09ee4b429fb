"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.session import cut, written  # noqa: F401

#: Rows of one Arrow batch; texts can be long, and a worker holds a batch as Arrow and as Python objects.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that go to a Python worker at once, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for functions that need one batch at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := per_batch(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what a text operator reads, under fixed names, so that no further column of the input can clash."""
    kinds = dict(docs.dtypes)
    if (id_col, text_col, kinds[id_col], kinds[text_col]) == ("doc_id", "text", "bigint", "string"):
        return docs.select(id_col, text_col)  # without aliases, so that two uses of one scan have one plan and share an exchange
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str = "doc_id"):
    """True for the rows of which no label is learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def smallest_hashes(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About n rows, those with the smallest hashes of the keys; all rows if there are no more. Only a count is gathered, and the rows are
    filtered where they lie, so tasks do not each send their own n to one place."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.xxhash64(*keys) < F.lit(-(1 << 63) + int((1 << 64) * (n / total))))  # hashes are uniform on 64 bits


def sampled_copies(df: DataFrame, n: int) -> DataFrame:
    """The distinct rows of a sample of about n rows, with `copies`: how often each is in the sample; all rows if there are no more. A row
    with c copies of total has c * n / total of them there, rounded up or down by its hash, so what is frequent stays, in proportion, and
    what is gathered is bounded however often rows repeat."""
    return shared_copies(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")), min(1.0, n / max(1, df.count())))


def shared_copies(counted: DataFrame, share: float) -> DataFrame:
    """The share of the copies of distinct rows with `copies`, for `sampled_copies`."""
    chance = F.xxhash64(*(c for c in counted.columns if c != "copies")) / F.lit(float(1 << 64)) + 0.5 if share < 1 else F.lit(0.0)
    return counted.withColumn("copies", F.floor(F.col("copies") * share + chance)).filter("copies > 0")
