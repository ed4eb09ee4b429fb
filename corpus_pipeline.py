"""From raw documents to token ids: quality, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the last return the columns of
documents.

Cases: null and empty texts are scored, linked and kept like any other (null texts stay null) and have no pieces; rows with a null doc_id can't
be named by the near-dedup, which keeps them all; of rows with one doc_id it keeps one; ties go to the smallest doc_id; very long texts go
through whole; further columns are carried along up to the last stage, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.llm import decontaminate, pieces, quality, secrets, simhash
from burncal.llm.common import documents, table
from burncal.session import discard, table_of


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similar to 0.8 or more in shingles of five words, found by SimHash), the one with the smallest doc_id stays."""
    return simhash.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts, the rules' and those that the networks add, are replaced by a mark."""
    return secrets.redact_secrets(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and score of the most likely segmentation, and the second best as it differs from it."""
    return pieces.encode_documents(docs, n=2).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "score", "alternatives")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", to_pieces),
]

#: No stage before the last can be put in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each result written as Parquet and read by the next stage."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = table_of(docs, f"stage{k}")
            if before:
                discard(spark, before)  # the table that this one was made from
            before = path
    return docs
