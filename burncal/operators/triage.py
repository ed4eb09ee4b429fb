"""Ranking of events, verdicts and texts for responders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.functions.scalars import cosine, geo_score, rounded


def event_relevance(events: DataFrame, profile: DataFrame, k: int = 20) -> DataFrame:
    """The k events (event_id, embedding, distance) most relevant to one region's profile (one row: profile), by meaning and place."""
    semantic = F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("profile")))
    geo = geo_score("distance")
    scored = events.crossJoin(F.broadcast(profile)).select("event_id", rounded(geo, 3).alias("geo_score"), rounded(semantic, 3).alias("semantic_score"), rounded(F.lit(0.55) * semantic + F.lit(0.45) * geo, 4).alias("relevance"))
    return scored.orderBy(F.desc("relevance"), "event_id").limit(k)


def mean_profile(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row with the mean of all vectors: a sum per position, so nothing but one vector is gathered."""
    parts = vectors.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("profile"))


def sitrep(summary: DataFrame) -> DataFrame:
    """A situation line per day from sensor_day_summary rows."""
    days = summary.groupBy("day").agg(F.sum("n").alias("n"), F.sum("hi_conf").alias("hi"), F.max("max_frp").alias("top"), F.sum(F.when(F.col("sensor").startswith("MODIS"), F.col("n")).otherwise(0)).alias("modis"))
    text = F.format_string("%s: %d active-fire detections, %d confident, strongest %.1f MW; MODIS %d, VIIRS %d.", F.col("day").cast("string"), "n", "hi", "top", "modis", F.col("n") - F.col("modis"))
    return days.select("day", text.alias("text"))


#: Intent -> words of its pattern, the first that matches counts.
INTENTS = [
    ("season", "peak|season|when|critical"),
    ("anomaly", "anomal|unusual|strange|record"),
    ("sensors", "sensor|difference|modis|viirs|compare"),
    ("regime", "regime|type|classif"),
    ("outlook", "forecast|outlook|next"),
]


def intent(questions: DataFrame, column: str = "question") -> DataFrame:
    """The rows with the intent of a question; without one it asks for a snapshot."""
    found = F.lit("snapshot")
    for name, pattern in reversed(INTENTS):
        found = F.when(F.lower(column).rlike(pattern), name).otherwise(found)
    return questions.withColumn("intent", found)


def navigation(answers: DataFrame, column: str = "answer") -> DataFrame:
    """The rows with the region and date of an answer's NAVIGATE directive; null without one, or if it is no JSON object."""
    target = F.from_json(F.nullif(F.regexp_extract(column, r"NAVIGATE:\s*(\{[^}]+\})", 1), F.lit("")), "region string, date string")
    return answers.withColumn("region", target["region"]).withColumn("date", target["date"])
