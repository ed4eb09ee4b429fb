"""Structured Streaming front end: a file stream of detections, and daily summaries with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.functions.scalars import confidence, exact_sum, rounded


def read_detections(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A file stream of detections in Parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily_summary(stream: DataFrame, late: str = "1 day", distinct: bool = True) -> DataFrame:
    """Per day and sensor: count, mean and largest power, confident and night detections. Rows (ts timestamp, sensor, lat, lon, frp, conf_raw, night)
    more than `late` behind are dropped; repeats within that time count once."""
    marked = stream.withWatermark("ts", late)
    once = marked.dropDuplicatesWithinWatermark(["sensor", "ts", "lat", "lon"]) if distinct else marked
    n = F.count("*")
    days = once.withColumn("conf", confidence("conf_raw")).groupBy(F.window("ts", "1 day").alias("w"), "sensor").agg(
        n.alias("n"), rounded(exact_sum("frp") / n, 1).alias("mean_frp"), rounded(F.max("frp"), 1).alias("max_frp"), F.count_if(F.col("conf") >= 80).alias("hi_conf"), F.count_if("night").alias("night")
    )
    return days.select(F.to_date("w.start").alias("day"), "sensor", "n", "mean_frp", "max_frp", "hi_conf", "night")


def appended(summary: DataFrame, path: str) -> DataFrame:
    """Run a summary over what is there, from its checkpoint under the path if there is one: days that no row in time can change any more are
    written once, to the folder of their batch, and all days written so far come back."""
    spark = summary.sparkSession
    writer = summary.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state")
    writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/days/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/days").drop("batch")
