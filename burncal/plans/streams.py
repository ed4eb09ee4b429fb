"""Streams as queries: each runs over the files that are there, batch by batch, and stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.plans.clusters import tracked_sql, cluster_stats
from burncal.plans.detections import DET_CONF, r, total
from burncal.session import cut, shared_folder
from burncal.sources.fixtures import DETECTIONS, oracle
from burncal.streaming.detections import appended, daily_summary, read_detections
from burncal.streaming.tracks import follow_stream


def stream_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = read_detections(spark, f"{sf_dir}/events.parquet*", schema)
    rows = spark.sql(DETECTIONS.replace("select event_id as pt_seq", "select ts, event_id as pt_seq"), events=events).withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batches = daily_summary(rows, distinct=False).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state")
    batches.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/result")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/result")


MONTH_FILES = 7  # of five days each, the last of one


def _files(spark: SparkSession, rows: DataFrame, chunk: str, path: str) -> None:
    """The rows of each chunk that there is as a file of its own, one after another, so that the stream reads them in this order."""
    rows.write.partitionBy(chunk).parquet(f"{path}/dealt")
    dealt = spark.read.parquet(f"{path}/dealt")
    for k in sorted(r[0] for r in rows.select(chunk).na.drop().distinct().collect()):  # a fifth of the days
        dealt.filter(F.col(chunk) == k).drop(chunk).coalesce(1).write.parquet(f"{path}/in/{k:06d}")


def _stream(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the clusters of all days, of whatever months, which come five days at a time in their order. Rows of state hold the tracks between batches."""
    path = f"{shared_folder(spark)}/tracks-{uuid.uuid4().hex}"
    rows = cluster_stats(spark, sf_dir).select(F.lit("aoi").alias("region"), "day", "label", "n", "frp_sum", "c_lon", "c_lat", "class")
    _files(spark, cut(rows.withColumn("chunk", F.floor(F.unix_date("day") / 5))), "chunk", path)
    found = follow_stream(_stream(spark, rows, path), path)
    steps = F.transform(F.sequence(F.lit(1), F.size("trail"), F.lit(2)), lambda k: F.format_string("%.4f %.4f", F.get("trail", k - 1), F.get("trail", k)))
    return found.withColumn("trail", F.array_join(steps, ","))


def stream_late_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as they close, of detections of which a seventh comes five days late, an eleventh comes again with the next file, and a thirteenth comes
    too late to count. Months come one after another; what would come after a month's sixth file, but for the rows of its last day, never comes."""
    path = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(DETECTIONS.replace("select event_id as pt_seq", "select ts, event_id as pt_seq"), events=events).withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.floor((F.dayofmonth("day") - 1) / 5)
    after = F.when(F.col("pt_seq") % 13 == 0, F.array(own + 4)).when(F.col("pt_seq") % 7 == 0, F.array(own + 1)).when(F.col("pt_seq") % 11 == 0, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("own", own).withColumn("file", F.explode(after)).filter((F.col("file") < 6) | (F.col("file") == F.col("own")))
    month = F.year("day") * 12 + F.month("day")
    kept = dealt.select("ts", "sensor", "lat", "lon", "frp", "conf_raw", "night", (month * MONTH_FILES + F.col("file")).alias("chunk"))
    _files(spark, cut(kept), "chunk", path)
    return appended(daily_summary(_stream(spark, kept.drop("chunk"), path), late="7 days"), path)


QUERIES = {"stream_daily_summary": stream_daily_summary, "stream_tracks": stream_tracks, "stream_late_summary": stream_late_summary}

#: What comes before the last file ends (a chunk is five days), and the days that are over seven days before the latest detection. A row four files late is
#: behind the watermark; one whose file would come after the last never comes.
_CLOSED = "select *, pt_seq%13<>0 and (pt_seq%7<>0 or own+1<6) as counts from (select dc.*, (day(day)-1)//5 as own, ev.ts from dc join events ev on ev.event_id=dc.pt_seq) x"

ORACLES = {
    "stream_daily_summary": oracle(
        f"select day, sensor, count(*) as n, {r(total('frp') + '/count(*)', 1)} as mean_frp, {r('max(frp)', 1)} as max_frp, count(case when conf>=80 then 1 end) as hi_conf, count(case when night then 1 end) as night from dc group by day, sensor", "det", dc=DET_CONF
    ),
    "stream_tracks": tracked_sql("select region, track_id, first_day, last_day, days_seen, latest_class, peak_frp, latest_frp, frp_trend, latest_n, trail from tr"),
    "stream_late_summary": oracle(
        f"select day, sensor, count(*) as n, {r(total('frp') + '/count(*)', 1)} as mean_frp, {r('max(frp)', 1)} as max_frp, count(case when conf>=80 then 1 end) as hi_conf, count(case when night then 1 end) as night from cl where counts and day+interval 1 day <= (select max(ts) from cl where counts or (pt_seq%13=0 and own+4<6)) - interval 7 day group by day, sensor",
        "det", dc=DET_CONF, cl=_CLOSED,
    ),
}
