"""Queries that write the tables as the feeds' files and read these back by format, with filters that go to the files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.session import cut, shared_folder
from burncal.sources import feeds
from burncal.sources.fixtures import calendar, detections, oracle, weather


def _files(spark: SparkSession, documents: DataFrame, kind: str) -> DataFrame:
    """One file for each document (a text column), read by the feed's format."""
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    documents.write.option("maxRecordsPerFile", 1).text(path)
    feeds.register(spark)
    return spark.read.format(f"burncal_{kind}").load(path)


def feed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong detections of the first days."""
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    rows = detections(spark, sf_dir).select(
        F.col("lat").alias("Latitude"), F.col("lon").alias("LONGITUDE"), "frp", F.col("conf_raw").alias("confidence"), F.when(F.col("night"), "N").otherwise("D").alias("daynight"),
        F.col("sensor").alias("satellite"), F.col("day").alias("acq_date"), (F.col("acq_hour") * 100).alias("acq_time"),
    )
    rows.write.option("header", True).csv(path)
    feeds.register(spark)
    found = spark.read.format("burncal_detections").load(path)
    return found.filter((F.col("frp") >= 40) & (F.col("day") < F.lit("2024-01-11").cast("date")))


def feed_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each day, with sensors and their points in the order of ids."""
    point = F.struct("pt_seq", "lat", "lon", "frp", F.col("conf_raw").alias("confRaw"), "night", F.col("sensor").alias("sat"), F.format_string("%02d:00 UTC", "acq_hour").alias("acq"))
    sensors = detections(spark, sf_dir).groupBy("day", "sensor").agg(F.sort_array(F.collect_list(point)).alias("points"))
    days = sensors.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("sensor", F.struct("points")))).alias("sensors"))
    documents = days.select(F.to_json(F.struct(F.map_from_arrays(F.array(F.col("day").cast("string")), F.array(F.struct("sensors"))).alias("days"))))
    return _files(spark, documents, "product").filter(F.col("sensor").isin("VIIRS-SNPP", "MODIS-Aqua"))


def feed_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.struct("ym", F.lit(8).cast("long").alias("sampled"), F.lit(30).cast("long").alias("days"), "est", "frp", (F.col("frp") / F.col("est")).alias("meanFrp"), F.col("hi_conf").alias("hiConf"), "night")
    sensors = calendar(spark, sf_dir).groupBy("region", "sensor").agg(F.sort_array(F.collect_list(month)).alias("monthly"))
    documents = sensors.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("sensor", F.struct("monthly")))).alias("sensors"))
    return _files(spark, documents.select(F.to_json(F.struct("region", "sensors"))), "calendar").filter(F.col("ym") >= "1995-01")


def feed_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar's sums as history, and as a forecast with a band around them."""
    sums = cut(calendar(spark, sf_dir).groupBy("region", "ym").agg(F.sum("est").alias("est")))
    mean = F.col("est").cast("double")
    rows = sums.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("ym", "est"))).alias("history"), F.sort_array(F.collect_list(F.struct("ym", mean.alias("mean"), (mean / 2).alias("lo"), (mean * 2).alias("hi")))).alias("forecast"))
    return _files(spark, rows.select(F.to_json(F.struct("region", "history", "forecast"))), "outlook").filter(F.col("region").startswith("A"))


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each day; an event has a point or a ring."""
    rows = detections(spark, sf_dir)
    point, ring = F.to_json(F.array("lon", "lat")), F.to_json(F.array(F.array(F.array("lon", "lat"), F.array("lat", "lon"))))
    geometry = F.format_string('[{"date":"old","coordinates":[0,0]},{"date":"%s","coordinates":%s}]', F.col("day").cast("string"), F.when(F.col("pt_seq") % 2 == 0, point).otherwise(ring))
    event = F.format_string('{"id":"E%d","title":"fire","link":"l","sources":[{"id":"%s"}],"geometry":%s}', "pt_seq", "sensor", geometry)
    documents = rows.groupBy("day").agg(F.concat(F.lit('{"events":['), F.array_join(F.collect_list(event), ","), F.lit("]}")).alias("value"))
    found = _files(spark, documents.select("value"), "events")
    return found.select("event_id", F.array_join("sources", ",").alias("sources"), "date", "lon", "lat")


def feed_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.sort_array(F.collect_list(F.struct(F.col("day").cast("string").alias("time"), "tmax", "rh", "wind", "precip")))
    each = weather(spark, sf_dir).agg(days.alias("d"))
    daily = F.struct(F.col("d.time").alias("time"), F.col("d.tmax").alias("temperature_2m_max"), F.col("d.rh").alias("relative_humidity_2m_mean"), F.col("d.wind").alias("wind_speed_10m_max"), F.col("d.precip").alias("precipitation_sum"))
    return _files(spark, each.select(F.to_json(F.struct(daily.alias("daily")))), "weather").filter(F.col("tmax") > 20)


QUERIES = {"feed_detections": feed_detections, "feed_product": feed_product, "feed_calendar": feed_calendar, "feed_outlook": feed_outlook, "feed_events": feed_events, "feed_weather": feed_weather}

ORACLES = {
    "feed_detections": oracle("select lat, lon, frp, conf_raw, night, sensor as satellite, day, printf('%02d:00 UTC', acq_hour) as acquired from det where frp>=40 and day<date '2024-01-11'", "det"),
    "feed_product": oracle(
        "select day, sensor, cast(row_number() over (partition by day, sensor order by pt_seq)-1 as int) as seq, lat, lon, frp, conf_raw, night, sensor as satellite, printf('%02d:00 UTC', acq_hour) as acquired from det where sensor in ('VIIRS-SNPP','MODIS-Aqua')", "det"
    ),
    "feed_calendar": oracle(
        "select * from (select region, sensor, cast(row_number() over (partition by region, sensor order by ym)-1 as int) as seq, ym, cast(8 as bigint) as sampled, cast(30 as bigint) as days, est, frp, cast(frp as double)/est as mean_frp, hi_conf, night from cal) x where ym>='1995-01'", "cal"
    ),
    "feed_outlook": oracle(
        "select region, 'history' as part, ym, cast(e as double) as mean, cast(null as double) as lo, cast(null as double) as hi from su where region like 'A%' union all select region, 'forecast', ym, cast(e as double), e/2e0, e*2e0 from su where region like 'A%'",
        "cal", su="select region, ym, sum(est) as e from cal group by 1,2",
    ),
    "feed_events": oracle("select 'E'||pt_seq as event_id, sensor as sources, cast(day as varchar) as date, lon, lat from det", "det"),
    "feed_weather": oracle("select day, tmax, rh, wind, precip from wx where tmax>20", "wx"),
}
