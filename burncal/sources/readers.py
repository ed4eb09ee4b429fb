"""Sources: detection CSV, nested products, calendar and outlook documents, event and weather feeds, tiles; and rules of their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burncal.functions.scalars import time_label

POINT = "struct<lat:double,lon:double,frp:double,conf:double,confRaw:string,night:boolean,sat:string,acq:string>"
DAYS = f"map<string,struct<sensors:map<string,struct<points:array<{POINT}>>>>>"
MONTH = "struct<ym:string,sampled:long,days:long,est:long,frp:double,meanFrp:double,hiConf:long,night:long>"
CALENDAR = f"region string, name string, bbox array<double>, sensors map<string,struct<layer:string,monthly:array<{MONTH}>>>"
OUTLOOK = "region string, model string, method string, history array<struct<ym:string,est:double>>, forecast array<struct<ym:string,mean:double,lo:double,hi:double>>, peakMonths array<string>"
EVENTS = "events array<struct<id:string,title:string,link:string,sources:array<struct<id:string>>,geometry:array<struct<date:string,coordinates:string>>>>"
WEATHER = "daily struct<time:array<string>,temperature_2m_max:array<double>,relative_humidity_2m_mean:array<double>,wind_speed_10m_max:array<double>,precipitation_sum:array<double>>"


def read_detections_csv(spark: SparkSession, path: str, sensor: str | None = None) -> DataFrame:
    """Detections from CSV files with headers in any case. Rows without a place, and rows shorter than the header, go; power that is no number
    is 0; numbers stay text until they are cast, so one bad cell costs no row."""
    named = spark.read.csv(path, header=True)
    short = F.size(F.split("_line", ",")) < len(named.columns)  # _line is there where a row has more or fewer cells than the header
    raw = spark.read.schema(named.schema.add("_line", "string")).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    raw = raw.filter(F.col("_line").isNull() | ~short).drop("_line")
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    get = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(
        get("latitude").try_cast("double").alias("lat"), get("longitude").try_cast("double").alias("lon"), F.coalesce(get("frp").try_cast("double"), F.lit(0.0)).alias("frp"),
        get("confidence").alias("conf_raw"), F.coalesce(F.upper(F.trim(get("daynight"))) == "N", F.lit(False)).alias("night"), get("satellite").alias("satellite"),
        get("acq_date").try_cast("date").alias("day"), time_label(get("acq_time")).alias("acquired"), F.lit(sensor).alias("sensor"),
    ).filter("lat is not null and lon is not null")


def read_product(spark: SparkSession, path: str) -> DataFrame:
    """Days, sensors and points of a nested JSON product as rows; the position within a sensor-day is kept."""
    text = spark.read.text(path, wholetext=True)
    days = text.select(F.explode(F.from_json("value", f"days {DAYS}")["days"]).alias("day", "d"))
    sensors = days.select("day", F.explode("d.sensors").alias("sensor", "s"))
    points = sensors.select("day", "sensor", F.posexplode("s.points").alias("seq", "p"))
    return points.select(F.col("day").try_cast("date").alias("day"), "sensor", "seq", "p.lat", "p.lon", F.coalesce("p.frp", F.lit(0.0)).alias("frp"), F.col("p.confRaw").alias("conf_raw"), F.coalesce("p.night", F.lit(False)).alias("night"), F.col("p.sat").alias("satellite"), F.col("p.acq").alias("acquired"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Month rows of calendar documents; seq is the place within a sensor."""
    documents = spark.read.schema(CALENDAR).json(path, multiLine=True)
    sensors = documents.select("region", F.explode("sensors").alias("sensor", "s"))
    months = sensors.select("region", "sensor", F.posexplode("s.monthly").alias("seq", "m"))
    return months.select("region", "sensor", "seq", "m.ym", "m.sampled", "m.days", "m.est", F.col("m.frp").cast("long").alias("frp"), F.col("m.meanFrp").alias("mean_frp"), F.col("m.hiConf").alias("hi_conf"), "m.night")


def read_outlook(spark: SparkSession, path: str) -> DataFrame:
    """Forecast rows of outlook documents, and with history rows (mean only) before them."""
    documents = spark.read.schema(OUTLOOK).json(path, multiLine=True)
    past = documents.select("region", F.explode("history").alias("h")).select("region", F.lit("history").alias("part"), "h.ym", F.col("h.est").alias("mean"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    ahead = documents.select("region", F.explode("forecast").alias("f")).select("region", F.lit("forecast").alias("part"), "f.ym", "f.mean", "f.lo", "f.hi")
    return past.unionByName(ahead)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with the place of their last geometry: a point, or the first vertex of its first ring."""
    events = spark.read.schema(EVENTS).json(path, multiLine=True).select(F.explode("events").alias("e"))
    last = F.try_element_at("e.geometry", F.lit(-1))
    flat = F.from_json(F.concat(F.lit("["), F.regexp_replace(last["coordinates"], r"[\[\]\s]", ""), F.lit("]")), "array<double>")
    return events.select(F.col("e.id").alias("event_id"), "e.title", "e.link", F.transform("e.sources", lambda s: s["id"]).alias("sources"), last["date"].alias("date"), F.get(flat, F.lit(0)).alias("lon"), F.get(flat, F.lit(1)).alias("lat"))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Days from parallel arrays."""
    d = spark.read.schema(WEATHER).json(path, multiLine=True).select("daily.*")
    rows = d.select(F.explode(F.arrays_zip("time", "temperature_2m_max", "relative_humidity_2m_mean", "wind_speed_10m_max", "precipitation_sum")).alias("x"))
    return rows.select(F.col("x.time").try_cast("date").alias("day"), F.col("x.temperature_2m_max").alias("tmax"), F.col("x.relative_humidity_2m_mean").alias("rh"), F.col("x.wind_speed_10m_max").alias("wind"), F.coalesce("x.precipitation_sum", F.lit(0.0)).alias("precip"))


def tile_cover(boxes: DataFrame, degrees: float = 9.0) -> DataFrame:
    """The tiles of a grid of degrees that meet each box (key, west, south, east, north): key, tx, ty. Tile 0, 0 is north-west."""
    columns, rows = int(360 / degrees), int(180 / degrees)

    def at(value: Column, most: int) -> Column:
        return F.least(F.lit(most - 1), F.greatest(F.lit(0), F.floor(value / degrees))).cast("int")

    xs = F.sequence(at(F.col("west") + 180, columns), at(F.col("east") + 180, columns))
    ys = F.sequence(at(F.lit(90.0) - F.col("north"), rows), at(F.lit(90.0) - F.col("south"), rows))
    return boxes.select("key", F.explode(xs).alias("tx"), ys.alias("ys")).select("key", "tx", F.explode("ys").alias("ty"))


def window_days(day: Column, days: Column) -> Column:
    """The days of a window that ends at a day; its length is held between 1 and 10."""
    n = F.least(F.lit(10), F.greatest(F.lit(1), days)).cast("int")
    return F.sequence(F.date_sub(day, n - 1), day)


def is_archive(day: Column, today: Column | None = None, days: int = 95) -> Column:
    return day < F.date_sub(today if today is not None else F.current_date(), days)


def date_islands(days: DataFrame, key: str, longest: int = 10) -> DataFrame:
    """Runs of consecutive days of each key, no longer than `longest`: key, first_day, last_day, days."""
    w = Window.partitionBy(key).orderBy("day")
    islands = days.select(key, "day").distinct().withColumn("island", F.date_sub("day", F.row_number().over(w)))
    chunk = F.floor((F.row_number().over(Window.partitionBy(key, "island").orderBy("day")) - 1) / longest)
    runs = islands.withColumn("chunk", chunk).groupBy(key, "island", "chunk")
    return runs.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island", "chunk")


def source_precedence(rows: DataFrame, slot: list[str], order: list[str], source: str = "source") -> DataFrame:
    """Rows of the first source, in the given order, that has any for its slot. The slots' best sources are pre-aggregated; the rows are joined to
    them."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    best = rows.groupBy(*slot).agg(F.min(rank).alias("best"))
    return rows.withColumn("rank", rank).join(best, slot).filter("rank = best").drop("rank", "best")


def source_flags(rows: DataFrame, group: list[str], first: str, source: str = "source") -> DataFrame:
    """Per group whether all its rows come from the first source, some (mixed) or none; with none the flag is the least other source."""
    own = F.col(source) == first
    flag = F.when(F.bool_and(own), first).when(F.bool_or(own), "mixed").otherwise(F.min(source))
    return rows.groupBy(*group).agg(flag.alias("flag"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests (w, s, e, n, day as text, days) for a real box with finite sides and a day like 2024-01-31; the number of days is held between 1 and
    10, and is 1 if there is none."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != F.lit(float("inf"))) for c in ("w", "s", "e", "n")]
    good = finite[0] & finite[1] & finite[2] & finite[3] & (F.col("e") > F.col("w")) & (F.col("n") > F.col("s")) & F.coalesce(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    return requests.filter(good).withColumn("days", F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce("days", F.lit(1)))).cast("int"))


def clamp_to_latest(asked: DataFrame, available: DataFrame) -> DataFrame:
    """sensor, day asked for, day_used and whether it was clamped to the sensor's latest day. There are few sensors."""
    latest = available.groupBy("sensor").agg(F.max("day").alias("latest"))
    return asked.join(F.broadcast(latest), "sensor").select("sensor", "day", F.least("day", "latest").alias("day_used"), (F.col("day") > F.col("latest")).alias("clamped"))


def previous_day_fallback(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the day asked for; where a sensor has none, those of the day before."""
    there = rows.select("sensor", "day").distinct()
    used = asked.join(there.withColumn("has", F.lit(True)), ["sensor", "day"], "left").select("sensor", F.col("day").alias("asked"), F.when(F.col("has"), F.col("day")).otherwise(F.date_sub("day", 1)).alias("day"))
    return used.join(rows, ["sensor", "day"])
