"""Group aggregates over detections. Every one is a single aggregation with map-side combine; sums are exact decimals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burncal.functions.scalars import MODIS, SENSORS, VIIRS, confidence, exact_sum, in_box, rounded, threat_score

#: Histogram bins of fire radiative power, lower ends; the last is open.
FRP_BINS = [(0.0, "<5"), (5.0, "5-10"), (10.0, "10-25"), (25.0, "25-60"), (60.0, "60-120"), (120.0, "120-250"), (250.0, "250-500"), (500.0, "500+")]


def with_confidence(detections: DataFrame) -> DataFrame:
    return detections.withColumn("conf", confidence("conf_raw"))


def sensor_day_summary(detections: DataFrame, box) -> DataFrame:
    """Count, mean and largest power, confident detections and share of the night, for each day and sensor in a box."""
    inside = with_confidence(detections.filter(in_box("lon", "lat", box)))
    n = F.count("*")
    return inside.groupBy("day", "sensor").agg(
        n.alias("n"),
        rounded(exact_sum("frp") / n, 1).alias("mean_frp"),
        rounded(F.max("frp"), 1).alias("max_frp"),
        F.count_if(F.col("conf") >= 80).alias("hi_conf"),
        rounded(F.count_if("night") * 100.0 / n, 1).alias("night_pct"),
    )


def frp_histogram(detections: DataFrame) -> DataFrame:
    """Rows of every bin, empty ones too; no power counts as 0.5."""
    power = F.when(F.coalesce("frp", F.lit(0.0)) == 0, 0.5).otherwise(F.col("frp"))
    label: Column = F.lit(FRP_BINS[0][1])
    for low, name in FRP_BINS[1:]:
        label = F.when(power >= low, name).otherwise(label)
    counted = detections.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    bins = detections.sparkSession.createDataFrame([(i, name) for i, (_, name) in enumerate(FRP_BINS)], "bin int, label string")
    return bins.join(counted, "label", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"))


def diurnal_signature(detections: DataFrame) -> DataFrame:
    """Detections of each hour, empty hours too."""
    hours = detections.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counted = detections.groupBy(F.col("acq_hour").alias("hour")).agg(F.count("*").alias("n"), F.count_if("night").alias("night"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("night", F.lit(0)).alias("night"))


def bin_size(box) -> float:
    return min(2.0, max(0.25, float(f"{max(box[2] - box[0], box[3] - box[1]) / 24:.2f}")))


def hexbin(detections: DataFrame, box) -> DataFrame:
    """Square cells as wide as the area asks for, with their share of the fullest cell."""
    size = bin_size(box)
    cells = detections.groupBy(F.floor(F.col("lon") / size).alias("gx"), F.floor(F.col("lat") / size).alias("gy")).agg(F.count("*").alias("n"), exact_sum("frp").alias("frp"))
    largest = cells.agg(F.max("n").alias("max_n"))  # one row
    return cells.join(F.broadcast(largest)).select("gx", "gy", "n", "frp", ((F.col("gx") + 0.5) * size).alias("lon"), ((F.col("gy") + 0.5) * size).alias("lat"), "max_n")


def quarter_degree_top(detections: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    """The k fullest quarter-degree cells, of those the ones with enough detections."""
    cells = detections.groupBy((F.floor(F.col("lat") * 4 + 0.5) / 4).alias("lat"), (F.floor(F.col("lon") * 4 + 0.5) / 4).alias("lon")).agg(F.count("*").alias("n"), exact_sum("frp").alias("frp"))
    return cells.orderBy(F.desc("n"), "lat", "lon").limit(k).filter(F.col("n") >= least)


def field_cells(detections: DataFrame, box, cell: float | None = None) -> DataFrame:
    """Cells of the fire field: indexes clamped into the area; count, power, mean confidence (60 where unknown), night, maximum."""
    west, south, east, north = box
    wide, high = max(0.5, east - west), max(0.5, north - south)
    cell = cell or max(0.05, min(wide, high) / 26)
    columns, rows = math.ceil(wide / cell), math.ceil(high / cell)
    gx = F.least(F.lit(columns - 1), F.greatest(F.lit(0), F.floor((F.col("lon") - west) / cell))).cast("int")
    gy = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor((F.col("lat") - south) / cell))).cast("int")
    n = F.count("*")
    return with_confidence(detections).groupBy(gx.alias("gx"), gy.alias("gy")).agg(
        n.alias("n"),
        exact_sum("frp").alias("frp_sum"),
        (F.sum(F.coalesce("conf", F.lit(60))).cast("double") / n).alias("mean_conf"),
        (F.count_if("night") * 100.0 / n).alias("night_pct"),
        F.max("frp").alias("max_frp"),
    )


def cell_field(detections: DataFrame, box, k: int = 900) -> DataFrame:
    """The k fullest cells of the fire field."""
    return field_cells(detections, box).orderBy(F.desc("n"), "gx", "gy").limit(k)


def concentration(cells: DataFrame) -> DataFrame:
    """Share of all power in the tenth of the cells with the most; a row only from four cells on. Cells are a bounded top k."""
    rank = F.row_number().over(Window.orderBy(F.desc("frp_sum"), "gx", "gy"))
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) * 0.1 + 0.5))
    ranked = cells.select("frp_sum", rank.alias("rank"), k.cast("long").alias("top_k"))
    share = exact_sum(F.when(F.col("rank") <= F.col("top_k"), F.col("frp_sum")).otherwise(0)) * 100 / exact_sum("frp_sum")
    return ranked.agg(F.count("*").alias("cells"), F.max("top_k").alias("top_k"), share.alias("share_pct")).filter("cells >= 4")


def daily_dynamics(detections: DataFrame) -> DataFrame:
    """Per day: detections of each sensor, total, power, night and confident ones."""
    per_sensor = [F.count_if(F.col("sensor") == s).alias("n_" + s.lower().replace("-", "_")) for s in SENSORS]
    return with_confidence(detections).groupBy("day").agg(
        *per_sensor, F.count("*").alias("total"), exact_sum("frp").alias("frp"), F.count_if("night").alias("night"), F.count_if(F.col("conf") >= 80).alias("hi_conf")
    )


def modis_viirs_by_day(detections: DataFrame) -> DataFrame:
    """Detections of the two sensor families, days without either left out."""
    m, v = F.count_if(F.col("sensor").isin(*MODIS)), F.count_if(F.col("sensor").isin(*VIIRS))
    return detections.groupBy("day").agg(m.alias("m"), v.alias("v")).filter("m > 0 or v > 0")


def window_verdict(detections: DataFrame) -> DataFrame:
    """First against last day of the window, the busiest day and the day with the most power (the first of equals), the VIIRS to MODIS ratio of
    the last day and the share of confident detections."""
    days = daily_dynamics(detections)
    viirs = sum(F.col("n_" + s.lower().replace("-", "_")) for s in VIIRS)
    modis = sum(F.col("n_" + s.lower().replace("-", "_")) for s in MODIS)
    earliest = -F.unix_date("day")
    one = days.agg(
        F.min_by("total", "day").alias("first_total"),
        F.max_by("total", "day").alias("last_total"),
        F.max_by("day", F.struct(F.col("total"), earliest)).alias("busiest_day"),
        F.max_by("day", F.struct(F.col("frp"), earliest)).alias("frp_day"),
        F.max_by(viirs.cast("double") / F.when(modis > 0, modis), "day").alias("last_ratio"),
        (F.sum("hi_conf").cast("double") / F.sum("total")).alias("hi_share"),
    )
    change = F.when(F.col("first_total") > 0, (F.col("last_total") - F.col("first_total")) * 100.0 / F.col("first_total")).otherwise(0.0)
    return one.withColumn("change_pct", change).withColumn("trend", F.when(change > 15, "ESCALATING").when(change < -15, "DECLINING").otherwise("STEADY"))


def alert_level(detections: DataFrame) -> DataFrame:
    """Alert of each day by number of detections and power."""
    days = detections.groupBy("day").agg(F.count("*").alias("total"), exact_sum("frp").alias("frp"))
    level = F.when((F.col("total") >= 150) | (F.col("frp") >= 2500), "RED").when((F.col("total") >= 60) | (F.col("frp") >= 1200), "ORANGE").when(F.col("total") >= 20, "AMBER").otherwise("GREEN")
    return days.withColumn("level", level)


def threat_rollup(detections: DataFrame) -> DataFrame:
    """Detections of each day with a threat score of at least 80, and of 62 to 79."""
    score = threat_score(F.coalesce("frp", F.lit(0.0)), F.coalesce("conf", F.lit(60)), "night")
    scored = with_confidence(detections).withColumn("score", score)
    return scored.groupBy("day").agg(F.count_if(F.col("score") >= 80).alias("extreme"), F.count_if(F.col("score").between(62, 79)).alias("high"))


def live_totals(detections: DataFrame) -> DataFrame:
    """One row: count, mean power, confident and night shares, largest power."""
    n = F.count("*")
    return with_confidence(detections).agg(
        n.alias("n"), (exact_sum("frp") / n).alias("mean_frp"), (F.count_if(F.col("conf") >= 80) * 100.0 / n).alias("hi_pct"), (F.count_if("night") * 100.0 / n).alias("night_pct"), F.max("frp").alias("max_frp")
    )


def grid_histogram(detections: DataFrame, box, cell: float) -> DataFrame:
    """Count and power of each raster cell inside the box; what lies outside is dropped."""
    west, south, east, north = box
    i, j = F.floor((F.col("lon") - west) / cell).cast("int"), F.floor((F.col("lat") - south) / cell).cast("int")
    wide, high = math.ceil((east - west) / cell) + 1, math.ceil((north - south) / cell) + 1
    cells = detections.select("day", i.alias("i"), j.alias("j"), "frp").filter(f"i >= 0 and i < {wide} and j >= 0 and j < {high}")
    return cells.groupBy("day", "i", "j").agg(F.count("*").alias("n"), exact_sum("frp").alias("frp"))
