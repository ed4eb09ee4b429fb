"""Tables for other users: regime matrix, emissions, long calendar, GeoJSON, JSON documents, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burncal.functions.scalars import SENSORS, col, month_of, rounded, year_of
from burncal.operators.harmonize import all_sensor_months, harmonization


def regime_matrix(calendar: DataFrame) -> DataFrame:
    """One row per region: months, totals, peak month (the first of equals), power (in millions, as published), seasonality, active months."""
    months = all_sensor_months(calendar)
    by_month = months.groupBy("region", month_of("ym").alias("month")).agg(F.avg("est").alias("m"))
    peak = by_month.groupBy("region").agg(F.max("m").alias("peak_mean"), F.min_by("month", F.struct(-F.col("m"), F.col("month"))).alias("peak_month"))
    mean = F.avg("est").over(Window.partitionBy("region"))
    whole = months.withColumn("active", F.col("est") > mean * 0.1).groupBy("region").agg(
        F.count("*").alias("months"), F.sum("est").alias("total"), F.avg("est").alias("mean"), F.sum("frp").alias("frp"),
        ((F.max("est") - F.min("est")) / F.greatest(F.avg("est"), F.lit(1.0))).alias("season"), (F.count_if("active") * 100.0 / F.count("*")).alias("active"),
    )
    return whole.join(peak, "region").select(
        "region", "months", "total", rounded("mean", 1).alias("mean_monthly"), "peak_month", rounded("peak_mean", 1).alias("peak_month_mean"),
        rounded(F.col("frp") / 1e6, 1).alias("frp_millions"), rounded("season", 2).alias("seasonality_index"), rounded("active", 1).alias("active_months_pct"),
    )


def emissions(months: DataFrame, tau: float = 1800.0, double_scale: bool = True) -> DataFrame:
    """Energy, dry matter and CO2 per region and year from month rows (region, ym, sampled, est, frp), each rounded before the next. With
    double_scale, as published, the month's power is multiplied by est / sampled once more."""
    ratio = F.when(F.col("sampled") > 0, F.col("est") / F.col("sampled")).otherwise(1.0) if double_scale else F.lit(1.0)
    years = months.groupBy("region", year_of("ym").alias("year")).agg(F.sum("frp").alias("frp_mw"), F.sum((F.col("frp") * ratio).cast("decimal(28,6)")).cast("double").alias("frp_scaled_mw"), F.sum("est").alias("est"))
    return years.transform(emission_chain, tau)


def emission_chain(years: DataFrame, tau: float = 1800.0) -> DataFrame:
    """Adds fre_tj, dry_matter_kt and co2_mt to rows with frp_scaled_mw."""
    energy = years.withColumn("fre_tj", rounded(F.col("frp_scaled_mw") * tau / 1e6, 1))
    matter = energy.withColumn("dry_matter_kt", rounded(F.col("fre_tj") * 0.223, 1))
    return matter.withColumn("co2_mt", rounded(F.col("dry_matter_kt") * 1.613e-3, 2))


def points_geojson(detections: DataFrame, limit: int = 6000) -> DataFrame:
    """One GeoJSON feature per detection, sensors in display order, the first `limit`. Places are decimals, which JSON writes without exponents."""
    rank = F.array_position(F.array(*map(F.lit, SENSORS)), F.col("sensor"))
    first = detections.orderBy(rank, "pt_seq").limit(limit)
    point = F.struct(F.lit("Point").alias("type"), F.array(*(F.col(c).cast("decimal(12,5)") for c in ("lon", "lat"))).alias("coordinates"))
    return first.select("pt_seq", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("frp", "sensor", "night").alias("properties"))).alias("feature"))


def clusters_geojson(clusters: DataFrame) -> DataFrame:
    """One GeoJSON polygon per cluster with a hull of at least three points; the ring is closed."""
    ring = F.concat("hull", F.slice("hull", 1, 1))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    facts = F.struct("day", "cluster_id", "class", "n", rounded("frp_sum").alias("frp_sum"), F.array_join(F.map_keys("sensors"), ", ").alias("sensors"))
    return clusters.filter(F.size("hull") >= 3).select("day", "cluster_id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), facts.alias("properties"))).alias("feature"))


def detections_csv(detections: DataFrame) -> DataFrame:
    """The columns of the CSV export, empty where a feed has none; write with `.write.csv(path, header=True)`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in detections.columns else F.lit("")
    return detections.select(
        "sensor", text("satellite").alias("satellite"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("frp").alias("frp_mw"), text("conf_raw").alias("confidence"),
        F.when(col("night"), "N").otherwise("D").alias("daynight"), text("acquired").alias("acq_time"),
    )


def calendar_json(calendar: DataFrame) -> DataFrame:
    """One document per region: its sensors with their months, in order, and how MODIS and VIIRS compare (no numbers where they never meet)."""
    months = F.sort_array(F.collect_list(F.struct("ym", "est", "frp", "hi_conf", "night")))  # a region's months
    per_sensor = calendar.groupBy("region", "sensor").agg(months.alias("monthly"))
    document = F.map_from_entries(F.sort_array(F.collect_list(F.struct("sensor", F.struct("monthly").alias("data")))))
    sensors = per_sensor.groupBy("region").agg(document.alias("sensors"))
    block = harmonization(calendar).select("region", F.struct(F.col("overlap_months").alias("overlapMonths"), F.col("mean_ratio").alias("meanRatioSNPPtoMODIS"), "sample").alias("harmonization"))
    return sensors.join(block, "region", "left").select("region", F.to_json(F.struct("region", "sensors", "harmonization")).alias("document"))


def outlook_json(fused: DataFrame, outlook: DataFrame, peaks: DataFrame, history: int = 36) -> DataFrame:
    """One document per region: last months, forecast, peak months."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("ym")))
    past = fused.withColumn("r", rank).filter(F.col("r") <= history).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("ym", "est"))).alias("history"))
    ahead = outlook.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("ym", "mean", "lo", "hi"))).alias("forecast"))
    top = peaks.groupBy("region").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "month"))), lambda s: F.lpad(s["month"].cast("string"), 2, "0")).alias("peakMonths"))
    return past.join(ahead, "region").join(top, "region").select("region", F.to_json(F.struct("region", "history", "forecast", "peakMonths")).alias("document"))
