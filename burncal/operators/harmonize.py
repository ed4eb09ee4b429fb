"""From two sensor families to one monthly record. Three ways exist and stay apart: unified (VIIRS wins, MODIS scaled by the median
ratio), fused (MODIS wins, VIIRS divided by the mean ratio) and the plain sum of all sensors."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burncal.functions.scalars import counts_as_high, exact_sum, month_of, rounded, year_of

MODIS, VIIRS = "MODIS-Terra", "VIIRS-SNPP"


def month_rows(detections: DataFrame, days=(8, 22), group=("sensor",)) -> DataFrame:
    """Months from two sampled days (in short months the last day counts): counts and power scaled to the whole month."""
    last = F.dayofmonth(F.last_day("day"))
    sampled = detections.filter(functools.reduce(operator.or_, (F.dayofmonth("day") == F.least(F.lit(d), last) for d in days)))
    n, share = F.count("*"), F.max(last) / F.lit(float(len(days)))
    scaled = lambda x: rounded(x * share)
    return sampled.groupBy(*group, F.date_format("day", "yyyy-MM").alias("ym")).agg(
        n.alias("sampled"),
        F.max(last).cast("long").alias("days"),
        scaled(n).alias("est"),
        scaled(exact_sum("frp")).alias("frp"),
        rounded(exact_sum("frp") / n, 1).alias("mean_frp"),
        scaled(F.count_if(counts_as_high("conf_raw"))).alias("hi_conf"),
        scaled(F.count_if("night")).alias("night"),
    )


def paired(calendar: DataFrame) -> DataFrame:
    """One row per region and month with both sensors' numbers, null where a sensor has none. Where rows have a place (seq), of a month that
    comes twice MODIS's first and VIIRS's last row counts; without places the larger numbers do."""
    both = calendar.filter(F.col("sensor").isin(MODIS, VIIRS)).groupBy("region", "ym")

    def number(sensor: str, c: str):
        own = F.when(F.col("sensor") == sensor, F.col(c))
        if "seq" not in calendar.columns:
            return F.max(own)
        return (F.min_by if sensor == MODIS else F.max_by)(own, F.when(F.col("sensor") == sensor, F.col("seq")))

    return both.agg(*(number(s, c).alias(f"{p}_{c}") for s, p in ((MODIS, "m"), (VIIRS, "v")) for c in ("est", "frp")))


def overlap_ratio(calendar: DataFrame) -> DataFrame:
    """Per region over months with both: median ratios of count and power, their variation, number of months, mean of ratios of 3 decimals."""
    met = paired(calendar).filter("m_est > 0 and v_est > 0")
    c = F.col("v_est") / F.col("m_est")
    f = F.col("v_frp") / F.greatest(F.lit(1), F.col("m_frp"))
    return met.groupBy("region").agg(
        F.percentile(c, 0.5).alias("ratio_count"),
        F.percentile(f, 0.5).alias("ratio_frp"),
        rounded(F.stddev_pop(c) / F.greatest(F.lit(1e-6), F.avg(c)), 3).alias("ratio_cv"),
        F.count("*").alias("overlap_months"),
        rounded(exact_sum(rounded(c, 3)) / F.count("*"), 3).alias("mean_ratio"),
    )


def _ratios(rows: DataFrame) -> tuple[Column, Column]:
    """Ratios of count and of power, null but in months with both sensors."""
    both = (F.col("m_est") > 0) & (F.col("v_est") > 0)
    return F.when(both, F.col("v_est") / F.col("m_est")), F.when(both, F.col("v_frp") / F.greatest(F.lit(1), F.col("m_frp")))


def unified_series(calendar: DataFrame) -> DataFrame:
    """region, ym, count, frp, scaled: VIIRS where it exists, else MODIS times the region's median ratio. Empty months are left out. The
    ratios come from a window over a region's months, so the months are made once."""
    rows, own = paired(calendar), Window.partitionBy("region")
    of_count, of_power = (F.coalesce(F.percentile(x, 0.5).over(own), F.lit(1.0)) for x in _ratios(rows))
    rows = rows.withColumn("ratio_count", of_count).withColumn("ratio_frp", of_power)
    has_v = F.col("v_est").isNotNull()
    count = F.when(has_v, F.col("v_est")).otherwise(rounded(F.col("m_est") * F.col("ratio_count")))
    frp = F.when(has_v, F.col("v_frp")).otherwise(rounded(F.col("m_frp") * F.col("ratio_frp")))
    return rows.select("region", "ym", count.alias("count"), frp.alias("frp"), (~has_v).alias("scaled")).filter("count > 0 or frp > 0")


def outlook_fused(calendar: DataFrame, default_ratio: float = 8.0) -> DataFrame:
    """region, ym, est: MODIS where it exists, else VIIRS divided by the region's mean ratio."""
    rows, own = paired(calendar), Window.partitionBy("region")
    three = rounded(_ratios(rows)[0], 3).cast("decimal(28,10)")
    mean = rounded(F.sum(three).over(own).cast("double") / F.nullif(F.count(three).over(own), F.lit(0)), 3)
    rows = rows.withColumn("mean_ratio", mean)
    ratio = F.coalesce(F.when(F.col("mean_ratio") != 0, F.col("mean_ratio")), F.lit(default_ratio))
    return rows.select("region", "ym", F.coalesce(F.col("m_est"), rounded(F.col("v_est") / ratio), F.lit(0)).alias("est"))


def harmonization(calendar: DataFrame, months: int = 6) -> DataFrame:
    """region, overlap_months, mean_ratio, sample: the block of a calendar document, with the last months that both sensors have."""
    met = paired(calendar).filter("m_est > 0 and v_est > 0")
    sample = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("ym", rounded(F.col("v_est") / F.col("m_est"), 3).alias("ratio"), F.col("m_est").alias("m"), F.col("v_est").alias("s"))))), 1, months)
    last = met.groupBy("region").agg(F.reverse(sample).alias("sample"))  # a region's months
    return overlap_ratio(calendar).select("region", "overlap_months", "mean_ratio").join(last, "region")


def all_sensor_months(calendar: DataFrame) -> DataFrame:
    """region, ym and the plain sums over all sensors, with confident and night shares."""
    sums = calendar.groupBy("region", "ym").agg(*(F.sum(c).alias(c) for c in ("est", "frp", "hi_conf", "night")))
    at_least_one = F.greatest(F.col("est"), F.lit(1))
    return sums.withColumn("hi_share", F.col("hi_conf") / at_least_one).withColumn("night_share", F.col("night") / at_least_one)


def lag_features(calendar: DataFrame) -> DataFrame:
    """What the model of extreme months was trained on: lags 1 and 12, the mean of lags 3 to 5, shares of the month before, the next month.
    Months count by row."""
    w = Window.partitionBy("region").orderBy("ym")
    three = w.rowsBetween(-2, 0)
    rows = all_sensor_months(calendar).withColumn("lag3", F.lag("est", 3).over(w))
    return rows.select(
        "region", "ym", "est",
        F.lag("est", 1).over(w).alias("est_lag1"), F.avg("lag3").over(three).alias("est_lag3"), F.lag("est", 12).over(w).alias("est_lag12"),
        F.lag("frp", 1).over(w).alias("frp_lag1"), F.lag("hi_share", 1).over(w).alias("hic_lag1"), F.lag("night_share", 1).over(w).alias("night_lag1"),
        F.lead("est", 1).over(w).alias("est_next"),
    )


def train_climatology(calendar: DataFrame, last_year: int = 2021) -> DataFrame:
    """Mean and sample deviation per region and month of the training years, at least 1; one value alone counts as 0.6 of the mean."""
    rows = all_sensor_months(calendar).filter(year_of("ym") <= last_year).groupBy("region", month_of("ym").alias("month"))
    return rows.agg(F.avg("est").alias("clim_mean"), F.greatest(F.lit(1.0), F.coalesce(F.stddev_samp("est"), F.avg("est") * 0.6)).alias("clim_std"))


def extreme_months(calendar: DataFrame, last_year: int = 2021, z: float = 2.0) -> DataFrame:
    """The label of the trainer: whether the next month lies z deviations above the climatology of its row's month; a month without one takes the
    region's mean, then its own value."""
    rows = lag_features(calendar).withColumn("month", month_of("ym"))
    region = all_sensor_months(calendar).filter(year_of("ym") <= last_year).groupBy("region").agg(F.avg("est").alias("region_mean"))
    joined = rows.join(train_climatology(calendar, last_year), ["region", "month"], "left").join(region, "region", "left")
    mean = F.coalesce("clim_mean", "region_mean", F.col("est").cast("double"))
    std = F.greatest(F.lit(1.0), F.coalesce(F.col("clim_std"), mean * 0.6))
    score = (F.col("est_next") - mean) / std
    return joined.select("region", "ym", score.alias("z_next"), F.coalesce((score >= z).cast("int"), F.lit(0)).alias("y"))
