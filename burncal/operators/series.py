"""Time-series statistics of the monthly record, one group per region. A region's series is a few hundred months long, so windows by
region are small however many regions there are."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from burncal.functions.constants import PROTOTYPES
from burncal.functions.scalars import month_distance, month_of, rounded, year_of


def _by_month() -> WindowSpec:
    return Window.partitionBy("region").orderBy("ym")


def climatology(series: DataFrame, baseline_end: str = "2024-01") -> DataFrame:
    """region, month (from 0), mean, std (population), both whole; peak (the first month with the highest mean) and in_window (70 % of it)."""
    base = series.filter(F.col("ym") < baseline_end).groupBy("region", (month_of("ym") - 1).alias("month"))
    stats = base.agg(F.avg("count").alias("m"), F.stddev_pop("count").alias("s"))
    months = series.select("region").distinct().crossJoin(F.broadcast(series.sparkSession.range(12).select(F.col("id").cast("int").alias("month"))))  # 12 rows
    full = months.join(stats, ["region", "month"], "left").fillna(0.0, ["m", "s"])
    top = F.max("m").over(Window.partitionBy("region"))
    peak = F.min_by("month", F.struct(-F.col("m"), F.col("month"))).over(Window.partitionBy("region"))
    return full.select("region", "month", rounded("m").alias("mean"), rounded("s").alias("std"), peak.alias("peak_month"), (F.col("m") >= 0.7 * top).alias("in_window"))


def anomaly_z(series: DataFrame, baseline_end: str = "2024-01") -> DataFrame:
    """region, ym, count, z (2 decimals) and whether |z| is at least 2. Without deviation 0.3 of the mean counts, at least 1."""
    clim = climatology(series, baseline_end).select("region", "month", "mean", "std")
    joined = series.withColumn("month", month_of("ym") - 1).join(clim, ["region", "month"])
    sd = F.when(F.col("std") != 0, F.col("std").cast("double")).otherwise(F.greatest(F.lit(1.0), F.col("mean") * 0.3))
    z = rounded((F.col("count") - F.col("mean")) / sd, 2)
    return joined.select("region", "ym", "count", z.alias("z"), (F.abs(z) >= 2).alias("unusual"))


def latest_anomalies(series: DataFrame, n: int = 3, baseline_end: str = "2024-01") -> DataFrame:
    """The last n months of each region."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("ym")))
    return anomaly_z(series, baseline_end).withColumn("r", rank).filter(F.col("r") <= n).select("region", "ym", "count", "z")


def notebook_anomaly(months: DataFrame) -> DataFrame:
    """z of each month against all years of its month, population deviation and 1e-9; for the plain sums."""
    w = Window.partitionBy("region", month_of("ym"))
    return months.select("region", "ym", "est", ((F.col("est") - F.avg("est").over(w)) / (F.stddev_pop("est").over(w) + 1e-9)).alias("z"))


def annual_totals(series: DataFrame, least_months: int = 10) -> DataFrame:
    """Years with enough months, as total, months and the total scaled to twelve."""
    years = series.groupBy("region", year_of("ym").alias("year")).agg(F.sum("count").alias("total"), F.count("*").alias("months"))
    return years.filter(F.col("months") >= least_months).withColumn("normalized", F.col("total") / (F.col("months") / 12))


def decomposition(series: DataFrame) -> DataFrame:
    """Trend (mean of the rows 6 before to 5 after; none for the first and last six), season (mean of what the trend leaves, per month) and rest."""
    i, n = F.row_number().over(_by_month()), F.count("*").over(Window.partitionBy("region"))
    mean = F.avg("count").over(_by_month().rowsBetween(-6, 5))
    trended = series.select("region", "ym", "count", F.when((i > 6) & (i <= n - 6), mean).alias("trend"))
    season = F.coalesce(F.avg(F.col("count") - F.col("trend")).over(Window.partitionBy("region", month_of("ym"))), F.lit(0.0))
    seasonal = trended.withColumn("s", season)
    return seasonal.select("region", "ym", F.col("count").alias("observed"), "trend", rounded("s").alias("seasonal"), rounded(F.col("count") - F.col("trend") - F.col("s")).alias("resid"))


def theil_sen(series: DataFrame) -> DataFrame:
    """Median of the slopes of all pairs of a region's months, the median intercept, and the slope per decade. Under four months: slope 0, mean.
    The pairs are of one region's few hundred months."""
    rows = series.select("region", (F.row_number().over(_by_month()) - 1).alias("i"), F.col("count").cast("double").alias("y"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.i") < F.col("b.i")))
    slopes = pairs.groupBy("a.region").agg(F.percentile((F.col("b.y") - F.col("a.y")) / (F.col("b.i") - F.col("a.i")), 0.5).alias("slope"))
    fitted = rows.join(slopes, "region", "left").withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    both = fitted.groupBy("region").agg(F.count("*").alias("n"), F.max("slope").alias("s"), F.percentile(F.col("y") - F.col("slope") * F.col("i"), 0.5).alias("c"), F.avg("y").alias("m"))
    slope = F.when(F.col("n") < 4, 0.0).otherwise(F.col("s"))
    return both.select("region", "n", slope.alias("slope"), F.when(F.col("n") < 4, F.col("m")).otherwise(F.col("c")).alias("intercept"), (slope * 120).alias("per_decade"))


def cusum_points(series: DataFrame) -> DataFrame:
    """Change points: where the running sum of deviations of yearly totals from their mean is lowest and highest (0 counts, at the start), with a
    score of the step between the means before and after; over 0.25, from six years on, the best two."""
    by_region, by_year = Window.partitionBy("region"), Window.partitionBy("region").orderBy("year")
    years = annual_totals(series).select("region", "year", F.col("normalized").alias("v"), F.row_number().over(by_year).alias("k"), F.count("*").over(by_region).alias("n"), F.avg("normalized").over(by_region).alias("m"), F.stddev_pop("normalized").over(by_region).alias("sd"))
    sums = years.filter("n >= 6").withColumn("cum", F.sum(F.col("v") - F.col("m")).over(by_year.rowsBetween(Window.unboundedPreceding, 0)))
    ends = sums.groupBy("region").agg(
        F.min(F.struct("cum", "k")).alias("low"), F.max(F.struct(F.col("cum"), -F.col("k"))).alias("high")
    )  # of equals the first
    low = F.when(F.col("low.cum") < 0, F.col("low.k"))
    high = F.when(F.col("high.cum") > 0, -F.col("high.col2"))
    splits = ends.select("region", F.explode(F.array(F.struct(low.alias("k"), F.lit(0).alias("o")), F.struct(high.alias("k"), F.lit(1).alias("o")))).alias("s")).select("region", F.col("s.k").alias("split"), F.col("s.o").alias("o")).filter("split is not null")
    parts = sums.join(splits, "region").filter("split < n").groupBy("region", "split", "o").agg(
        F.avg(F.when(F.col("k") <= F.col("split"), F.col("v"))).alias("before"), F.avg(F.when(F.col("k") > F.col("split"), F.col("v"))).alias("after"),
        F.max(F.when(F.col("k") == F.col("split") + 1, F.col("year"))).alias("year"), F.max("sd").alias("sd"),
    )
    score = rounded(F.least(F.lit(0.99), F.abs(F.col("before") - F.col("after")) / (F.col("sd") + 1e-9) / 1.5), 2)
    scored = parts.withColumn("score", score).filter("score > 0.25")
    best = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "o"))
    return scored.withColumn("r", best).filter("r <= 2").select("region", "year", "score", rounded("before").alias("before"), rounded("after").alias("after"))


def season_profile(fused: DataFrame, before: str = "2026-01", years: int = 15) -> DataFrame:
    """Mean and sample deviation of log1p counts of the last years of each month; 0.6 where there is one value at most. The mean is of exact
    decimals, so that months with the same counts tie in whatever order their rows come."""
    rank = F.row_number().over(Window.partitionBy("region", month_of("ym")).orderBy(F.desc("ym")))
    recent = fused.filter(F.col("ym") < before).select("region", month_of("ym").alias("month"), F.log1p("est").alias("x"), rank.alias("r")).filter(F.col("r") <= years)
    return recent.groupBy("region", "month").agg((F.sum(F.col("x").cast("decimal(24,14)")).cast("double") / F.count("x")).alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.6)).alias("std"))


def season_outlook(fused: DataFrame, before: str = "2026-01", horizon: int = 12) -> DataFrame:
    """The next months from the season's profile: mean and one deviation on either side, not below 0."""
    last = fused.groupBy("region").agg(F.max("ym").alias("last"))
    ahead = last.select("region", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "last")
    ahead = ahead.select("region", F.date_format(F.add_months(F.to_date(F.concat("last", F.lit("-01"))), F.col("h")), "yyyy-MM").alias("ym")).withColumn("month", month_of("ym"))
    joined = ahead.join(season_profile(fused, before), ["region", "month"], "left").fillna({"mean": 0.0, "std": 0.6})
    back = lambda x: F.greatest(F.lit(0), rounded(F.expm1(x)))
    return joined.select("region", "ym", back(F.col("mean")).alias("mean"), back(F.col("mean") - F.col("std")).alias("lo"), back(F.col("mean") + F.col("std")).alias("hi"))


def peak_months(fused: DataFrame, before: str = "2026-01", k: int = 3) -> DataFrame:
    """The k months with the highest mean in the season's profile."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("mean"), "month"))
    return season_profile(fused, before).withColumn("rank", rank).filter(F.col("rank") <= k).select("region", "rank", "month")


def regime_features(series: DataFrame, calendar: DataFrame, baseline_end: str = "2024-01", least_months: int = 1) -> DataFrame:
    """Peak month, seasonality (peak by median), variation between years, night share of MODIS, mean power, log10 of the median count."""
    clim = climatology(series, baseline_end).groupBy("region").agg(F.max("peak_month").alias("peak_month"), F.max("mean").alias("peak"))
    years = annual_totals(series, least_months).groupBy("region").agg(F.stddev_pop("total").alias("sd"), F.avg("total").alias("mean"))
    whole = series.groupBy("region").agg(F.percentile("count", 0.5).alias("median"), F.sum("frp").alias("frp"), F.sum("count").alias("count"))
    modis = calendar.filter("sensor = 'MODIS-Terra'").groupBy("region").agg((F.sum("night") / F.greatest(F.lit(1), F.sum("est"))).alias("night"))
    joined = clim.join(years, "region").join(whole, "region").join(modis, "region")  # one row per region each
    at_least_one = lambda x: F.greatest(F.lit(1.0), x)
    return joined.select(
        "region", "peak_month", rounded(F.col("peak") / at_least_one(F.col("median")), 2).alias("seasonality"), rounded(F.col("sd") / at_least_one(F.col("mean")), 3).alias("interannual_cv"),
        rounded("night", 3).alias("night_fraction"), rounded(F.col("frp") / F.greatest(F.lit(1), F.col("count")), 1).alias("mean_frp"), rounded(F.log10(at_least_one(F.col("median"))), 2).alias("log_median_count"),
    )


REGIME = ("seasonality", "interannual_cv", "night_fraction", "mean_frp", "log_median_count")


def regime_match(features: DataFrame) -> DataFrame:
    """Similarity of each region to each prototype (eight rows, broadcast), features standardized over the nine vectors, and the rank."""
    protos = features.sparkSession.createDataFrame(PROTOTYPES, "key string, label string, p_peak_month int, " + ", ".join(f"p_{c} double" for c in REGIME))
    rows = features.crossJoin(F.broadcast(protos))
    w, n = Window.partitionBy("region"), len(PROTOTYPES) + 1
    total = (month_distance("peak_month", "p_peak_month") / 6) ** 2
    for c in REGIME:
        mean = (F.sum(f"p_{c}").over(w) + F.col(c)) / n
        spread = F.sum((F.col(f"p_{c}") - F.col(f"mean_{c}")) ** 2).over(w) + (F.col(c) - F.col(f"mean_{c}")) ** 2
        rows = rows.withColumn(f"mean_{c}", mean).withColumn(f"sd_{c}", F.sqrt(spread / n))
        total = total + ((F.col(c) - F.col(f"p_{c}")) / F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0)) ** 2
    scored = rows.withColumn("dist", F.sqrt(total / 6))
    rank = F.row_number().over(w.orderBy("dist", "key"))
    return scored.select("region", "key", rounded(F.lit(1.0) / (F.lit(1.0) + F.col("dist")), 3).alias("similarity"), rank.alias("rank"))


def calendar_heatmap(series: DataFrame) -> DataFrame:
    """Years by months with each region's largest count, for colour."""
    top = series.groupBy("region").agg(F.max("count").alias("max_count"))
    wide = series.select("region", year_of("ym").alias("year"), month_of("ym").alias("month"), "count").groupBy("region", "year").pivot("month", list(range(1, 13))).agg(F.first("count"))
    wide = wide.select("region", "year", *(F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)))
    return wide.join(F.broadcast(top), "region")


def _harmonics(i: np.ndarray, month0: np.ndarray) -> np.ndarray:
    a = 2 * math.pi * month0 / 12
    return np.stack([np.ones(len(i)), i, np.sin(a), np.cos(a), np.sin(2 * a), np.cos(2 * a)], 1)


def harmonic_forecast(series: DataFrame, horizon: int = 12, train: int = 216) -> DataFrame:
    """Log-linear trend and two harmonics fitted to a region's last months (none under 36), the next months with a 95 % band, sigma and R2."""

    def one(months: pd.DataFrame) -> pd.DataFrame:
        rows = months.sort_values("ym").tail(train)
        names = ["region", "ym", "mean", "lo", "hi", "sigma", "r2"]
        if len(months) < 36:
            return pd.DataFrame(columns=names)
        month0 = rows["ym"].str[5:7].astype(int).to_numpy() - 1
        x, y = _harmonics(np.arange(len(rows)), month0), np.log1p(rows["count"].to_numpy(float))
        beta = np.linalg.lstsq(x, y, rcond=None)[0]  # no ridge: it moves forecasts of millions by whole detections
        rest = y - x @ beta
        sigma, total = math.sqrt((rest**2).mean()), ((y - y.mean()) ** 2).sum()
        r2 = math.floor(max(0.0, 1 - (rest**2).sum() / total) * 1000 + 0.5) / 1000 if total > 0 else 0.0
        ahead = pd.period_range(pd.Period(rows["ym"].iloc[-1], "M") + 1, periods=horizon, freq="M")
        z = _harmonics(len(rows) - 1 + np.arange(1, horizon + 1), ahead.month.to_numpy() - 1) @ beta
        whole = lambda v: np.floor(v + 0.5).astype(np.int64)
        return pd.DataFrame({"region": months["region"].iloc[0], "ym": ahead.strftime("%Y-%m"), "mean": whole(np.maximum(0, np.expm1(z))), "lo": whole(np.maximum(0, np.expm1(z - 1.96 * sigma))), "hi": whole(np.expm1(z + 1.96 * sigma)), "sigma": math.floor(sigma * 1000 + 0.5) / 1000, "r2": r2})[names]

    return series.groupBy("region").applyInPandas(one, "region string, ym string, mean long, lo long, hi long, sigma double, r2 double")
