"""Queries over detections, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burncal.functions import scalars as s
from burncal.operators import summary
from burncal.sources.fixtures import BBOX, detections, oracle, weather
from burncal.sources.readers import clamp_to_latest, date_islands, source_precedence
from burncal.sources.readers import source_flags as source_flags_of
from burncal.sources.readers import valid_requests as valid_requests_of

BOX = "lon between -74 and -46 and lat between -12 and 2"
#: SQL of the harmonized confidence.
CONF = "case lower(trim(conf_raw)) when 'l' then 30 when 'n' then 60 when 'h' then 90 else cast(floor(try_cast(lower(trim(conf_raw)) as double)+0.5e0) as int) end"
DET_CONF = f"select *, {CONF} as conf from det"


def r(x: str, digits: int) -> str:
    """SQL of the half-up rounding."""
    return f"floor(({x})*1e{digits}+0.5e0)/1e{digits}" if digits else f"cast(floor(({x})+0.5e0) as bigint)"


def total(x: str) -> str:
    """SQL of an exact sum."""
    return f"cast(sum(cast({x} as decimal(28,10))) as double)"


SCORE = r("least(60e0, log10(1e0+greatest(frp,0e0))/log10(501e0)*60) + least(greatest(coalesce(conf,60),0),100)/100e0*25 + case when night then 15 else 8 end", 0)
LABEL = "case when score>=80 then 'EXTREME' when score>=62 then 'HIGH' when score>=42 then 'MODERATE' else 'LOW' end"


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir)


def sensor_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.sensor_day_summary(detections(spark, sf_dir), BBOX)


def threat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.with_confidence(detections(spark, sf_dir))
    scored = rows.select("pt_seq", s.threat_score("frp", F.coalesce("conf", F.lit(60)), "night").alias("score"))
    return scored.withColumn("threat", s.threat_label("score"))


def frp_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy(s.frp_band("frp").alias("band")).agg(F.count("*").alias("n"), s.exact_sum("frp").alias("frp"))


def confidence_harmonized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select(
        "pt_seq", s.confidence("conf_raw").alias("conf"), s.confidence_training("conf_raw").alias("conf_training"), s.counts_as_high("conf_raw").alias("high_in_calendar")
    )


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each detection to the next one of its day."""
    w = Window.partitionBy("day").orderBy("pt_seq")
    km = s.haversine_km(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    return detections(spark, sf_dir).select("pt_seq", s.rounded(km, 3).alias("km"))


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir).select("pt_seq", s.rule_verdict("frp", "night").alias("rule"), s.threat_label(F.lit(62)).alias("other"))
    return rows.select("pt_seq", "rule", s.highest_verdict("other", "rule").alias("final"))


def labels_and_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions on the acquisition time and the sensor."""
    hhmm = F.concat(F.col("acq_hour").cast("string"), F.lit("05"))
    return detections(spark, sf_dir).select(
        "pt_seq", s.time_label(hhmm).alias("label"), s.hour_bucket(F.lpad(hhmm, 4, "0")).alias("hour"), s.sensor_of(F.lit("Aqua"), F.col("sensor")).alias("sensor_split"),
        s.tile_x("lon", 7).alias("tile_x"), s.tile_y("lat", 7).alias("tile_y"),
    )


def weather_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rain = F.sum("precip").over(Window.orderBy("day").rowsBetween(-2, 0))  # a forecast of a few days
    scored = weather(spark, sf_dir).select("day", rain.alias("rain3"), s.weather_score("tmax", "rh", "wind", rain).alias("score"))
    return scored.withColumn("verdict", s.weather_label("score"))


def frp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.frp_histogram(detections(spark, sf_dir))


def diurnal_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.diurnal_signature(detections(spark, sf_dir))


def hexbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.hexbin(detections(spark, sf_dir), BBOX)


def quarter_degree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.quarter_degree_top(detections(spark, sf_dir))


def cell_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.cell_field(detections(spark, sf_dir), BBOX)


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.concentration(summary.cell_field(detections(spark, sf_dir), BBOX))


def daily_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.daily_dynamics(detections(spark, sf_dir))


def modis_viirs_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.modis_viirs_by_day(detections(spark, sf_dir))


def window_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.window_verdict(detections(spark, sf_dir))


def alert_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.alert_level(detections(spark, sf_dir))


def threat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.threat_rollup(detections(spark, sf_dir))


def live_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.live_totals(detections(spark, sf_dir))


def grid_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.grid_histogram(detections(spark, sf_dir), BBOX, 0.05)


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days of a busy sensor, at most ten days each."""
    busy = detections(spark, sf_dir).groupBy("day", "sensor").count().filter("count % 3 <> 0").select("sensor", "day")
    return date_islands(busy, "sensor")


def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MODIS rows where a day and sensor slot has them, else the fallback's."""
    rows = detections(spark, sf_dir)
    slot = rows.select("day", (F.col("pt_seq") % 40).alias("slot"), "pt_seq", "frp", F.when(F.col("sensor").startswith("MODIS"), "primary").otherwise("fallback").alias("source"))
    return source_precedence(slot, ["day", "slot"], ["primary", "fallback"]).groupBy("day", "source").agg(F.count("*").alias("n"), s.exact_sum("frp").alias("frp"))


def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether MODIS alone, both or VIIRS alone serve the slots of a day and hour."""
    rows = detections(spark, sf_dir)
    slot = rows.select("day", "acq_hour", (F.col("pt_seq") % 7).alias("slot"), F.when(F.col("sensor").startswith("MODIS"), "primary").otherwise("fallback").alias("source"))
    return source_flags_of(source_precedence(slot, ["day", "acq_hour", "slot"], ["primary", "fallback"]), ["day", "acq_hour"], "primary")


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all widths and heights, none and less than none too, with days that are none."""
    k = F.col("pt_seq")
    day = F.when(k % 7 == 0, "today").when(k % 11 == 0, None).otherwise(F.col("day").cast("string"))
    asked = detections(spark, sf_dir).select("pt_seq", F.col("lon").alias("w"), F.col("lat").alias("s"), (F.col("lon") + (k % 5 - 1)).alias("e"), (F.col("lat") + (k % 4 - 1)).alias("n"), day.alias("day"), F.when(k % 13 != 0, (k % 15).cast("int")).alias("days"))
    return valid_requests_of(asked).select("pt_seq", "day", "days")


def clamped_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for days up to three past the last one of each sensor."""
    rows = detections(spark, sf_dir)
    asked = rows.select("sensor", F.date_add("day", 3).alias("day")).distinct()
    return clamp_to_latest(asked, rows.select("sensor", "day").distinct())


QUERIES = {
    "detections_view": view, "sensor_day_summary": sensor_day_summary, "threat_scores": threat_scores, "frp_bands": frp_bands, "confidence_harmonized": confidence_harmonized,
    "haversine_pairs": haversine_pairs, "rule_verdicts": rule_verdicts, "labels_and_hours": labels_and_hours, "weather_scores": weather_scores, "frp_histogram": frp_histogram,
    "diurnal_signature": diurnal_signature, "hexbin": hexbin, "quarter_degree_top": quarter_degree_top, "cell_field": cell_field, "concentration": concentration,
    "daily_dynamics": daily_dynamics, "modis_viirs_by_day": modis_viirs_by_day, "window_verdict": window_verdict, "alert_level": alert_level, "threat_rollup": threat_rollup,
    "live_totals": live_totals, "grid_histogram": grid_histogram, "date_islands": islands, "source_precedence": precedence, "clamped_days": clamped_days,
    "source_flags": source_flags, "valid_requests": valid_requests,
}

_BANDS = "case when frp<10 then 'SMOULDERING' when frp<100 then 'SURFACE FIRE' when frp<250 then 'INTENSE FRONT' else 'CONFLAGRATION' end"
_HAV = "2*6371e0*asin(least(1e0, sqrt(sin((radians(lat2)-radians(lat))/2)*sin((radians(lat2)-radians(lat))/2) + cos(radians(lat))*cos(radians(lat2))*sin((radians(lon2)-radians(lon))/2)*sin((radians(lon2)-radians(lon))/2))))"
_RULE = "case when night and frp>=25 and frp<120 then 'HIGH' when frp>=250 then 'EXTREME' when frp>=120 then 'HIGH' when frp>=25 then 'MODERATE' else 'LOW' end"
_POWER = "case when coalesce(frp,0)=0 then 0.5e0 else frp end"
_BIN = f"case when {_POWER}>=500 then 7 when {_POWER}>=250 then 6 when {_POWER}>=120 then 5 when {_POWER}>=60 then 4 when {_POWER}>=25 then 3 when {_POWER}>=10 then 2 when {_POWER}>=5 then 1 else 0 end"
_CELL = repr(14.0 / 26)
_FIELD = f"""select cast(least(51, greatest(0, floor((lon-(-74e0))/{_CELL}))) as int) as gx, cast(least(25, greatest(0, floor((lat-(-12e0))/{_CELL}))) as int) as gy, count(*) as n,
 {total('frp')} as frp_sum, cast(sum(coalesce(conf,60)) as double)/count(*) as mean_conf, count(case when night then 1 end)*100e0/count(*) as night_pct, max(frp) as max_frp from dc group by 1,2 order by n desc, gx, gy limit 900"""
_PER = ", ".join(f"count(case when sensor='{x}' then 1 end) as n_{x.lower().replace('-', '_')}" for x in s.SENSORS)
_DAYS = f"select day, {_PER}, count(*) as total, {total('frp')} as frp, count(case when night then 1 end) as night, count(case when conf>=80 then 1 end) as hi_conf from dc group by day"

ORACLES = {
    "detections_view": oracle("select * from det", "det"),
    "sensor_day_summary": oracle(
        f"select day, sensor, count(*) as n, {r(total('frp') + '/count(*)', 1)} as mean_frp, {r('max(frp)', 1)} as max_frp, count(case when conf>=80 then 1 end) as hi_conf, {r('count(case when night then 1 end)*100e0/count(*)', 1)} as night_pct from dc where {BOX} group by day, sensor",
        "det", dc=DET_CONF,
    ),
    "threat_scores": oracle(f"select pt_seq, score, {LABEL} as threat from sc", "det", dc=DET_CONF, sc=f"select pt_seq, {SCORE} as score from dc"),
    "frp_bands": oracle(f"select {_BANDS} as band, count(*) as n, {total('frp')} as frp from det group by 1", "det"),
    "confidence_harmonized": oracle(
        f"select pt_seq, conf, coalesce(case lower(trim(conf_raw)) when 'l' then 20 when 'n' then 50 when 'h' then 90 else conf end, 50) as conf_training, coalesce(case when try_cast(conf_raw as double) is not null then try_cast(conf_raw as double)>=80 else trim(conf_raw)<>'' end, false) as high_in_calendar from dc",
        "det", dc=DET_CONF,
    ),
    "haversine_pairs": oracle(f"select pt_seq, {r(_HAV, 3)} as km from nx", "det", nx="select pt_seq, lat, lon, lead(lat) over (partition by day order by pt_seq) as lat2, lead(lon) over (partition by day order by pt_seq) as lon2 from det"),
    "rule_verdicts": oracle(f"select pt_seq, {_RULE} as rule, case when {_RULE}='EXTREME' then 'EXTREME' else 'HIGH' end as final from det", "det"),
    "labels_and_hours": oracle(
        "select pt_seq, lpad(cast(acq_hour as varchar),2,'0')||':05 UTC' as label, acq_hour as hour, case when sensor like 'MODIS%' then 'MODIS-Aqua' else sensor end as sensor_split, cast(floor((lon+180)/360*128) as int) as tile_x, cast(floor((1e0-asinh(tan(radians(lat)))/3.141592653589793e0)/2*128) as int) as tile_y from det",
        "det",
    ),
    "weather_scores": oracle(
        "select day, rain3, score, case when score>=78 then 'EXTREME' when score>=62 then 'HIGH' when score>=45 then 'ELEVATED' when score>=28 then 'MODERATE' else 'LOW' end as verdict from sc", "wx",
        sc=f"select day, rain3, {r('100e0*(0.34e0*least(1e0,greatest(0e0,(tmax-10)/32))+0.24e0*least(1e0,greatest(0e0,(88e0-rh)/70))+0.16e0*least(1e0,greatest(0e0,(wind-8)/45))+0.26e0*least(1e0,greatest(0e0,1e0-rain3/12)))', 0)} as score from (select *, sum(precip) over (order by day rows between 2 preceding and current row) as rain3 from wx) w3",
    ),
    "frp_histogram": oracle(
        "select b.bin, b.label, coalesce(h.n,0) as n from b left join h using (bin)", "det", h=f"select {_BIN} as bin, count(*) as n from det group by 1",
        b="select * from (values " + ", ".join(f"({i},'{x}')" for i, (_, x) in enumerate(summary.FRP_BINS)) + ") v(bin,label)",
    ),
    "diurnal_signature": oracle("select cast(g.h as int) as hour, count(det.pt_seq) as n, count(case when night then 1 end) as night from range(24) g(h) left join det on acq_hour=g.h group by 1", "det"),
    "hexbin": oracle("select gx, gy, n, frp, (gx+0.5e0)*1.17e0 as lon, (gy+0.5e0)*1.17e0 as lat, max(n) over () as max_n from c", "det", c=f"select cast(floor(lon/1.17e0) as bigint) as gx, cast(floor(lat/1.17e0) as bigint) as gy, count(*) as n, {total('frp')} as frp from det group by 1,2"),
    "quarter_degree_top": oracle(f"select * from (select floor(lat*4+0.5e0)/4 as lat, floor(lon*4+0.5e0)/4 as lon, count(*) as n, {total('frp')} as frp from det group by 1,2 order by n desc, lat, lon limit 3) q where n>=3", "det"),
    "cell_field": oracle("select * from f", "det", dc=DET_CONF, f=_FIELD),
    "concentration": oracle(
        "select count(*) as cells, max(top_k) as top_k, cast(sum(case when rk<=top_k then cast(frp_sum as decimal(18,2)) else 0 end) as double)*100/cast(sum(cast(frp_sum as decimal(18,2))) as double) as share_pct from (select frp_sum, row_number() over (order by frp_sum desc, gx, gy) as rk, cast(greatest(1, floor(count(*) over ()*0.1e0+0.5e0)) as bigint) as top_k from f) x having count(*)>=4",
        "det", dc=DET_CONF, f=_FIELD,
    ),
    "daily_dynamics": oracle("select * from dd", "det", dc=DET_CONF, dd=_DAYS),
    "modis_viirs_by_day": oracle("select day, count(case when sensor like 'MODIS%' then 1 end) as m, count(case when sensor like 'VIIRS%' then 1 end) as v from det group by day", "det"),
    "window_verdict": oracle(
        """select first_total, last_total, busiest_day, frp_day, last_ratio, hi_share, change_pct, case when change_pct>15 then 'ESCALATING' when change_pct<-15 then 'DECLINING' else 'STEADY' end as trend
 from (select *, case when first_total>0 then (last_total-first_total)*100e0/first_total else 0e0 end as change_pct from (select
 (select total from dd order by day limit 1) as first_total, (select total from dd order by day desc limit 1) as last_total, (select day from dd order by total desc, day limit 1) as busiest_day,
 (select day from dd order by frp desc, day limit 1) as frp_day, (select cast(n_viirs_snpp+n_viirs_noaa20+n_viirs_noaa21 as double)/(n_modis_terra+n_modis_aqua) from dd order by day desc limit 1) as last_ratio,
 (select cast(sum(hi_conf) as double)/sum(total) from dd) as hi_share) a) b""",
        "det", dc=DET_CONF, dd=_DAYS,
    ),
    "source_flags": oracle(
        "select day, acq_hour, case when bool_and(p) then 'primary' when bool_or(p) then 'mixed' else 'fallback' end as flag from (select day, acq_hour, pt_seq%7 as slot, bool_or(sensor like 'MODIS%') as p from det group by 1,2,3) x group by 1,2", "det"
    ),
    "valid_requests": oracle(
        "select pt_seq, cast(day as varchar) as day, cast(case when pt_seq%13<>0 then least(10, greatest(1, pt_seq%15)) else 1 end as int) as days from det where pt_seq%5-1>0 and pt_seq%4-1>0 and pt_seq%7<>0 and pt_seq%11<>0", "det"
    ),
    "alert_level": oracle(f"select *, case when total>=150 or frp>=2500 then 'RED' when total>=60 or frp>=1200 then 'ORANGE' when total>=20 then 'AMBER' else 'GREEN' end as level from (select day, count(*) as total, {total('frp')} as frp from det group by day) d", "det"),
    "threat_rollup": oracle(f"select day, count(case when score>=80 then 1 end) as extreme, count(case when score between 62 and 79 then 1 end) as high from (select day, {SCORE} as score from dc) x group by day", "det", dc=DET_CONF),
    "live_totals": oracle(f"select count(*) as n, {total('frp')}/count(*) as mean_frp, count(case when conf>=80 then 1 end)*100e0/count(*) as hi_pct, count(case when night then 1 end)*100e0/count(*) as night_pct, max(frp) as max_frp from dc", "det", dc=DET_CONF),
    "grid_histogram": oracle(f"select day, i, j, count(*) as n, {total('frp')} as frp from (select day, frp, cast(floor((lon-(-74e0))/0.05e0) as int) as i, cast(floor((lat-(-12e0))/0.05e0) as int) as j from det) x where i>=0 and i<561 and j>=0 and j<281 group by day,i,j", "det"),
    "date_islands": oracle(
        "select sensor, min(day) as first_day, max(day) as last_day, count(*) as days from (select sensor, day, island, (row_number() over (partition by sensor, island order by day)-1)//10 as chunk from (select sensor, day, day - cast(row_number() over (partition by sensor order by day) as int) as island from busy) a) b group by sensor, island, chunk",
        "det", busy="select sensor, day from det group by day, sensor having count(*)%3<>0",
    ),
    "source_precedence": oracle(
        f"select day, source, count(*) as n, {total('frp')} as frp from (select *, min(pr) over (partition by day, slot) as best from sl) x where pr=best group by day, source", "det",
        sl="select day, pt_seq%40 as slot, frp, case when sensor like 'MODIS%' then 'primary' else 'fallback' end as source, case when sensor like 'MODIS%' then 0 else 1 end as pr from det",
    ),
    "clamped_days": oracle("select a.sensor, a.day, least(a.day, l.latest) as day_used, a.day>l.latest as clamped from a join (select sensor, max(day) as latest from det group by sensor) l using (sensor)", "det", a="select distinct sensor, day+3 as day from det"),
}
