"""Queries of single rules: units and labels, windows of days, areas, samples. Inputs that no table has (pixels, stored temperatures) are made from the rows'
numbers, so that every branch of a rule is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burncal.functions import scalars as s
from burncal.functions.constants import REGIONS
from burncal.operators import selections, summary
from burncal.plans.detections import r
from burncal.sources.fixtures import detections, oracle
from burncal.sources.readers import is_archive, window_days as days_of


def terrain_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights from made pixels, and between four of them; stored temperatures, of which some are none; numbers and months as labels."""
    rows, k = detections(spark, sf_dir), F.col("pt_seq")
    part = lambda c: F.col(c) - F.floor(c)
    stored = (k % 5) * 3001
    size = F.col("frp") * F.element_at(F.array(F.lit(1.0), F.lit(100.0), F.lit(100000.0)), (k % 3 + 1).cast("int"))
    nine = lambda c: s.rounded(c, 6)
    return rows.select(
        "pt_seq", s.elevation(k % 200, (k * 7) % 256, (k * 13) % 256).alias("height"), nine(s.bilinear(k % 11, k % 7, k % 5, k % 3, part("lon"), part("lat"))).alias("between"),
        nine(s.surface_temperature(stored)).alias("kelvin"), nine(s.emissivity(stored)).alias("emissivity"), s.short_number(size).alias("number"), s.month_label(F.date_format("day", "yyyy-MM")).alias("month"),
        nine(s.cos_lat(F.col("lat") * 7)).alias("cos_lat"), nine(selections.flat_distance("lon", "lat", F.lit(-60.0), F.lit(-5.0))).alias("away"),
    )


def windows_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day windows of -1 to 12 days, and whether they begin in the archive, of which here all days before the last ten are."""
    days = detections(spark, sf_dir).select("day").distinct()
    last = days.agg(F.max("day").alias("last"))  # one row
    asked = days.crossJoin(F.broadcast(last)).select("day", "last", F.explode(F.sequence(F.lit(-1), F.lit(12))).alias("asked"))
    window = days_of(F.col("day"), F.col("asked"))
    return asked.select("day", "asked", F.element_at(window, 1).alias("first_day"), F.size(window).alias("days"), is_archive(F.element_at(window, 1), F.col("last"), 10).alias("archive"))


def drawn_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes drawn from each detection to the next one of its day."""
    w = Window.partitionBy("day").orderBy("pt_seq")
    pairs = detections(spark, sf_dir).select("pt_seq", "lon", "lat", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    return pairs.filter("lon2 is not null").select("pt_seq", selections.drawn_area("lon", "lat", "lon2", "lat2").alias("box")).select("pt_seq", "box.*")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of the days' sensors as places: their own boxes if these are not too wide."""
    rows = detections(spark, sf_dir).groupBy("day", "sensor").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), (s.exact_sum("lon") / F.count("*")).alias("lon"), (s.exact_sum("lat") / F.count("*")).alias("lat"))
    found = selections.area_of_place(rows)
    return found.select("day", "sensor", *(s.rounded(F.element_at("bbox", k), 6).alias(n) for k, n in enumerate(("west", "south", "east", "north"), 1)))


def region_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's search radius, and how many detections it has."""
    areas = spark.createDataFrame([(n, *map(float, box), s.adaptive_eps(box)) for n, box in REGIONS.items()], "region string, west double, south double, east double, north double, eps double")
    inside = F.count_if((F.col("lon") >= F.col("west")) & (F.col("lon") <= F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north")))
    return detections(spark, sf_dir).crossJoin(F.broadcast(areas)).groupBy("region", "eps").agg(inside.alias("n"))  # nine rows


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows, the same for the same seed: sampling is what is asked for."""
    return selections.seeded_sample(detections(spark, sf_dir), 100).select("pt_seq", "day", "frp")


def visible_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of two sensors under each other, as the map shows them: confident ones of the first, all of the second, those that are switched on."""
    rows = summary.with_confidence(detections(spark, sf_dir))
    first, second = selections.visible(rows, ["MODIS-Terra", "VIIRS-SNPP"]), selections.visible(rows, ["VIIRS-NOAA20"])
    return first.filter(F.col("conf") >= 60).unionByName(second).select("pt_seq", "sensor", "conf")


def clear_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy tiles of which a made-up share is in sight: those with under a twentieth don't count."""
    rows = detections(spark, sf_dir)
    seen = rows.select("day", s.tile_x("lon", 6).alias("x"), s.tile_y("lat", 6).alias("y")).distinct().withColumn("visibility", (F.col("x") * 3 + F.col("y")) % 4 / 40.0)
    return selections.busy_tiles(rows, 6, 2, 5, seen=seen)


QUERIES = {
    "terrain_and_units": terrain_and_units, "windows_of_days": windows_of_days, "drawn_areas": drawn_areas, "places": places, "region_scales": region_scales, "seeded_sample": seeded_sample,
    "visible_union": visible_union, "clear_tiles": clear_tiles,
}

_SIZE = "frp*[1e0,100e0,100000e0][cast(pt_seq%3+1 as int)]"
_TOP, _LOW = ("(cast(pt_seq%11 as double)*(1e0-fx)+cast(pt_seq%7 as double)*fx)", "(cast(pt_seq%5 as double)*(1e0-fx)+cast(pt_seq%3 as double)*fx)")
_TILE_Y = "cast(floor((1e0-asinh(tan(radians(lat)))/3.141592653589793e0)/2*64) as int)"

ORACLES = {
    "terrain_and_units": oracle(
        f"""select pt_seq, greatest(0e0, (pt_seq%200)*256+(pt_seq*7)%256+cast((pt_seq*13)%256 as double)/256-32768) as height, {r(f'{_TOP}*(1e0-fy)+{_LOW}*fy', 6)} as between,
 case when pt_seq%5<>0 then {r('(pt_seq%5)*3001*0.02e0', 6)} end as kelvin, case when pt_seq%5<>0 then {r('(pt_seq%5)*3001*0.02e0+0.49e0', 6)} end as emissivity,
 case when z>=1e6 then printf('%.1fM', floor(z/1e6*10+0.5e0)/10) when z>=1e3 then printf('%.1fk', floor(z/1e3*10+0.5e0)/10) else printf('%d', {r('z', 0)}) end as number, strftime(day, '%b %Y') as month,
 {r('greatest(0.2e0, cos(radians(lat*7)))', 6)} as cos_lat, {r('sqrt((lon+60e0)*(lon+60e0)+(lat+5e0)*(lat+5e0))', 6)} as away from (select *, lon-floor(lon) as fx, lat-floor(lat) as fy, {_SIZE} as z from det) x""",
        "det",
    ),
    "windows_of_days": oracle(
        "select day, cast(asked as int) as asked, day-(n-1) as first_day, n as days, day-(n-1) < latest-10 as archive from (select *, cast(least(10, greatest(1, asked)) as int) as n from (select day, max(day) over () as latest, unnest(range(-1, 13)) as asked from (select distinct day from det) d) x) y", "det"
    ),
    "drawn_areas": oracle(
        f"""select pt_seq, case when ok then {r('w', 2)} end as west, case when ok then {r('s', 2)} end as south, case when ok then {r('e', 2)} end as east, case when ok then {r('n', 2)} end as north from
 (select *, e-w>0.5e0 and n-s>0.5e0 as ok from (select pt_seq, least(lon, lon2) as w, greatest(lon, lon2) as e, least(lat, lat2) as s, greatest(lat, lat2) as n from
 (select *, lead(lon) over v as lon2, lead(lat) over v as lat2 from det window v as (partition by day order by pt_seq)) a where lon2 is not null) b) c""",
        "det",
    ),
    "places": oracle(
        "select day, sensor, " + ", ".join(f"{r(f'case when own then {a} else {b} end', 6)} as {a}" for a, b in (("west", "lon-2.25e0"), ("south", "lat-2"), ("east", "lon+2.25e0"), ("north", "lat+2"))) + " from (select *, east-west<25 and north-south<25 as own from (select day, sensor, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east, cast(sum(cast(lon as decimal(28,10))) as double)/count(*) as lon, cast(sum(cast(lat as decimal(28,10))) as double)/count(*) as lat from det group by 1,2) x) y", "det"
    ),
    "region_scales": oracle(
        "select region, least(0.9e0, greatest(0.14e0, cast(printf('%.2f', greatest(e-w, n-s, 1e0)/45) as double))) as eps, count(case when lon between w and e and lat between s and n then 1 end) as n from det, (values " + ", ".join(f"('{k}', {w}e0, {s_}e0, {e}e0, {n}e0)" for k, (w, s_, e, n) in REGIONS.items()) + ") a(region, w, s, e, n) group by 1,2", "det"
    ),
    "seeded_sample": oracle("select pt_seq, day, frp from det order by sha256('42:'||pt_seq), pt_seq limit 100", "det"),
    "visible_union": oracle("select pt_seq, sensor, conf from dc where (sensor in ('MODIS-Terra','VIIRS-SNPP') and conf>=60) or sensor='VIIRS-NOAA20'", "det", dc="select *, " + "case lower(trim(conf_raw)) when 'l' then 30 when 'n' then 60 when 'h' then 90 else cast(floor(try_cast(lower(trim(conf_raw)) as double)+0.5e0) as int) end as conf from det"),
    "clear_tiles": oracle(
        f"select day, x, y, n, cast(rk as int) as rank from (select *, row_number() over (partition by day order by n desc, x, y) as rk from (select day, cast(floor((lon+180)/360*64) as int) as x, {_TILE_Y} as y, count(*) as n from det where not night group by 1,2,3 having count(*)>=2) t where (x*3+y)%4/40e0>=0.05e0) u where rk<=5", "det"
    ),
}
