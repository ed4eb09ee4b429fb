"""Filters, picks and texts for display and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burncal.functions.scalars import clamped, col, confidence, exact_sum, month_of, rounded, threat_label, threat_score, year_of

HOT = 150.0


def visible(detections: DataFrame, sensors: list[str]) -> DataFrame:
    return detections.filter(F.col("sensor").isin(sensors))


def hot_core(detections: DataFrame, least: float = HOT) -> DataFrame:
    """Detections with much power."""
    return detections.filter(F.col("frp") >= least)


def display_points(detections: DataFrame, k: int | None = None) -> DataFrame:
    """Power held between 0.5 and 600, unknown confidence 60; with k the k strongest."""
    rows = detections.select("pt_seq", "lon", "lat", clamped("frp", 0.5, 600.0).alias("frp"), F.coalesce(confidence("conf_raw"), F.lit(60)).alias("conf"))
    return rows.orderBy(F.desc("frp"), "pt_seq").limit(k) if k else rows


def extreme_points(detections: DataFrame, k: int = 24) -> DataFrame:
    """The k strongest detections."""
    return detections.select("pt_seq", "day", "sensor", "frp").orderBy(F.desc("frp"), "pt_seq").limit(k)


def seeded_sample(rows: DataFrame, n: int, seed: int = 42, key: str = "pt_seq") -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def split_by_last_day(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All days but the last, and the last."""
    last = rows.agg(F.max("day").alias("last"))  # one row
    marked = rows.crossJoin(F.broadcast(last))
    return marked.filter("day < last").drop("last"), marked.filter("day = last").drop("last")


def busy_tiles(detections: DataFrame, zoom: int = 7, least: int = 25, k: int = 5, day_only: bool = True, seen: DataFrame | None = None, clear: float = 0.05) -> DataFrame:
    """Per day the k tiles with the most daytime detections, of those with enough; with `seen` (day, x, y, visibility) only of those that are clear enough."""
    from burncal.functions.scalars import tile_x, tile_y

    rows = detections.filter(~F.col("night")) if day_only else detections
    tiles = rows.groupBy("day", tile_x("lon", zoom).alias("x"), tile_y("lat", zoom).alias("y")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if seen is not None:
        tiles = tiles.join(seen.filter(F.col("visibility") >= clear).select("day", "x", "y"), ["day", "x", "y"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "x", "y"))
    return tiles.withColumn("rank", rank).filter(F.col("rank") <= k)


def area_of_corners(lon1: float, lat1: float, lon2: float, lat2: float, least: float = 0.5) -> tuple[float, float, float, float] | None:
    """West, south, east, north of a drawn box, to two decimals; None if a side is too short."""
    w, e, s, n = min(lon1, lon2), max(lon1, lon2), min(lat1, lat2), max(lat1, lat2)
    return (round(w, 2), round(s, 2), round(e, 2), round(n, 2)) if e - w > least and n - s > least else None


def drawn_area(lon1, lat1, lon2, lat2, least: float = 0.5) -> Column:
    """`area_of_corners` for columns: west, south, east, north, or null."""
    lons, lats = (F.least(lon1, lon2), F.greatest(lon1, lon2)), (F.least(lat1, lat2), F.greatest(lat1, lat2))
    box = F.struct(rounded(lons[0], 2).alias("west"), rounded(lats[0], 2).alias("south"), rounded(lons[1], 2).alias("east"), rounded(lats[1], 2).alias("north"))
    return F.when((lons[1] - lons[0] > least) & (lats[1] - lats[0] > least), box)


def area_of_place(places: DataFrame, widest: float = 25.0) -> DataFrame:
    """The place's own box (south, north, west, east as geocoders give it) if it is not too wide, else a box around its centre."""
    own = (F.col("east") - F.col("west") < widest) & (F.col("north") - F.col("south") < widest)
    box = F.when(own, F.array("west", "south", "east", "north")).otherwise(F.array(F.col("lon") - 2.25, F.col("lat") - 2, F.col("lon") + 2.25, F.col("lat") + 2))
    return places.withColumn("bbox", box)


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in an open ring of [lon, lat] pairs: an edge counts if it crosses the point's latitude to the east of it."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, following, lambda a, b: (((a[1] > lat) != (b[1] > lat)) & (lon < (b[0] - a[0]) * (lat - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0])).cast("int"))
    return F.aggregate(crosses, F.lit(0), lambda n, c: n + F.coalesce(c, F.lit(0))) % 2 == 1


def cells_in_hulls(hulls: DataFrame, box, cell: float) -> DataFrame:
    """day, i, j of the raster cells whose centre lies in a hull: only the cells of each hull's bounding box are tried."""
    west, south, _, _ = box
    lons, lats = F.transform("hull", lambda p: p[0]), F.transform("hull", lambda p: p[1])
    span = lambda values, start: F.sequence(F.floor((F.array_min(values) - start) / cell).cast("int"), F.floor((F.array_max(values) - start) / cell).cast("int"))
    tried = hulls.filter(F.size("hull") >= 3).select("day", "hull", F.explode(span(lons, west)).alias("i"), span(lats, south).alias("js")).select("day", "hull", "i", F.explode("js").alias("j"))
    centre = tried.withColumn("x", F.lit(west) + (F.col("i") + 0.5) * cell).withColumn("y", F.lit(south) + (F.col("j") + 0.5) * cell)
    return centre.filter(inside_ring(F.col("x"), F.col("y"), F.col("hull"))).select("day", "i", "j").distinct()


def percent_of_typical(series: DataFrame) -> DataFrame:
    """Last month of each region in percent of its upper median."""
    upper = F.element_at(F.sort_array(F.collect_list("count")), (F.floor(F.count("*") / 2) + 1).cast("int"))  # a region's months
    one = series.groupBy("region").agg(F.max_by("count", "ym").alias("last"), upper.alias("typical"))
    return one.select("region", "last", "typical", rounded(F.col("last") * 100.0 / F.greatest(F.col("typical"), F.lit(1)), 1).alias("pct"))


def months_to_peak(outlook: DataFrame, now: str) -> DataFrame:
    """Months from now to the outlook's highest month, the first of equals."""
    peak = outlook.groupBy("region").agg(F.min_by("ym", F.struct(-F.col("mean"), F.col("ym"))).alias("peak"))
    months = (year_of("peak") - int(now[:4])) * 12 + month_of("peak") - int(now[5:7])
    return peak.select("region", "peak", months.alias("months"))


def _half(night) -> Column:
    return F.when(col(night), "night").otherwise("day")


def detection_questions(detections: DataFrame, region: str) -> DataFrame:
    """A question for an analyst about each detection, with its confidence (60 if unknown)."""
    conf = F.coalesce(confidence("conf_raw"), F.lit(60))
    text = F.format_string(
        "Fire detection at %.2f, %.2f in %s on %s, %s overpass: sensor %s, %.1f MW, confidence %d. What does it mean and what should be watched?",
        rounded("lat", 2), rounded("lon", 2), F.lit(region), F.col("day").cast("string"), _half("night"), "sensor", rounded("frp", 1), conf,
    )
    return detections.select("pt_seq", text.alias("question"))


def cluster_questions(clusters: DataFrame, region: str) -> DataFrame:
    """A question about each cluster, from rows of cluster_stats with area_km2 and elongation."""
    text = F.format_string(
        "Fire cluster %s (%s) in %s on %s: %d detections, %d MW in total, spread %.1f km, hull of %d km2, front ratio %.2f. Brief a commander on it and on the next 48 hours.",
        "cluster_id", "class", F.lit(region), F.col("day").cast("string"), "n", rounded("frp_sum"), "spread_km", rounded("area_km2"), "elongation",
    )
    return clusters.select("day", "cluster_id", text.alias("question"))


def cell_questions(cells: DataFrame, region: str) -> DataFrame:
    """A question about each cell of a day: day, lat, lon, n, frp_sum, max_frp, mean_conf, night_pct."""
    text = F.format_string(
        "Fire cell around %.2f, %.2f in %s on %s: %d detections, %d MW in total, strongest %d MW, mean confidence %d, %d%% at night. Assess it and say what to watch next.",
        "lat", "lon", F.lit(region), F.col("day").cast("string"), "n", rounded("frp_sum"), rounded("max_frp"), rounded("mean_conf"), rounded("night_pct"),
    )
    return cells.select("day", "lat", "lon", text.alias("question"))


def day_cells(detections: DataFrame, size: float = 1.0) -> DataFrame:
    """Square cells of a day with what a question or a badge about them needs; places are centres."""
    conf = F.coalesce(confidence("conf_raw"), F.lit(60))
    at = lambda c: (F.floor(F.col(c) / size) + F.lit(0.5)) * size
    return detections.groupBy("day", at("lat").alias("lat"), at("lon").alias("lon")).agg(
        F.count("*").alias("n"), exact_sum("frp").alias("frp_sum"), F.max("frp").alias("max_frp"), F.avg(conf).alias("mean_conf"), (F.count_if("night") * 100.0 / F.count("*")).alias("night_pct")
    )


def popup_inputs(detections: DataFrame, clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """What the badge of a mark on the map is worked out from, and the badge: kind, id, frp, conf, night, score, threat. A cluster counts as 1.4
    times its mean power with confidence 75, a cell as its strongest detection with its mean confidence; both as night from over 40 %."""
    own = detections.select(F.lit("detection").alias("kind"), F.col("pt_seq").cast("string").alias("id"), "frp", F.coalesce(confidence("conf_raw"), F.lit(60)).cast("double").alias("conf"), "night")
    of_clusters = clusters.select(F.lit("cluster").alias("kind"), F.concat_ws(" ", F.col("day").cast("string"), "cluster_id").alias("id"), (F.col("frp_mean") * 1.4).alias("frp"), F.lit(75.0).alias("conf"), (F.col("night_pct") > 40).alias("night"))
    place = F.format_string("%s %.1f %.1f", F.col("day").cast("string"), "lat", "lon")
    of_cells = cells.select(F.lit("cell").alias("kind"), place.alias("id"), F.col("max_frp").alias("frp"), F.col("mean_conf").alias("conf"), (F.col("night_pct") > 40).alias("night"))
    rows = own.unionByName(of_clusters).unionByName(of_cells)
    return rows.withColumn("score", threat_score("frp", "conf", "night")).withColumn("threat", threat_label("score"))


def contexts(summary: DataFrame, alerts: DataFrame, clusters: DataFrame, weather: DataFrame, k: int = 5) -> DataFrame:
    """One JSON document per day for an analyst: totals, alert, sensors, clusters by class, the k with the most power, and the fire weather."""
    sensor = F.struct("sensor", "n", "mean_frp", "max_frp", rounded(F.col("hi_conf") * 100.0 / F.col("n")).alias("hi_pct"), "night_pct")
    sensors = summary.groupBy("day").agg(F.sort_array(F.collect_list(sensor)).alias("sensors"))  # five sensors
    facts = F.struct(F.col("cluster_id").alias("id"), F.col("class").alias("cls"), "n", rounded("frp_sum").alias("frp_sum"), "spread_km", rounded("night_pct").alias("night_pct"))
    ranked = clusters.select("day", "class", facts.alias("c"), F.row_number().over(Window.partitionBy("day").orderBy(F.desc("frp_sum"), "label")).alias("r"))
    classes = F.struct(*(F.count_if(F.col("class") == c).alias(c) for c in ("MEGAFIRE", "ESTABLISHED", "EMERGING", "SCATTERED")))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= k, F.struct("r", "c")))), lambda s: s["c"])
    groups = alerts.select("day").join(ranked, "day", "left").groupBy("day").agg(F.count("r").alias("clusters"), classes.alias("classes"), top.alias("top"))  # days without clusters too
    sky = weather.select("day", F.struct("score", "verdict").alias("weather"))
    rows = alerts.join(sensors, "day").join(groups, "day").join(F.broadcast(sky), "day", "left")  # weather: a row per day
    whole = [F.col("day").cast("string").alias("day"), F.col("total"), rounded("frp").alias("frp"), F.col("level"), F.col("sensors"), F.col("clusters"), F.col("classes"), F.col("top"), F.col("weather")]
    return rows.select("day", F.to_json(F.struct(*whole)).alias("context"))


def flat_distance(lon1, lat1, lon2, lat2) -> Column:
    """Distance in degrees on the plane of longitude and latitude."""
    return F.hypot(col(lon1) - col(lon2), col(lat1) - col(lat2))
