"""Queries over clusters, tracks, rasters and events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.functions.constants import FOOTPRINT_MODEL
from burncal.functions.scalars import SENSORS, cluster_class, frp_band, rounded
from burncal.operators import cluster, exports, models, raster, selections, summary, track, triage
from burncal.operators.selections import split_by_last_day
from burncal.plans.detections import CONF, DET_CONF, LABEL, r, total
from burncal.session import written
from burncal.sources.fixtures import BBOX, detections, oracle

EPS = 0.62  # what adaptive_eps gives for the view's box
MIN_PTS = 3


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.labelled(detections(spark, sf_dir), EPS, MIN_PTS)


def labels_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What votes need of `labelled`: large scenes are shuffled and written without the other columns."""
    return cluster.labelled(detections(spark, sf_dir).select("pt_seq", "day", "lon", "lat"), EPS, MIN_PTS).select("pt_seq", "day", "label")


def eps_neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.neighbor_counts(detections(spark, sf_dir), EPS)


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over cells, whatever the size of a scene."""
    return cluster.dbscan(detections(spark, sf_dir), EPS, MIN_PTS).select("pt_seq", "day", F.col("component").cast("long").alias("component"), "label")


def dbscan_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels, one scene in memory at a time where scenes are small enough."""
    return cluster.labelled(detections(spark, sf_dir).select("pt_seq", "day", "lon", "lat"), EPS, MIN_PTS).select("pt_seq", "component", "label")


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_stats(labelled(spark, sf_dir))


def cluster_sensor_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_sensor_mix(labelled(spark, sf_dir))


def cluster_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_classes(cluster_stats(spark, sf_dir))


def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve clusters with the most power."""
    return cluster_stats(spark, sf_dir).select("day", "label", "frp_sum", "class").orderBy(F.desc("frp_sum"), "day", "label").limit(12)


def segmentation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.segmentation_summary(labelled(spark, sf_dir), EPS, MIN_PTS)


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.weak_labels(detections(spark, sf_dir))


def complex_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.complex_stats(detections(spark, sf_dir))


def cluster_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners as text, in alphabetical order, and lengths to three decimals."""
    found = cluster.cluster_hulls(labelled(spark, sf_dir))
    corners = F.array_join(F.array_sort(F.transform("hull", lambda p: F.format_string("%.5f %.5f", p[0], p[1]))), ",")
    return found.select("day", "label", corners.alias("corners"), "area_km2", rounded("perimeter_km", 3).alias("perimeter_km"), "elongation")


def geojson_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    sensors = rows.filter("label is not null").groupBy("day", "label", "sensor").count().groupBy("day", "label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sensor", "count")))).alias("sensors"))
    return exports.clusters_geojson(cluster.cluster_stats(rows).join(cluster.cluster_hulls(rows), ["day", "label"]).join(sensors, ["day", "label"]))


def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.points_geojson(detections(spark, sf_dir))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    return exports.detections_csv(rows.withColumn("satellite", F.substring_index("sensor", "-", -1)).withColumn("acquired", F.format_string("%02d:00 UTC", "acq_hour")))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail as text."""
    found = track.trend_class(track.tracks(cluster_stats(spark, sf_dir)))
    return found.withColumn("trail", F.array_join(F.transform("trail", lambda p: F.format_string("%.4f %.4f", p[0], p[1])), ","))


def track_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.track_picks(track.tracks(cluster_stats(spark, sf_dir))).select("region", "rank", "track_id", "days_seen", "latest_frp")


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training label stands for a model's class."""
    rows = detections(spark, sf_dir)
    return labels_alone(spark, sf_dir).join(cluster.weak_labels(rows), "pt_seq")


def behavior_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.behavior_votes(voted(spark, sf_dir))


def behavior_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.behavior_mix(cluster.weak_labels(detections(spark, sf_dir)).join(detections(spark, sf_dir), "pt_seq"))


def classifier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    found = models.classifier_features(rows, raster.with_box_counts(rows))
    return found.select("pt_seq", *(rounded(c, 6).alias(c) if c.startswith(("dens", "log", "frp")) else F.col(c) for c in models.CLASSIFIER_FEATURES))


def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection by a forest that has learnt the training labels of all days but the last. Its depth and number of trees are the published ones."""
    rows = detections(spark, sf_dir)
    features = written(models.classifier_features(rows, raster.with_box_counts(rows)), "features")
    known = written(split_by_last_day(features)[0].join(cluster.weak_labels(rows), "pt_seq"), "known")
    return models.forest_scores(models.train_classifier(known), features)


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well power tells confident detections from others."""
    rows = summary.with_confidence(detections(spark, sf_dir)).select((F.coalesce("conf", F.lit(0)) >= 70).cast("int").alias("y"), F.floor("frp").alias("p"))
    found = models.ranking_metrics(rows)
    return found.select("n", "positives", rounded("auc", 6).alias("auc"), rounded("ap", 6).alias("ap"))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.with_confidence(detections(spark, sf_dir)).select((F.coalesce("conf", F.lit(0)) >= 70).cast("int").alias("y"), F.least(F.col("frp") / 500, F.lit(1.0)).alias("p"))
    found = models.binary_metrics(rows)
    return found.select(*(rounded(c, 6).alias(c) for c in found.columns))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training labels against intensity bands."""
    rows = detections(spark, sf_dir).withColumn("band", frp_band("frp"))
    return models.confusion(cluster.weak_labels(rows).join(rows, "pt_seq"), "behavior", "band")


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a detection's own power and of its cluster, where it is in one."""
    stats = cluster_stats(spark, sf_dir).select("day", "label", F.col("class").alias("truth"))
    rows = labelled(spark, sf_dir).join(stats, ["day", "label"]).withColumn("said", cluster_class(F.lit(1), "frp"))
    found = models.class_metrics(rows, "truth", "said")
    return found.select("n", rounded("accuracy", 6).alias("accuracy"), rounded("macro_f1", 6).alias("macro_f1"))


def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.group_profile(detections(spark, sf_dir).withColumn("band", frp_band("frp")), "band")


def cell_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.cell_questions(selections.day_cells(detections(spark, sf_dir)), "amazon")


def cluster_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return selections.cluster_questions(cluster.cluster_stats(rows).join(cluster.cluster_hulls(rows), ["day", "label"]), "amazon")


def popup_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    return selections.popup_inputs(rows, cluster_stats(spark, sf_dir), selections.day_cells(rows)).select("kind", "id", "score", "threat")


#: Areas with a forecast of their own.
AREAS = {"aoi": BBOX, "inner": (-66.0, -8.0, -58.0, -2.0)}
#: The tables' days are of January; so many days later they are of the season that the footprint model has learnt.
SEASON_DAYS = 231


def in_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).withColumn("day", F.date_add("day", SEASON_DAYS))


def footprint_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.footprint_forecast(in_season(spark, sf_dir), AREAS)


def forecast_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.forecast_cells(footprint_forecast(spark, sf_dir))


def forecast_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.hit_share(forecast_cells(spark, sf_dir))


def forecast_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.forecast_stats(in_season(spark, sf_dir), footprint_forecast(spark, sf_dir), AREAS)
    return found.withColumns({"mean_p": rounded("mean_p", 3), "iou": rounded("iou", 3)})


def density_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.density_features(detections(spark, sf_dir))


def box_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.box_counts(detections(spark, sf_dir))
    return found.select("pt_seq", *(rounded(f"dens_{k}", 6).alias(f"dens_{k}") for k in range(3)))


def event_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 0 make the profile; all others are events at a made-up distance."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    events = vectors.filter("label <> 0").select(F.col("vec_id").alias("event_id"), "embedding", F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 90).cast("double")).alias("distance"))
    return triage.event_relevance(events, triage.mean_profile(vectors.filter("label = 0")))


def sitrep_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.sitrep(summary.sensor_day_summary(detections(spark, sf_dir), BBOX))


QUERIES = {
    "eps_neighbor_counts": eps_neighbor_counts, "dbscan_labels": dbscan_labels, "dbscan_scenes": dbscan_scenes, "cluster_stats": cluster_stats, "cluster_sensor_mix": cluster_sensor_mix,
    "cluster_classes": cluster_classes, "top_clusters": top_clusters, "segmentation_summary": segmentation_summary, "weak_labels": weak_labels, "complex_stats": complex_stats,
    "cluster_hulls": cluster_hulls, "geojson_clusters": geojson_clusters, "geojson_points": geojson_points, "csv_rows": csv_rows, "tracks": tracks, "density_features": density_features,
    "box_densities": box_densities, "footprint_forecast": footprint_forecast, "event_relevance": event_relevance, "sitrep_text": sitrep_text,
    "track_picks": track_picks, "behavior_votes": behavior_votes, "behavior_mix": behavior_mix, "classifier_features": classifier_features, "forest_scores": forest_scores, "ranking_metrics": ranking_metrics,
    "binary_metrics": binary_metrics, "confusion": confusion, "class_metrics": class_metrics, "group_profile": group_profile, "cell_questions": cell_questions, "cluster_questions": cluster_questions,
    "popup_inputs": popup_inputs, "forecast_cells": forecast_cells, "forecast_hits": forecast_hits, "forecast_stats": forecast_stats,
}


def _labels(name: str, points: str, dims: tuple[str, ...], eps: float, min_pts: int, scene: str) -> dict[str, str]:
    """CTEs that end in `name`: the points with component and label, by reachability over pairs of core points."""
    d2 = " + ".join(f"(a.{d}-b.{d})*(a.{d}-b.{d})" for d in dims)
    return {
        f"{name}_e": f"select a.pt_seq as s, b.pt_seq as t from {points} a join {points} b on a.{scene}=b.{scene} and a.pt_seq<>b.pt_seq and {d2} <= {eps}e0*{eps}e0",
        f"{name}_c": f"select s from {name}_e group by s having count(*)+1>={min_pts}",
        f"{name}_ce": f"select s, t from {name}_e where s in (select s from {name}_c) and t in (select s from {name}_c)",
        f"{name}_w(node, lab)": f"select s, s from {name}_c union select e.t, w.lab from {name}_w w join {name}_ce e on e.s=w.node where w.lab<e.t",
        f"{name}_m": f"select node, min(lab) as lab from {name}_w group by node",
        f"{name}_b": f"select e.t as node, min(m.lab) as lab from {name}_e e join {name}_m m on m.node=e.s group by e.t",
        name: f"select p.*, coalesce(m.lab, b.lab) as component, case when coalesce(m.lab, b.lab) is not null then cast(dense_rank() over (partition by p.{scene} order by coalesce(m.lab, b.lab) nulls last) as int) end as label from {points} p left join {name}_m m on m.node=p.pt_seq left join {name}_b b on b.node=p.pt_seq",
    }


def _recursive(select: str, *views: str, **parts: str) -> str:
    return oracle(select, *views, **parts).replace("with ", "with recursive ", 1)


_DB = _labels("lb", "det", ("lon", "lat"), EPS, MIN_PTS, "day")
_POWER = "case when coalesce(frp,0)=0 then 0.5e0 else frp end"
_KM = "2*6371e0*asin(least(1e0, sqrt(sin((radians(lat)-radians(cy))/2)*sin((radians(lat)-radians(cy))/2) + cos(radians(cy))*cos(radians(lat))*sin((radians(lon)-radians(cx))/2)*sin((radians(lon)-radians(cx))/2))))"
_STATS = {
    "mem": f"select *, {_POWER} as power, {CONF} as conf from lb where label is not null",
    "cen": f"select day, label, {total('lon')}/count(*) as cx, {total('lat')}/count(*) as cy from mem group by 1,2",
    "awa": f"select mem.*, cx, cy, {_KM} as km from mem join cen using (day, label)",
    "st": f"""select *, case when n>=150 or frp_sum>=5000 then 'MEGAFIRE' when n>=40 or frp_sum>=1200 then 'ESTABLISHED' when n>=8 then 'EMERGING' else 'SCATTERED' end as class, 'F-'||lpad(cast(label as varchar),cast(greatest(3,len(cast(label as varchar))) as int),'0') as cluster_id from
 (select day, label, count(*) as n, {total('power')} as frp_sum, {total('power')}/count(*) as frp_mean, max(power) as frp_max, count(case when conf>=70 or conf is null then 1 end)*100e0/count(*) as hi_pct, count(case when night then 1 end)*100e0/count(*) as night_pct,
 {r('any_value(cx)', 4)} as c_lon, {r('any_value(cy)', 4)} as c_lat, {r('avg(km)', 1)} as radius_km, {r('max(km)', 1)} as spread_km, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from awa group by 1,2) x""",
}
#: Tracks, cluster by cluster: the last places and days of all tracks so far, and the track that the cluster joins or begins.
_HAVERSINE = "2*6371e0*asin(least(1e0, sqrt(sin(radians(clat-la[j])/2)*sin(radians(clat-la[j])/2) + cos(radians(la[j]))*cos(radians(clat))*sin(radians(clon-lo[j])/2)*sin(radians(clon-lo[j])/2))))"
_MOVED = lambda was, now: f"case when hit then list_transform(range(1, len({was})+1), lambda j: case when j=best then {now} else {was}[j] end) else list_append({was}, {now}) end"
_TRACKS = {
    "tc": "select *, row_number() over (order by day, frp_sum desc, label) as i from st",
    "tw(i, la, lo, dy, t)": f"""select cast(0 as bigint), cast([] as double[]), cast([] as double[]), cast([] as date[]), cast(0 as bigint) union all
 select i, {_MOVED('la', 'clat')}, {_MOVED('lo', 'clon')}, {_MOVED('dy', 'day')}, case when hit then best else len(la)+1 end from
 (select *, coalesce(m, 1e9) <= 60e0 as hit, list_position(away, m) as best from (select *, list_min(away) as m from
 (select *, list_transform(range(1, len(la)+1), lambda j: case when dy[j] < day then {_HAVERSINE} else 1e9 end) as away from
 (select c.i, c.c_lat as clat, c.c_lon as clon, c.day, la, lo, dy from tw w join tc c on c.i=w.i+1) v) x) y) z""",
    "tr": """select 'aoi' as region, 'SYS-'||lpad(cast(t as varchar), cast(greatest(3, len(cast(t as varchar))) as int), '0') as track_id, min(day) as first_day, max(day) as last_day, cast(count(*) as int) as days_seen, arg_max(class, day) as latest_class,
 max(frp_sum) as peak_frp, arg_max(frp_sum, day) as latest_frp, (arg_max(frp_sum, day)-arg_min(frp_sum, day))/greatest(arg_min(frp_sum, day), 1e0) as frp_trend, arg_max(n, day) as latest_n, string_agg(printf('%.4f %.4f', c_lon, c_lat), ',' order by day) as trail
 from tc join tw using (i) group by t having arg_max(frp_sum, day) > 0""",
}
_ZD = "select det.*, (lat-ml)/case when sl>0 then sl else 1 end as z_lat, (lon-mo)/case when so>0 then so else 1 end as z_lon from det join (select day, avg(lat) as ml, stddev_pop(lat) as sl, avg(lon) as mo, stddev_pop(lon) as so from det group by day) s using (day)"
_ZA = "select d.*, 0 as scene, (lat-ml)/sl as z_lat, (lon-mo)/so as z_lon, (lf-mf)/sf as z_frp from (select *, ln(1e0+frp) as lf from det) d, (select avg(lat) as ml, stddev_pop(lat) as sl, avg(lon) as mo, stddev_pop(lon) as so, avg(ln(1e0+frp)) as mf, stddev_pop(ln(1e0+frp)) as sf from det) s"
_BOX = {
    "ce": "select pt_seq, d.day, cast(floor((lon-w)/0.01e0) as int) as i, cast(floor((lat-s)/0.01e0) as int) as j from det d join (select day, min(lon)-1.05e0 as w, min(lat)-1.05e0 as s from det group by day) c on c.day=d.day",
}
#: Hulls: edges a -> b with no point of the cluster to their right, nor beyond them in line; then corners and measures.
_HULL = {
    "hp": "select distinct day, label, lon as x, lat as y from lb where label is not null",
    "he": """select a.day, a.label, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from hp a join hp b on a.day=b.day and a.label=b.label and (a.x<>b.x or a.y<>b.y)
 where not exists (select 1 from hp c where c.day=a.day and c.label=a.label and ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) < 0 or ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) = 0
 and ((c.x-a.x)*(b.x-a.x)+(c.y-a.y)*(b.y-a.y) < 0 or (c.x-a.x)*(b.x-a.x)+(c.y-a.y)*(b.y-a.y) > (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)))))""",
    "hc": f"select day, label, {total('lat')}/count(*) as cy, {total('lon')}/count(*) as cx, count(*) as n from lb where label is not null group by 1,2",
    "hr": f"select lb.day, lb.label, any_value(cy) as lat0, avg({_KM}) as radius from lb join hc on hc.day=lb.day and hc.label=lb.label where lb.label is not null group by 1,2",
    "hg": """select day, label, string_agg(corner, ',' order by corner) as corners, count(*) as k from (select day, label, printf('%.5f %.5f', ax, ay) as corner from he) v group by 1,2
 union all select day, label, any_value(printf('%.5f %.5f', x, y)), 1 from hp group by 1,2 having count(*)=1""",
    "ha": f"select day, label, abs(sum((bx-ax)*greatest(0.2e0,cos(radians(lat0)))*111.32e0*(by_+ay)*110.57e0)/2) as area, sum(sqrt(power((bx-ax)*111.32e0*greatest(0.2e0,cos(radians(ay))),2)+power((by_-ay)*110.57e0,2))) as around from he join hr using (day, label) group by 1,2",
    "hm": f"""select day, label, corners, {r('area', 0).replace('cast(', '', 1).replace(' as bigint)', '')} as area_km2, perimeter, case when area>1 then {r('perimeter/(2*sqrt(pi()*area))', 2)} else 1e0 end as elongation from
 (select day, label, corners, case when k>=3 then area else pi()*radius*radius end as area, case when k>=3 then around else 2*pi()*radius end as perimeter from hg join hr using (day, label) left join ha using (day, label)) q""",
}
_AREA = lambda k, rad: repr(math.pi * rad * rad / ((2 * k + 1) * 0.01) ** 2) + "e0"
_DOT = lambda a, b: f"list_sum(list_transform(range(1,65), lambda i: cast({a}[i] as double)*cast({b}[i] as double)))"

_BOXES = "select a.pt_seq, " + ", ".join(r(f"count(case when abs(a.i-b.i)<={k} and abs(a.j-b.j)<={k} then 1 end)*{_AREA(k, x)}", 6) + f" as dens_{n}" for n, (k, x) in enumerate(((5, 0.05), (25, 0.25), (100, 1.0)))) + " from ce a join ce b on a.day=b.day group by 1"
_BAND = "case when frp < 10 then 'SMOULDERING' when frp < 100 then 'SURFACE FIRE' when frp < 250 then 'INTENSE FRONT' else 'CONFLAGRATION' end"
_CELLS = f"select day, (floor(lat/1e0)+0.5e0)*1e0 as lat, (floor(lon/1e0)+0.5e0)*1e0 as lon, count(*) as n, {total('frp')} as frp_sum, max(frp) as max_frp, avg(coalesce({CONF},60)) as mean_conf, count(case when night then 1 end)*100e0/count(*) as night_pct from det group by 1,2,3"
_WEAK = {
    "zd": _ZD, **_labels("wl", "zd", ("z_lat", "z_lon"), 0.12, 6, "day"),
    "bh": f"select pt_seq, case when l.label is null then 'ISOLATED' when n>=800 and s>=25000 then 'MEGAFIRE' when n>=150 then 'ESTABLISHED' when n>=40 then 'EMERGING' else 'SCATTERED' end as behavior from wl l left join (select day, label, count(*) as n, {total('frp')} as s from wl where label is not null group by 1,2) g on g.day=l.day and g.label=l.label",
}


def _forecast() -> dict[str, str]:
    """CTEs that end in fp: every cell of the areas' rasters with its probability. Gaussians are two sums over weights, places beyond the
    ends counted at the ends."""
    grids = {a: raster.forecast_grid(box, FOOTPRINT_MODEL["cell"]) for a, box in AREAS.items()}
    rows = ", ".join(f"('{a}', {g.west}e0, {g.south}e0, {g.east}e0, {g.north}e0, {g.cell}e0, {g.wide}, {g.high})" for a, g in grids.items())
    line = lambda v, n: f"select area, b, v as {v}, least(greatest(v+o, 0), {n}-1) as {'i' if v == 'x' else 'j'}, sum(k) as w from (select fk.*, unnest(range({n})) as v from fk) q group by 1, 2, 3, 4"
    values = ("n", "frp", "last", "before")
    layer = [f"coalesce(max(case when v.b={b} then ln(1e0+v.{c}/case when m.{c}>0 then m.{c} else 1e0 end) end), 0e0) as l{k}" for k, (b, c) in enumerate(((1, "n"), (2, "n"), (3, "n"), (2, "frp"), (2, "last"), (2, "before")))]
    features = [*(f"l{k}" for k in range(6)), "(x+0.5e0)*cell/(e-w)", "(y+0.5e0)*cell/(n-s)", "sin(angle)", "cos(angle)"]
    z = " + ".join(f"({c!r}e0)*(({f})-({m!r}e0))/({d!r}e0)" for f, m, d, c in zip(features, FOOTPRINT_MODEL["mean"], FOOTPRINT_MODEL["scale"], FOOTPRINT_MODEL["coef"]))
    return {
        "fa(area, w, s, e, n, cell, wide, high)": f"values {rows}",
        "fd": f"select day, row_number() over (order by day desc)-1 as age, max(day) over () + {SEASON_DAYS} as latest, least(count(*) over () - 1, 1) as second from (select distinct day from det order by day desc limit 5) x",
        "fc": f"select area, latest, i, j, cast(count(*) as double) as n, {total('frp')} as frp, cast(count(case when age=0 then 1 end) as double) as last, cast(count(case when age=second then 1 end) as double) as before from (select fa.area, latest, age, second, frp, wide, high, cast(floor((lon-w)/cell) as int) as i, cast(floor((lat-s)/cell) as int) as j from det join fd using (day), fa) x where i>=0 and i<wide and j>=0 and j<high group by 1,2,3,4",
        "fk": "select area, b, o, wide, high, exp(-(o*o)/(2*g*g))/sum(exp(-(o*o)/(2*g*g))) over (partition by area, b) as k from (select *, unnest(range(-r, r+1)) as o from (select *, greatest(1, cast(floor(4*g+0.5e0) as bigint)) as r from (select fa.*, b, width/cell as g from fa, (values (1, 0.10e0), (2, 0.35e0), (3, 0.80e0)) b(b, width)) x) y) q",
        "fx": line("x", "wide"),
        "fy": line("y", "high"),
        "fh": f"select fc.area, b, x, j, {', '.join(f'sum({c}*fx.w) as {c}' for c in values)} from fc join fx on fx.area=fc.area and fx.i=fc.i group by 1,2,3,4",
        "fv": f"select fh.area, fh.b, x, y, {', '.join(f'sum({c}*fy.w) as {c}' for c in values)} from fh join fy on fy.area=fh.area and fy.b=fh.b and fy.j=fh.j group by 1,2,3,4",
        "fm": f"select area, b, {', '.join(f'max({c}) as {c}' for c in values)} from fv group by 1,2",
        "fl": f"select v.area, x, y, {', '.join(layer)} from fv v join fm m on m.area=v.area and m.b=v.b group by 1,2,3",
        "ft": "select area, latest, 2e0*pi()*dayofyear(latest+1)/365 as angle from fc group by 1,2 having sum(n)>=30",
        "fr": "select fa.*, x, y, latest, angle from fa join ft using (area), unnest(range(wide)) g(x), unnest(range(high)) h(y)",
        "fp": f"select fr.area, fr.latest, w, s, cell, fr.x, fr.y, 1e0/(1e0+exp(-({FOOTPRINT_MODEL['intercept']!r}e0 + {z}))) as p from (select fr.*, {', '.join(f'coalesce(l{k}, 0e0) as l{k}' for k in range(6))} from fr left join fl on fl.area=fr.area and fl.x=fr.x and fl.y=fr.y) fr",
        "fo": "select fp.area, fp.latest+1 as day, cast(x as int) as i, cast(y as int) as j, floor((w+(x+0.5e0)*cell)*1e4+0.5e0)/1e4 as lon, floor((s+(y+0.5e0)*cell)*1e4+0.5e0)/1e4 as lat, floor(p*1000+0.5e0)/1000 as p, coalesce(last>0, false) as actual from fp left join fc on fc.area=fp.area and fc.i=x and fc.j=y where p>=0.5e0",
        "fb": "select * from (select *, cast(row_number() over (partition by area, day order by p desc, j, i) as int) as rank from fo) q where rank<=8000",
        "fs": "select area, count(*) as predicted, cast(sum(cast(p as decimal(18,3))) as double)/count(*) as mean_p, max(p) as max_p, count(case when actual then 1 end) as overlap, count(case when p>=0.85e0 then 1 end) as confident from fo group by 1",
        "fz(area, size)": "values " + ", ".join(f"('{a}', {g.cell * raster.KM * (g.cell * raster.KM * math.cos(math.radians((g.south + g.north) / 2)))!r}e0)" for a, g in grids.items()),
    }


def _forecasted(select: str) -> str:
    sql = oracle(select, "det", **_forecast())
    for name in ("fc", "fx", "fy", "fh", "fv", "fo"):
        sql = sql.replace(f" {name} as (", f" {name} as materialized (")
    return sql


def tracked_sql(select: str) -> str:
    """SQL over tr, the tracks of the view's clusters."""
    return _recursive(select, "det", **_DB, **_STATS, **_TRACKS).replace("tc as (", "tc as materialized (")


ORACLES = {
    "eps_neighbor_counts": oracle(f"select a.pt_seq, count(b.pt_seq) as n from det a left join det b on a.day=b.day and a.pt_seq<>b.pt_seq and (a.lon-b.lon)*(a.lon-b.lon)+(a.lat-b.lat)*(a.lat-b.lat)<={EPS}e0*{EPS}e0 group by 1", "det"),
    "dbscan_labels": _recursive("select pt_seq, day, component, label from lb", "det", **_DB),
    "dbscan_scenes": _recursive("select pt_seq, component, label from lb", "det", **_DB),
    "cluster_stats": _recursive("select * from st", "det", **_DB, **_STATS),
    "cluster_sensor_mix": _recursive(
        f"select day, label, sensor, n, {r('n*100e0/sum(n) over (partition by day, label)', 0)} as pct, row_number() over (partition by day, label order by n desc, f)=1 as leads from (select day, label, sensor, count(*) as n, min(pt_seq) as f from lb where label is not null group by 1,2,3) x", "det", **_DB
    ),
    "cluster_classes": _recursive("select v.class, count(st.n) as n from (values ('MEGAFIRE'),('ESTABLISHED'),('EMERGING'),('SCATTERED')) v(class) left join st on st.class=v.class group by 1", "det", **_DB, **_STATS),
    "top_clusters": _recursive("select day, label, frp_sum, class from st order by frp_sum desc, day, label limit 12", "det", **_DB, **_STATS),
    "segmentation_summary": _recursive(f"select day, count(*) as total, count(*)-count(label) as scattered, count(label)*100e0/count(*) as clustered_pct, {EPS}e0 as eps, cast({MIN_PTS} as int) as min_pts from lb group by day", "det", **_DB),
    "weak_labels": _recursive(
        f"select pt_seq, case when l.label is null then 'ISOLATED' when n>=800 and s>=25000 then 'MEGAFIRE' when n>=150 then 'ESTABLISHED' when n>=40 then 'EMERGING' else 'SCATTERED' end as behavior from wl l left join (select day, label, count(*) as n, {total('frp')} as s from wl where label is not null group by 1,2) z on z.day=l.day and z.label=l.label",
        "det", zd=_ZD, **_labels("wl", "zd", ("z_lat", "z_lon"), 0.12, 6, "day"),
    ),
    "complex_stats": _recursive(
        f"""select *, cast(row_number() over (order by total_frp_mw desc, complex_id) as int) as rank, case when detections>=500 or total_frp_mw>=20000 then 'megafire' when detections>=150 or total_frp_mw>=5000 then 'major' when detections>=40 then 'active' else 'smoldering' end as class from
 (select label-1 as complex_id, count(*) as detections, {r(total('frp'), 1)} as total_frp_mw, {r(total('frp') + '/count(*)', 1)} as mean_frp_mw, {r('max(frp)', 1)} as max_frp_mw, {r('cast(sum(cf) as double)/count(*)', 1)} as mean_confidence, string_agg(distinct sensor, '+' order by sensor) as sensors,
 {r(total('lat') + '/count(*)', 4)} as centroid_lat, {r(total('lon') + '/count(*)', 4)} as centroid_lon, count(distinct day) as acq_days, {r('cast(count(case when night then 1 end) as double)/count(*)', 3)} as night_fraction
 from (select *, coalesce(case lower(trim(conf_raw)) when 'l' then 20 when 'n' then 50 when 'h' then 90 else {CONF} end, 50) as cf from cx where label is not null) q group by 1 having count(*)>=6) x""",
        "det", za=_ZA, **_labels("cx", "za", ("z_lat", "z_lon", "z_frp"), 0.12, 6, "scene"),
    ),
    "footprint_forecast": _forecasted("select * from fo"),
    "forecast_cells": _forecasted("select * from fb"),
    "forecast_hits": _forecasted("select *, cast(floor(hits*100e0/top+0.5e0) as bigint) as top_aligned_pct from (select area, day, count(*) as top, count(case when actual then 1 end) as hits from fb where rank<=2000 group by 1,2) q"),
    "forecast_stats": _forecasted(
        f"select area, predicted, {r('mean_p', 3)} as mean_p, max_p, overlap, confident, coalesce(active, 0) as active, cast(floor(predicted*size+0.5e0) as bigint) as area_km2, {r('overlap*1e0/(predicted+coalesce(active, 0)-overlap)', 3)} as iou from fs join fz using (area) left join (select area, count(*) as active from fc where last>0 group by 1) k using (area)"
    ),
    "tracks": tracked_sql("select *, case when frp_trend>0.25 then 'growing' when frp_trend<-0.25 then 'decaying' else 'steady' end as trend from tr"),
    "track_picks": tracked_sql("select * from (select region, cast(row_number() over (partition by region order by latest_frp desc, track_id) as int) as rank, track_id, days_seen, latest_frp from tr where days_seen>=2) x where rank<=8"),
    "cluster_hulls": _recursive("select day, label, corners, area_km2, " + r("perimeter", 3) + " as perimeter_km, elongation from hm", "det", **_DB, **_HULL),
    "cluster_questions": _recursive(
        f"""select day, cluster_id, printf('Fire cluster %s (%s) in amazon on %s: %d detections, %d MW in total, spread %.1f km, hull of %d km2, front ratio %.2f. Brief a commander on it and on the next 48 hours.', cluster_id, class, cast(day as varchar), n, {r('frp_sum', 0)}, spread_km, {r('area_km2', 0)}, elongation) as question from st join hm using (day, label)""",
        "det", **_DB, **_STATS, **_HULL,
    ),
    "geojson_points": oracle(
        "select pt_seq, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":['||cast(lon as decimal(12,5))||','||cast(lat as decimal(12,5))||']},\"properties\":{\"frp\":'||frp||',\"sensor\":\"'||sensor||'\",\"night\":'||night||'}}' as feature from (select *, list_position(" + str(list(SENSORS)) + ", sensor) as rk from det order by rk, pt_seq limit 6000) x", "det"
    ),
    "csv_rows": oracle(
        "select sensor, split_part(sensor,'-',2) as satellite, lat as latitude, lon as longitude, frp as frp_mw, coalesce(conf_raw,'') as confidence, case when night then 'N' else 'D' end as daynight, printf('%02d:00 UTC', acq_hour) as acq_time from det", "det"
    ),
    "behavior_votes": _recursive(
        f"select day, label, behavior, n, {r('n*100e0/sum(n) over (partition by day, label)', 0)} as pct, row_number() over (partition by day, label order by n desc, f)=1 as leads from (select lb.day, lb.label, behavior, count(*) as n, min(lb.pt_seq) as f from lb join bh using (pt_seq) where lb.label is not null group by 1,2,3) x",
        "det", **_DB, **_WEAK,
    ),
    "behavior_mix": _recursive("select day, behavior, count(*) as n from bh join det using (pt_seq) group by 1,2", "det", **_WEAK),
    "confusion": _recursive(f"select behavior as truth, {_BAND} as said, count(*) as n from bh join det using (pt_seq) group by 1,2", "det", **_WEAK),
    "class_metrics": _recursive(
        f"""select cast(sum(n) as bigint) as n, {r('cast(sum(case when truth=said then n else 0 end) as double)/sum(n)', 6)} as accuracy, {r('any_value(f1)', 6)} as macro_f1 from cm,
 (select avg(2e0*hit/(t+s)) as f1 from (select class, sum(t) as t, sum(s) as s, sum(hit) as hit from (select truth as class, n as t, 0 as s, case when truth=said then n else 0 end as hit from cm union all select said, 0, n, 0 from cm) u group by 1) v) w""",
        "det", **_DB, **_STATS, cm="select class as truth, case when frp>=5000 then 'MEGAFIRE' when frp>=1200 then 'ESTABLISHED' else 'SCATTERED' end as said, count(*) as n from lb join (select day, label, class from st) q using (day, label) group by 1,2",
    ),
    "group_profile": oracle(
        f"select {_BAND} as band, count(*) as n, {r(total('frp') + '/count(*)', 3)} as mean_frp, {r('cast(sum(cf) as double)/count(*)', 3)} as mean_conf, {r('count(case when night then 1 end)*1e0/count(*)', 3)} as night_frac, {r('cast(sum(acq_hour) as double)/count(*)', 3)} as mean_hour from (select *, coalesce(case lower(trim(conf_raw)) when 'l' then 20 when 'n' then 50 when 'h' then 90 else {CONF} end, 50) as cf from det) q group by 1",
        "det",
    ),
    "ranking_metrics": oracle(
        f"select n1+n0 as n, n1 as positives, {r('auc/(n1*n0)', 6)} as auc, {r('ap/n1', 6)} as ap from (select cast(sum(pos) as bigint) as n1, cast(sum(neg) as bigint) as n0, sum(neg*(tp-pos/2e0)) as auc, sum(pos*1e0*tp/(tp+fp)) as ap from (select *, sum(pos) over w as tp, sum(neg) over w as fp from (select floor(frp) as p, count(case when coalesce(conf,0)>=70 then 1 end) as pos, count(case when coalesce(conf,0)<70 then 1 end) as neg from dc group by 1) x window w as (order by p desc)) y) z",
        "det", dc=DET_CONF,
    ),
    "binary_metrics": oracle(
        f"select {r('avg(cast((p>=0.5)=(y=1) as int))', 6)} as accuracy, {r('hit*1e0/nullif(said,0)', 6)} as precision, {r('hit*1e0/nullif(true_,0)', 6)} as recall, {r('2e0*hit/nullif(said+true_,0)', 6)} as f1, {r('avg((p-y)*(p-y))', 6)} as brier, {r('hit*1e0/nullif(said+true_-hit,0)', 6)} as iou from (select *, count(case when p>=0.5 and y=1 then 1 end) over () as hit, count(case when p>=0.5 then 1 end) over () as said, count(case when y=1 then 1 end) over () as true_ from (select cast(coalesce(conf,0)>=70 as int) as y, least(frp/500, 1e0) as p from dc) x) z group by hit, said, true_",
        "det", dc=DET_CONF,
    ),
    "classifier_features": oracle(
        f"select pt_seq, {r('ln(1e0+frp)', 6)} as log_frp, coalesce({CONF},60) as conf, cast(night as int) as night_n, acq_hour as hour, cast(sensor like 'VIIRS%' as int) as is_viirs, dens_0, dens_1, dens_2, {r('frp/case when med<>0 then med else 1e0 end', 6)} as frp_ratio from det join (select day, frp as med from (select day, frp, row_number() over (partition by day order by frp) as rn, count(*) over (partition by day) as n from det) x where rn=n//2+1) m using (day) join bd using (pt_seq)",
        "det", **_BOX, bd=_BOXES,
    ),
    "cell_questions": oracle(
        f"""select day, lat, lon, printf('Fire cell around %.2f, %.2f in amazon on %s: %d detections, %d MW in total, strongest %d MW, mean confidence %d, %d%% at night. Assess it and say what to watch next.', lat, lon, cast(day as varchar), n, {r('frp_sum', 0)}, {r('max_frp', 0)}, {r('mean_conf', 0)}, {r('night_pct', 0)}) as question from dcell""",
        "det", dcell=_CELLS,
    ),
    "popup_inputs": _recursive(
        f"select kind, id, score, {LABEL} as threat from (select kind, id, {r('least(60e0, log10(1e0+greatest(frp,0e0))/log10(501e0)*60) + least(greatest(conf,0),100)/100e0*25 + case when night then 15 else 8 end', 0)} as score from (select 'detection' as kind, cast(pt_seq as varchar) as id, frp, cast(coalesce({CONF},60) as double) as conf, night from det union all select 'cluster', cast(day as varchar)||' '||cluster_id, frp_mean*1.4e0, 75e0, night_pct>40 from st union all select 'cell', printf('%s %.1f %.1f', cast(day as varchar), lat, lon), max_frp, mean_conf, night_pct>40 from dcell) u) v",
        "det", **_DB, **_STATS, dcell=_CELLS,
    ),
    "density_features": oracle(
        "select a.pt_seq, " + ", ".join(f"count(case when (a.lon-b.lon)*(a.lon-b.lon)+(a.lat-b.lat)*(a.lat-b.lat)<={x}e0*{x}e0 then 1 end) as dens_{k}" for k, x in enumerate((0.05, 0.25, 1.0))) + " from det a join det b on a.day=b.day group by 1", "det"
    ),
    "box_densities": oracle(
        "select a.pt_seq, " + ", ".join(r(f"count(case when abs(a.i-b.i)<={k} and abs(a.j-b.j)<={k} then 1 end)*{_AREA(k, x)}", 6) + f" as dens_{n}" for n, (k, x) in enumerate(((5, 0.05), (25, 0.25), (100, 1.0)))) + " from ce a join ce b on a.day=b.day group by 1", "det", **_BOX
    ),
    "event_relevance": f"""with pf as (select list(v order by i) as profile from (select i, avg(cast(embedding[i] as double)) as v from embeddings, range(1,65) g(i) where label=0 group by i) x),
 ev as (select vec_id as event_id, embedding, case when vec_id%7<>0 then cast(vec_id%90 as double) end as distance from embeddings where label<>0),
 sc as (select event_id, greatest(0e0, {_DOT('embedding', 'profile')}/(sqrt({_DOT('embedding', 'embedding')})*sqrt({_DOT('profile', 'profile')})+1e-9)) as sem, case when distance is null then 0.25e0 else greatest(0e0,1e0-distance/60) end as geo from ev, pf)
 select event_id, {r('geo', 3)} as geo_score, {r('sem', 3)} as semantic_score, {r('0.55e0*sem+0.45e0*geo', 4)} as relevance from sc order by relevance desc, event_id limit 20""",
    "sitrep_text": oracle(
        f"select day, printf('%s: %d active-fire detections, %d confident, strongest %.1f MW; MODIS %d, VIIRS %d.', cast(day as varchar), n, hi, top, modis, n-modis) as text from (select day, count(*) as n, count(case when conf>=80 then 1 end) as hi, {r('max(frp)', 1)} as top, count(case when sensor like 'MODIS%' then 1 end) as modis from dc where lon between -74 and -46 and lat between -12 and 2 group by day) x",
        "det", dc=DET_CONF,
    ),
}
