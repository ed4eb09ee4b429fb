"""Hand-made cases and properties."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from burncal.functions import scalars as s
from burncal.functions.constants import AOIS, PROTOTYPES, REGIONS, SEASON
from burncal.operators import cluster, exports, forest, harmonize, models, raster, selections, series, summary, track, triage
from burncal.sources import fixtures, readers
from tests.conftest import SF

DAY = dt.date(2024, 1, 1)


def points(spark, rows):
    return spark.createDataFrame([(i + 1, DAY, float(x), float(y), 1.0) for i, (x, y) in enumerate(rows)], "pt_seq long, day date, lon double, lat double, frp double")


def labels_of(spark, rows, eps, min_pts=3):
    found = cluster.dbscan(points(spark, rows), eps, min_pts).select("pt_seq", "label").collect()
    return [x[1] for x in sorted(map(tuple, found))]


def brute(rows, eps, min_pts):
    """A scan in the order of points, with all distances."""
    near = [[j for j, (x, y) in enumerate(rows) if j != i and (x - a) ** 2 + (y - b) ** 2 <= eps * eps] for i, (a, b) in enumerate(rows)]
    core, label, number = [len(n) + 1 >= min_pts for n in near], [None] * len(rows), 0
    for i in range(len(rows)):
        if core[i] and label[i] is None:
            number += 1
            label[i], queue = number, [i]
            while queue:
                for j in near[queue.pop()]:
                    if label[j] is None:
                        label[j] = number
                        if core[j]:
                            queue.append(j)
    return label


@pytest.mark.parametrize(
    "rows, eps, expected",
    [
        ([], 0.5, []),
        ([(0, 0), (0, 0), (0, 0)], 0.5, [1, 1, 1]),  # duplicates
        ([(0, 0), (0.5, 0), (1, 0)], 0.5, [1, 1, 1]),  # a distance of exactly eps counts
        ([(0, 0), (0.51, 0), (1.02, 0)], 0.5, [None] * 3),
        ([(5, 5), (0, 0), (0.1, 0), (0.2, 0)], 0.5, [None, 1, 1, 1]),
        # a border point between two clusters goes to the one whose first core point comes first
        ([(1, 0), (0, 0), (0.2, 0), (0.4, 0), (0.5, 0), (1.5, 0), (1.6, 0), (1.8, 0)], 0.5, None),
    ],
)
def test_dbscan_cases(spark, rows, eps, expected):
    found = labels_of(spark, rows, eps)
    assert found == (brute(rows, eps, 3) if expected is None else expected)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), max_size=25))
def test_dbscan_equals_scan(spark, rows):
    rows = [(x / 4, y / 4) for x, y in rows]
    assert labels_of(spark, rows, 0.5) == brute(rows, 0.5, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), max_size=60))
def test_scene_equals_scan(rows):
    rows = [(x / 4, y / 4) for x, y in rows]
    component, label = cluster.label_scene(np.array(rows).reshape(-1, 2), 0.5, 3)
    assert [int(v) or None for v in label] == brute(rows, 0.5, 3)
    assert all(v < 0 or label[v] == label[i] for i, v in enumerate(component))


def test_small_and_large_scenes(spark):
    rng = np.random.RandomState(3)
    rows = [(i + 1, DAY + dt.timedelta(days=int(i % 5 == 0)), *(float(v) for v in rng.randint(0, 40, 2) / 8), 1.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "pt_seq long, day date, lon double, lat double, frp double")
    found = {most: sorted((r.pt_seq, r.component, r.label) for r in cluster.labelled(frame, 0.3, 4, most=most).collect()) for most in (1000, 100, 1)}
    assert found[1000] == found[100] == found[1] and len(found[1]) == 300


def test_cells_that_almost_meet(spark):
    """Dense cells whose small cells lie around eps from each other: linked if and only if two points are."""
    rng = np.random.RandomState(1)
    for gap in (0.9999, 1.0001):
        left = [(-float(v), float(w)) for v, w in rng.rand(40, 2) * 0.05] + [(0.0, 0.0)]
        right = [(gap + float(v), float(w)) for v, w in rng.rand(40, 2) * 0.05] + [(gap, 0.0)]
        rows = [r for pair in zip(left, right) for r in pair]
        assert labels_of(spark, rows, 1.0) == brute(rows, 1.0, 3)


@pytest.mark.parametrize(
    "rows, size", [([(0, 0)], 1), ([(0, 0), (1, 1)], 2), ([(0, 0), (1, 0), (0, 1)], 3), ([(0, 0), (1, 1), (2, 2)], 2), ([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)], 4)]
)
def test_hull(rows, size):
    ring = cluster.convex_hull(np.array(rows, float))
    assert len(ring) == size


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(-10, 10), st.floats(-10, 10)), min_size=3, max_size=30, unique=True))
def test_hull_holds_all(rows):
    ring = cluster.convex_hull(np.array(rows, float))
    if len(ring) >= 3:
        edge = np.roll(ring, -1, 0) - ring
        for p in rows:
            away = np.array(p) - ring
            assert (edge[:, 0] * away[:, 1] - edge[:, 1] * away[:, 0] >= -1e-6).all()


def clusters(rows):
    return pd.DataFrame([{"region": "r", "day": DAY + dt.timedelta(days=d), "label": k, "n": 3, "frp_sum": f, "c_lon": x, "c_lat": 0.0, "cls": "EMERGING"} for k, (d, x, f) in enumerate(rows)])


def test_tracker():
    found = track.follow(clusters([(0, 0.0, 10), (1, 0.1, 20), (2, 0.2, 40)]))
    assert [(t["days_seen"], t["peak_frp"], t["frp_trend"]) for t in found] == [(3, 40, 3.0)]
    assert [t["days_seen"] for t in track.follow(clusters([(0, 0.0, 10), (1, 5.0, 20)]))] == [1, 1]  # too far apart
    assert [t["days_seen"] for t in track.follow(clusters([(0, 0.0, 10), (1, 0.1, 30), (1, -0.1, 20)]))] == [2, 1]  # a split: the stronger one goes on
    assert [t["days_seen"] for t in track.follow(clusters([(0, 0.0, 10), (0, 0.1, 9)]))] == [1, 1]
    assert [t["days_seen"] for t in track.follow(clusters([(0, 0.0, 10), (0, 0.1, 9)]), same_day=True)] == [2]
    assert [t["days_seen"] for t in track.follow(clusters([(0, 0.0, 10), (3, 0.1, 9)]))] == [2]  # a missing day


def test_confidence(spark):
    raw = ["", None, "L", " n ", "73.5", "x", "h", "100"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    found = rows.select("i", s.confidence("r"), s.confidence_training("r"), s.counts_as_high("r")).orderBy("i").collect()
    assert [r[1] for r in found] == [None, None, 30, 60, 74, None, 90, 100]
    assert [r[2] for r in found] == [50, 50, 20, 50, 74, 50, 90, 100]
    assert [r[3] for r in found] == [False, False, True, True, False, True, True, True]


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 4.9, 5, 10, 25, 60, 120, 250, 500)] + [(None,)], "frp double")
    assert [r.n for r in summary.frp_histogram(rows).orderBy("bin").collect()] == [3, 1, 1, 1, 1, 1, 1, 1]


def monthly(spark, counts, start="2000-01"):
    months = pd.period_range(start, periods=len(counts), freq="M").strftime("%Y-%m")
    return spark.createDataFrame([("r", m, c, c, False) for m, c in zip(months, counts)], "region string, ym string, count long, frp long, scaled boolean")


def test_short_series(spark):
    assert series.theil_sen(monthly(spark, [1, 2, 3])).first()[2:4] == (0.0, 2.0)
    assert series.theil_sen(monthly(spark, [1, 2, 3, 4])).first().slope == 1.0
    assert series.harmonic_forecast(monthly(spark, [5] * 35)).count() == 0
    ahead = series.harmonic_forecast(monthly(spark, [100 + 50 * (i % 12 == 6) for i in range(48)])).orderBy("ym").collect()
    assert [r.ym for r in ahead][:2] == ["2004-01", "2004-02"] and max(ahead, key=lambda r: r.mean).ym == "2004-07"
    assert series.cusum_points(monthly(spark, [5] * 60)).count() == 0  # five years
    step = series.cusum_points(monthly(spark, [10] * 60 + [90] * 60)).collect()
    assert [(r.year, r.before, r.after) for r in step] == [(2005, 120, 1080)]


def test_zero_months_go(spark):
    rows = spark.createDataFrame([("r", "MODIS-Terra", "2000-01", 0, 0, 0, 0), ("r", "MODIS-Terra", "2000-02", 7, 3, 0, 0)], "region string, sensor string, ym string, est long, frp long, hi_conf long, night long")
    assert [(r.ym, r["count"], r.scaled) for r in harmonize.unified_series(rows).collect()] == [("2000-02", 7, True)]


def test_prototypes_match_themselves(spark):
    rows = spark.createDataFrame([(p[0], *p[2:]) for p in PROTOTYPES], "region string, peak_month int, seasonality double, interannual_cv double, night_fraction double, mean_frp double, log_median_count double")
    best = series.regime_match(rows).filter("rank = 1").collect()
    assert len(best) == 8 and all(r.region == r.key and r.similarity == 1.0 for r in best)


#: Scaled power of a region and year -> energy, dry matter, CO2.
EMISSIONS = [(2616135.9014084507, 4709.0, 1050.1, 1.69), (36533386.085215814, 65760.1, 14664.5, 23.65), (35690449.93582613, 64242.8, 14326.1, 23.11), (38840817.43713605, 69913.5, 15590.7, 25.15)]


def test_emission_chain(spark):
    found = exports.emission_chain(spark.createDataFrame([(r[0],) for r in EMISSIONS], "frp_scaled_mw double")).collect()
    assert [(r.fre_tj, r.dry_matter_kt, r.co2_mt) for r in found] == [r[1:] for r in EMISSIONS]


def test_scalars(spark):
    one = spark.range(1).select(
        s.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"), s.short_number(F.lit(1234567.0)).alias("m"), s.short_number(F.lit(3400.0)).alias("k"), s.month_label(F.lit("2024-09")).alias("label"),
        s.next_month(F.lit("2024-12")).alias("next"), s.month_distance(F.lit(0), F.lit(11)).alias("circle"), s.elevation(F.lit(128), F.lit(10), F.lit(128)).alias("up"), s.bilinear(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.25), F.lit(0.5)).alias("bi"),
        s.tile_lon(s.tile_x(F.lit(10.0), 7), 7).alias("lon"), s.without_thoughts(F.lit("<think>a\nb</think> c")).alias("text"), s.json_part(F.lit('x {"a": {"b": 1}} y')).alias("json"), s.surface_temperature(F.lit(0)).alias("none"), s.surface_temperature(F.lit(15000)).alias("kelvin"),
        s.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("cos"), s.hour_bucket(F.lit("2530")).alias("bad"), s.sensor_of(F.lit("Terra"), F.lit("MODIS-Aqua")).alias("terra"), s.time_label(F.lit("45")).alias("time"),
        s.highest_verdict(F.lit("LOW"), F.lit("HIGH")).alias("worst"), s.geo_score(F.lit(None).cast("double")).alias("geo"), s.cos_lat(F.lit(89.0)).alias("cl"), s.tile_lat(F.lit(64), 7).alias("equator"),
    ).first()
    assert abs(one.km - 111.195) < 0.01 and (one.m, one.k, one.label, one.next, one.circle) == ("1.2M", "3.4k", "Sep 2024", "2025-01", 1)
    assert (one.up, one.bi, one.text, one.json, one.none, one.kelvin) == (10.5, 0.25, "c", '{"a": {"b": 1}}', None, 300.0)
    assert one.lon <= 10 < one.lon + 360 / 128 and abs(one.cos - 1) < 1e-8 and one.bad is None and one.terra == "MODIS-Terra"
    assert (one.time, one.worst, one.geo, one.cl, abs(one.equator) < 1e-9) == ("00:45 UTC", "HIGH", 0.25, 0.2, True)
    assert s.adaptive_eps(fixtures.BBOX) == 0.62 and len(REGIONS) == 9 and len(AOIS) == 6 and len(SEASON) == 12


def test_sql_functions(spark):
    s.register(spark)
    assert spark.sql("select burncal_frp_band(120d), burncal_cluster_class(40, 1d), burncal_threat_score(500d, 100d, true), round(burncal_haversine_km(0d,0d,0d,1d)), burncal_weather_score(42d,18d,53d,0d)").first()[:] == ("INTENSE FRONT", "ESTABLISHED", 100, 111.0, 100)


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("latitude,longitude,frp\n1,2,3\n4,5\n6,7,8,9\n")  # a short row goes, a long one stays
    assert sorted(r.lat for r in readers.read_detections_csv(spark, str(tmp_path / "s.csv")).collect()) == [1.0, 6.0]
    (tmp_path / "a.csv").write_text("Latitude,LONGITUDE,frp,confidence,daynight,satellite,acq_date,acq_time\n1.5,2.5,x,h,N,Terra,2024-01-02,345\n,2,3,n,D,Aqua,2024-01-02,0\n1,2,7.5,50,D,Aqua,bad,1230\n")
    rows = readers.read_detections_csv(spark, str(tmp_path / "a.csv"), "MODIS-Aqua").orderBy("frp").collect()
    assert [(r.lat, r.frp, r.night, r.day, r.acquired) for r in rows] == [(1.5, 0.0, True, dt.date(2024, 1, 2), "03:45 UTC"), (1.0, 7.5, False, None, "12:30 UTC")]
    point = {"lat": 1.0, "lon": 2.0, "frp": None, "conf": 60, "confRaw": "n", "night": None, "sat": "A", "acq": "01:00 UTC"}
    (tmp_path / "p.json").write_text(json.dumps({"days": {"2024-01-01": {"sensors": {"S": {"points": [point, point]}, "T": {"points": []}}}}}))
    assert [(r.sensor, r.seq, r.frp) for r in readers.read_product(spark, str(tmp_path / "p.json")).collect()] == [("S", 0, 0.0), ("S", 1, 0.0)]
    (tmp_path / "e.json").write_text(json.dumps({"events": [{"id": "1", "title": "t", "link": "l", "sources": [{"id": "x"}], "geometry": [{"date": "d", "coordinates": [1, 2]}, {"date": "e", "coordinates": [[[3.5, 4], [5, 6]]]}]}, {"id": "2", "title": "u", "geometry": []}]}))
    assert [(r.event_id, r.lon, r.lat) for r in readers.read_events(spark, str(tmp_path / "e.json")).orderBy("event_id").collect()] == [("1", 3.5, 4.0), ("2", None, None)]
    (tmp_path / "w.json").write_text(json.dumps({"daily": {"time": ["2024-01-01"], "temperature_2m_max": [30.5], "relative_humidity_2m_mean": [40], "wind_speed_10m_max": [9], "precipitation_sum": [None]}}))
    assert readers.read_weather(spark, str(tmp_path / "w.json")).first()[:] == (dt.date(2024, 1, 1), 30.5, 40.0, 9.0, 0.0)


def test_documents_round_trip(spark, tmp_path):
    rows = fixtures.calendar(spark, SF)
    exports.calendar_json(rows).select("document").write.text(str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 5
    fused = harmonize.outlook_fused(rows)
    exports.outlook_json(fused, series.season_outlook(fused, "2001-06"), series.peak_months(fused, "2001-06")).select("document").write.option("maxRecordsPerFile", 1).text(str(tmp_path / "o"))
    back = readers.read_outlook(spark, str(tmp_path / "o")).collect()
    ahead = [r for r in back if r.part == "forecast"]
    assert len(ahead) == 60 and all(r.lo <= r.mean <= r.hi for r in ahead) and sum(r.part == "history" for r in back) == 180


def test_tiles_and_days(spark):
    boxes = spark.createDataFrame([("a", -74.0, -12.0, -46.0, 2.0)], "key string, west double, south double, east double, north double")
    assert {(r.tx, r.ty) for r in readers.tile_cover(boxes).collect()} == {(x, y) for x in range(11, 15) for y in (9, 10, 11)}
    one = spark.sql("select date'2024-01-05' as d").select(readers.window_days(F.col("d"), F.lit(3)).alias("w"), readers.is_archive(F.col("d"), F.lit("2024-06-01").cast("date")).alias("old")).first()
    assert [x.day for x in one.w] == [3, 4, 5] and one.old
    rows = spark.createDataFrame([("s", dt.date(2024, 1, 4))], "sensor string, day date")
    asked = spark.createDataFrame([("s", dt.date(2024, 1, 5)), ("s", dt.date(2024, 1, 4)), ("s", dt.date(2024, 1, 9))], "sensor string, day date")
    assert sorted(r.asked.day for r in readers.previous_day_fallback(asked, rows).collect()) == [4, 5]


def test_smoothing_and_boxes(spark):
    grid = np.zeros((5, 9))
    grid[2, 4] = 3
    out = raster.smoothed(grid, 0.5)
    assert out.max() == 1 and np.allclose(out, out[:, ::-1]) and np.allclose(out, out[::-1])
    assert raster.footprint_forecast(points(spark, [(0.5, 0.5)] * 5).withColumn("frp", F.lit(1.0)), (0, 0, 1, 1)).count() == 0  # under 30 detections
    cells = raster.footprint_forecast(points(spark, [(0.52, 0.52)] * 40), (0, 0, 1, 1), threshold=0.0)
    assert raster.footprint_stats(cells, 1, 0.05, 0.5).first().overlap == 1


def test_tiles_of_boxes(spark, monkeypatch):
    """Boxes by raster and by comparison, over small tiles and large ones, against counting."""
    rng = np.random.RandomState(2)
    rows = [(float(x), float(y)) for x, y in rng.randint(0, 400, (300, 2)) / 100 + 0.005] + [(1.005, 1.005)] * 5
    frame = points(spark, rows)
    w, low = min(x for x, _ in rows) - 1.05, min(y for _, y in rows) - 1.05
    at = [(math.floor((x - w) / 0.01), math.floor((y - low) / 0.01)) for x, y in rows]
    factor = [math.pi * r * r / ((2 * k + 1) * 0.01) ** 2 for r, k in ((0.05, 5), (0.25, 25), (1.0, 100))]
    expected = [[round(f * sum(abs(a - i) <= k and abs(b - j) <= k for a, b in at), 6) for f, k in zip(factor, (5, 25, 100))] for i, j in at]
    for tile in (64, 512):
        monkeypatch.setattr(raster, "TILE", tile)
        found = sorted(map(tuple, raster.box_counts(frame).collect()))
        assert [[round(v, 6) for v in r[1:]] for r in found] == expected


def test_picks_and_limits(spark):
    rows = spark.createDataFrame([("r", f"T{k}", k % 3 + 1, float(k)) for k in range(12)], "region string, track_id string, days_seen int, latest_frp double")
    assert [r.track_id for r in track.track_picks(rows, 2, 3).orderBy("rank").collect()] == ["T11", "T10", "T8"]
    cells = spark.createDataFrame([(DAY, k, 0, 1 - k / 10, k % 2 == 0) for k in range(6)], "day date, i int, j int, p double, actual boolean")
    best = raster.forecast_cells(cells, 4)
    assert sorted(r.i for r in best.collect()) == [0, 1, 2, 3] and raster.hit_share(best, 3).first()[1:] == (3, 2, 67)


def test_ranking_and_class_metrics(spark):
    rng = np.random.RandomState(7)
    rows = [(int(y), float(p)) for y, p in zip(rng.randint(0, 2, 200), rng.randint(0, 30, 200) / 30)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    said = lambda t: [y for y, p in rows if p >= t]
    steps = [(sum(said(t)), len(said(t))) for t in sorted({p for _, p in rows}, reverse=True)]
    ap = sum((a - b) * a / n for (a, n), b in zip(steps, [0, *(a for a, _ in steps)])) / len(pos)
    found = models.ranking_metrics(spark.createDataFrame(rows, "y int, p double").repartition(5)).first()
    assert (found.n, found.positives) == (200, len(pos)) and abs(found.auc - auc) < 1e-9 and abs(found.ap - ap) < 1e-9
    classes = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, s string")
    one = models.class_metrics(classes, "t", "s").first()
    assert (one.n, one.accuracy) == (4, 0.5) and abs(one.macro_f1 - (0.5 + 2 / 3 + 0) / 3) < 1e-12


def test_forest_scores_are_means_of_trees(spark):
    rows = fixtures.detections(spark, SF).filter("pt_seq < 400")
    features = models.classifier_features(rows, cluster.density_features(rows)).cache()
    fitted = models.train_classifier(features.join(cluster.weak_labels(rows, 0.3, 3), "pt_seq"), trees=4, depth=3)
    scores = {r.pt_seq: r for r in models.forest_scores(fitted, features).collect()}
    vectors = {r.pt_seq: r.features for r in fitted.stages[1].transform(features).collect()}
    for pt_seq, v in list(vectors.items())[:40]:
        each = [t.predictProbability(v).toArray() for t in fitted.stages[2].trees]
        mean = np.mean(each, 0)
        assert scores[pt_seq].p == math.floor(mean.max() * 1000 + 0.5) / 1000 and mean[fitted.stages[0].labels.index(scores[pt_seq].behavior)] == mean.max()


def test_rules_of_answers(spark):
    asked = ["When is the peak", "anything strange?", "compare the sensors", "which type", "the next months", "hello", None]
    found = triage.intent(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, question string")).orderBy("i").collect()
    assert [r.intent for r in found] == ["season", "anomaly", "sensors", "regime", "outlook", "snapshot", "snapshot"]
    answers = ['x NAVIGATE: {"region": "congo", "date": "2024-01-02"} y', "NAVIGATE: {broken}", "none", None]
    found = triage.navigation(spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")).orderBy("i").collect()
    assert [(r.region, r.date) for r in found] == [("congo", "2024-01-02"), (None, None), (None, None), (None, None)]
    twice = spark.createDataFrame([("r", s_, "2000-01", e, e, q) for q, (s_, e) in enumerate([("MODIS-Terra", 5), ("MODIS-Terra", 9), ("VIIRS-SNPP", 40), ("VIIRS-SNPP", 30)])], "region string, sensor string, ym string, est long, frp long, seq int")
    assert harmonize.paired(twice).first()[2:] == (5, 5, 30, 30)


def test_models(spark):
    rows = fixtures.detections(spark, SF)
    features = models.classifier_features(rows, cluster.density_features(rows))
    labelled = features.join(cluster.weak_labels(rows), "pt_seq")
    model = models.train_classifier(labelled, trees=5, depth=4)
    assert model.transform(labelled).filter("prediction is not null").count() == labelled.count()
    assert models.regimes(features, ["log_frp", "conf", "hour"], k=3).select("regime").distinct().count() == 3
    months = harmonize.lag_features(fixtures.calendar(spark, SF)).join(harmonize.extreme_months(fixtures.calendar(spark, SF), 1999, 0.5), ["region", "ym"])
    fitted = models.train_logistic(months, ["est_lag1", "est_lag12", "hic_lag1", "night_lag1"])
    scored = fitted.transform(months).select("y", F.element_at(vector_to_array("probability"), 2).alias("p"))
    m = models.binary_metrics(scored).first()
    assert 0 <= m.brier <= 1 and 0 <= m.accuracy <= 1


def _field(number, value):
    """One protocol-buffer field with a short value."""
    return bytes([number << 3 | 2, len(value)]) + value


def test_tiles(spark, tmp_path):
    import gzip
    import struct

    from burncal.sources.tiles import attributes, read_tiles

    values = [_field(1, b"N"), bytes([2 << 3 | 5]) + struct.pack("<f", 1.5), bytes([5 << 3, 70])]
    layer = b"".join(_field(3, k) for k in (b"DAYNIGHT", b"LATITUDE", b"CONFIDENCE")) + b"".join(_field(4, v) for v in values) + _field(2, _field(2, bytes([0, 0, 1, 1, 2, 2]))) + _field(2, _field(2, bytes([1, 1])))
    tile = _field(3, layer)
    assert attributes(tile) == [{"DAYNIGHT": "N", "LATITUDE": 1.5, "CONFIDENCE": 70}, {"LATITUDE": 1.5}] and attributes(b"") == []
    (tmp_path / "a.pbf").write_bytes(gzip.compress(tile))
    (tmp_path / "b.pbf").write_bytes(b"")
    assert [(r.lat, r.conf_raw, r.night, r.frp) for r in read_tiles(spark, str(tmp_path), "*.pbf").collect()] == [(1.5, "70", True, 0.0), (1.5, None, False, 0.0)]


def test_selections(spark):
    from burncal.operators import selections as sel

    assert sel.area_of_corners(3, 4, 1, 2.123) == (1, 2.12, 3, 4) and sel.area_of_corners(0, 0, 0.4, 9) is None
    place = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0, 0.5, 0.5), (0.0, 50.0, 0.0, 50.0, 10.0, 20.0)], "south double, north double, west double, east double, lon double, lat double")
    assert [r.bbox for r in sel.area_of_place(place).collect()] == [[0, 0, 1, 1], [7.75, 18, 12.25, 22]]
    ring = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    assert spark.range(1).select(sel.inside_ring(F.lit(1.0), F.lit(1.0), ring), sel.inside_ring(F.lit(3.0), F.lit(1.0), ring)).first()[:] == (True, False)
    hulls = spark.createDataFrame([(DAY, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])], "day date, hull array<array<double>>")
    assert sel.cells_in_hulls(hulls, (0, 0, 2, 2), 0.5).count() == 4
    rows = fixtures.detections(spark, SF)
    train, test = sel.split_by_last_day(rows)
    assert train.count() + test.count() == rows.count() and sel.seeded_sample(rows, 7).collect() == sel.seeded_sample(rows.repartition(5), 7).collect()
    assert "night overpass" in " ".join(r.question for r in sel.detection_questions(rows, "amazon").collect())


def test_footprint_training(spark):
    rows = fixtures.detections(spark, SF)
    cells = raster.training_cells(rows, fixtures.BBOX, cell=0.5).cache()
    features = [*raster.LAYERS, "x", "y"]
    fitted, scored = models.train_footprint(cells, features)
    weights = models.linear_weights(fitted)
    assert weights["features"] == features and len(weights["coef"]) == len(features)
    m, base = models.binary_metrics(scored, "label").first(), models.binary_metrics(scored, "label", "persistence").first()
    assert 0 < m.iou <= 1 and 0 <= base.iou <= 1
    assert -1 <= models.silhouette(cells.limit(300), ["x", "y"], 3) <= 1 and -1 <= models.silhouette(cells, ["x", "y"], 3, sample=200) <= 1


def test_footprint_labels_of_hulls_and_nodes(spark, tmp_path):
    rows = fixtures.detections(spark, SF)
    hulls = cluster.cluster_hulls(cluster.labelled(rows, 0.62, 3))
    inside = selections.cells_in_hulls(hulls, fixtures.BBOX, 0.5)
    cells = raster.training_cells(rows, fixtures.BBOX, cell=0.5, inside=inside).cache()
    want = {(r.day, r.i, r.j) for r in inside.collect()}
    assert all(r.label == ((r.target, r.i, r.j) in want) for r in cells.select("target", "i", "j", "label").collect()) and cells.filter("label = 1").count() > 0
    features = [*raster.LAYERS, "x", "y"]
    _, scored = models.train_footprint(cells, features, boosted=False)
    assert scored.filter("persistence = 1").count() > 0
    fitted = models.train_boosted(cells, features, rounds=2, depth=2)
    assert fitted.transform(cells).filter("prediction is null").count() == 0
    fitted.stages[1].write().save(str(tmp_path / "m"))
    nodes = forest.node_table(spark, str(tmp_path / "m")).orderBy("tree", "node").collect()
    trees = {t: {r.node: r for r in nodes if r.tree == t} for t in {r.tree for r in nodes}}
    assert len(trees) == 2 and all((r.feature < 0) == (r.threshold is None) and (r.feature < 0 or {r.left, r.right} <= trees[r.tree].keys()) for r in nodes)
