"""Tracks by components against one walk over all clusters of an area."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from burncal.operators import cluster, track

DAY = dt.date(2024, 1, 1)
COLUMNS = "region string, day date, label int, n long, frp_sum double, c_lon double, c_lat double, class string"


def whole(rows, gap, same_day):
    """All tracks of each region from one walk, numbered as they begin."""
    out = []
    for region in sorted({r[0] for r in rows}):
        area = pd.DataFrame([r[1:] for r in rows if r[0] == region], columns=["day", "label", "n", "frp_sum", "c_lon", "c_lat", "cls"])
        for k, t in enumerate(track.follow(area, gap, same_day)):
            if t["latest_frp"] > 0:
                out.append((region, f"SYS-{k + 1:03d}", t["first_day"], t["last_day"], t["days_seen"], t["latest_class"], t["peak_frp"], t["latest_frp"], t["frp_trend"], t["latest_n"], t["trail"]))
    return sorted(out)


def some(seed, n, width, regions=2, days=9):
    """Clusters with ties of power, clusters without any, and some at one place."""
    rng = np.random.default_rng(seed)
    label: dict = {}
    rows = []
    for _ in range(n):
        region, day = f"r{rng.integers(regions)}", DAY + dt.timedelta(days=int(rng.integers(days)))
        label[region, day] = label.get((region, day), 0) + 1
        lon, lat = (rng.integers(0, 5, 2) / 4 if rng.random() < 0.3 else rng.uniform(0, width, 2)) + [178.5, -0.5]
        rows.append((region, day, label[region, day], int(rng.integers(1, 99)), float(rng.integers(0, 6)) * 10, float(np.round(lon, 4)), float(np.round(lat, 4)), "EMERGING"))
    return rows


@pytest.mark.parametrize("seed, n, width, gap, same_day", [(1, 150, 12, 60.0, False), (2, 150, 12, 60.0, True), (3, 80, 60, 200.0, False), (4, 120, 2, 25.0, False)])
def test_components_give_the_same_tracks(spark, seed, n, width, gap, same_day):
    rows = some(seed, n, width)
    found = track.tracks(spark.createDataFrame(rows, COLUMNS).repartition(3), gap, same_day).collect()
    assert sorted(tuple(r) for r in found) == whole(rows, gap, same_day)


def test_components_over_cells(spark, monkeypatch):
    """Areas too large for one task are linked on Spark."""
    rows = some(5, 90, 8, regions=1)
    frame = spark.createDataFrame(rows, COLUMNS)
    small = {tuple(r[:3]): r.component for r in track.linked(frame, 60.0).select("region", "day", "label", "component").collect()}
    monkeypatch.setattr(track.cluster, "labelled", lambda points, eps, min_pts, scene, dims: cluster.dbscan(points, eps, min_pts, scene, dims))
    large = {tuple(r[:3]): r.component for r in track.linked(frame, 60.0).select("region", "day", "label", "component").collect()}
    same = lambda found: {frozenset(k for k, c in found.items() if c == v) for v in set(found.values())}
    assert same(small) == same(large) and len(same(small)) > 3


def test_links_cross_the_date_line(spark):
    rows = [("r", DAY, 1, 1, 5.0, 179.9, 0.0, "X"), ("r", DAY + dt.timedelta(days=1), 1, 1, 6.0, -179.9, 0.0, "X"), ("r", DAY, 2, 1, 4.0, 0.0, 89.9, "X"), ("r", DAY + dt.timedelta(days=2), 1, 1, 7.0, 180.0, 89.9, "X")]
    found = track.tracks(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.track_id, r.days_seen) for r in found) == [("SYS-001", 2), ("SYS-002", 2)]


def test_no_clusters(spark):
    assert track.tracks(spark.createDataFrame([], COLUMNS)).count() == 0
