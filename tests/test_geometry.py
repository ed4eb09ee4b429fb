"""Neighbour counts and labels of scenes against all pairs, and that dense places cost their rims only."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burncal.operators import cluster, pyramid, scenes
from burncal.sources.fixtures import detections
from tests.conftest import SF

DAY = dt.date(2024, 1, 1)


def plain_labels(x, eps, min_pts):
    """Component (first core point) and label, from all distances."""
    n = len(x)
    near = [[j for j in range(n) if sum((x[i][k] - x[j][k]) ** 2 for k in range(x.shape[1])) <= eps * eps] for i in range(n)]
    core = [len(m) >= min_pts for m in near]
    first = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near[i] if core[i] else ():
                if core[j] and first[j] < first[i]:
                    first[i], changed = first[j], True
    component = [first[i] if core[i] else min((first[j] for j in near[i] if core[j]), default=-1) for i in range(n)]
    order = {c: k + 1 for k, c in enumerate(sorted(set(component) - {-1}))}
    return component, [order.get(c, 0) for c in component]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 50), st.integers(1, 3), st.integers(1, 6), st.sampled_from([0.25, 0.3, 0.5, 1.0]), st.booleans())
def test_labels(seed, n, d, min_pts, eps, coarse):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (n, d)) / 4 if coarse else rng.normal(size=(n, d))
    component, label = scenes.label_scene(x, eps, min_pts)
    assert (component.tolist(), label.tolist()) == plain_labels(x, eps, min_pts)


def test_labels_of_far_places():
    """Cells too many for one number."""
    x = np.concatenate([np.random.default_rng(1).uniform(-1e13, 1e13, (40, 3))] * 3)
    component, label = scenes.label_scene(x, 0.001, 3)
    assert component.tolist() == [*range(40)] * 3 and label.tolist() == [*range(1, 41)] * 3


@pytest.mark.parametrize("gap, few", [(0.4999, 4096), (0.5001, 4096), (0.4999, 1), (0.5001, 1)])
def test_dense_cells_that_almost_meet(monkeypatch, gap, few):
    """Two columns of points that face each other at about eps: linked if and only if two points are."""
    monkeypatch.setattr(scenes, "FEW", few)
    y = np.random.default_rng(2).uniform(0, 0.3, 400)
    x = np.concatenate([np.stack([np.zeros(400), y], 1), np.stack([np.full(400, gap), y[::-1]], 1)])
    assert scenes.label_scene(x, 0.5, 3)[1].max() == (1 if gap < 0.5 else 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 60))
def test_meet(seed, n, m):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 9, (n, 2)) / 4, rng.integers(0, 9, (m, 2)) / 4 + rng.integers(0, 3, 2)
    few, scenes.FEW = scenes.FEW, 4
    try:
        assert scenes.meet(a, b, 0.75) == bool(((a[:, None] - b) ** 2).sum(-1).min() <= 0.75**2)
    finally:
        scenes.FEW = few


def test_products():
    sizes = np.array([3, 0, 500, 1]), np.array([2, 9, 40, 0])
    for most in (1, 7, 1 << 20):
        found = [t for chunk in scenes.products(*sizes, most) for t in zip(*(c.tolist() for c in chunk))]
        assert found == [(k, i, j) for k, (n, m) in enumerate(zip(*sizes)) for i in range(n) for j in range(m)]


@pytest.mark.parametrize("kind", ["ball", "place", "wide", "line"])
def test_fifty_thousand_points(kind):
    rng = np.random.default_rng(0)
    x = {"ball": rng.normal(size=(50_000, 2)) * 0.1, "place": np.zeros((50_000, 2)), "wide": rng.uniform(0, 30, (50_000, 2)), "line": np.stack([rng.uniform(0, 3, 50_000), np.zeros(50_000)], 1)}[kind]
    began = time.perf_counter()
    scenes.label_scene(x, 0.62, 3)
    assert time.perf_counter() - began < 2


def counted(rows, radii):
    x, day = np.array([r[2:4] for r in rows], float).reshape(-1, 2), np.array([r[1] for r in rows])
    return {r[0]: tuple(int(((((x - x[i]) * (x - x[i])).sum(1) <= k * k) & (day == day[i])).sum()) for k in radii) for i, r in enumerate(rows)}


@pytest.mark.parametrize("tested", [4, 10**6])
def test_radius_counts(spark, tested):
    """Ties at just the radius, many points at one place, a hot cell, two scenes, negative places."""
    rng = np.random.default_rng(4)
    places = [*(rng.integers(-8, 9, (150, 2)) / 4), *(rng.normal(size=(200, 2)) * 0.01), *([[0.25, -0.5]] * 80), *(rng.uniform(-3, 3, (100, 2)))]
    rows = [(i, DAY + dt.timedelta(days=int(i % 3 == 0)), float(a), float(b)) for i, (a, b) in enumerate(places)]
    frame = spark.createDataFrame(rows, "pt_seq long, day date, lon double, lat double")
    radii = [0.05, 0.25, 1.0]
    found = {r.pt_seq: (r.n_0, r.n_1, r.n_2) for r in pyramid.radius_counts(frame, radii, tested=tested).collect()}
    assert found == counted(rows, radii)


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 90), st.integers(1, 3), st.booleans())
def test_counts_of_a_scene(seed, n, d, coarse):
    rng = np.random.default_rng(seed)
    x = rng.integers(-5, 6, (n, d)) / 4 if coarse else rng.normal(size=(n, d))
    radii = [0.25, 0.3, 1.0]
    expected = [[int((scenes.squared(x - p) <= r * r).sum()) for r in radii] for p in x]
    assert scenes.count_scene(x, radii).tolist() == expected


@pytest.mark.parametrize("kind", ["ball", "place", "wide", "rim"])
def test_counts_of_many_points(kind):
    """Twenty thousand points, in one place, in a ball, spread, and in two balls a radius apart."""
    rng = np.random.default_rng(0)
    ball = rng.normal(size=(20_000, 2)) * 0.1
    x = {"ball": ball, "place": np.zeros((20_000, 2)), "wide": rng.uniform(0, 30, (20_000, 2)), "rim": ball + np.array([1.0, 0]) * (np.arange(20_000) % 2)[:, None]}[kind]
    began = time.perf_counter()
    found = scenes.count_scene(x, [0.05, 0.25, 1.0])
    assert time.perf_counter() - began < 8
    for i in range(0, 20_000, 2500):
        assert found[i].tolist() == [int((scenes.squared(x - x[i]) <= r * r).sum()) for r in (0.05, 0.25, 1.0)]


def test_small_and_large_scenes_count_alike(spark):
    points = detections(spark, SF)
    found = {most: sorted(map(tuple, cluster.density_features(points, most=most).collect())) for most in (20_000, 35, 0)}
    assert found[20_000] == found[35] == found[0] and len(found[0]) == 1000


def test_radius_counts_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, DAY, None, 1.0), (2, DAY, 1.0, 1.0), (3, None, 1.0, 1.0)], "pt_seq long, day date, lon double, lat double")
    assert {r.pt_seq: r.n for r in cluster.neighbor_counts(frame, 0.5).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.pt_seq: r.n_0 for r in pyramid.radius_counts(frame, [0.5]).collect()} == {1: 0, 2: 1, 3: 0}
    assert pyramid.radius_counts(frame.limit(0), [0.5]).count() == 0
    wide = spark.createDataFrame([(i, 0, float(i % 4), float(i // 4), 0.5) for i in range(16)], "pt_seq long, s int, x double, y double, z double")
    assert {r.n_0 for r in pyramid.radius_counts(wide, [1.0], ("s",), ("x", "y", "z")).collect()} == {3, 4, 5}


def test_a_hot_cell_costs_its_rim(spark):
    """Four times the points in one cell: the pairs that are compared or judged stay far under the square."""
    rng = np.random.default_rng(7)
    work = []
    for n in (500, 2000):
        rows = [(i, DAY, *map(float, rng.uniform(0, 0.5, 2))) for i in range(n)]
        work.append(pyramid.Work())
        pyramid.radius_counts(spark.createDataFrame(rows, "pt_seq long, day date, lon double, lat double"), [1.0], work=work[-1]).collect()
    assert work[1].judged + work[1].compared < 0.01 * 2000**2


def test_fewer_pairs_than_all_of_touching_cells(spark):
    points, work = detections(spark, SF.replace("0.001", "0.01")), pyramid.Work()
    pyramid.radius_counts(points, [0.05, 0.25, 1.0], work=work)
    cells = {}
    for r in points.select("day", "lon", "lat").collect():
        cells[r.day, int(r.lon // 1), int(r.lat // 1)] = cells.get((r.day, int(r.lon // 1), int(r.lat // 1)), 0) + 1
    whole = sum(n * cells.get((day, i + a, j + b), 0) for (day, i, j), n in cells.items() for a in (-1, 0, 1) for b in (-1, 0, 1))
    assert work.compared < 0.25 * whole  # the share falls as scenes get denser: 0.06 of those of ten times the points


def scattered(n, d, seed, coarse):
    """Places in lumps with some between, many of them more than once."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(rng.uniform(-3, 3, d), 0.4, (n // 8, d)) for _ in range(4)] + [rng.uniform(-4, 4, (n // 2, d))])
    return np.round(x * 4) / 4 if coarse else np.concatenate([x, x[: n // 4]])


@pytest.mark.parametrize("d, coarse, min_pts", [(1, False, 4), (2, False, 4), (2, True, 6), (3, False, 3), (3, True, 8)])
def test_tiles_of_large_scenes(spark, d, coarse, min_pts):
    """Tiles give the labels and the counts of whole scenes, also where clusters cross many tiles and border places lie between components; scenes with a tile that is
    too full for a task are labelled and counted on Spark, with the same rows."""
    dims, eps = ("x", "y", "z")[:d], {1: 0.01, 2: 0.25, 3: 0.5}[d]
    rows = [(k * 1000 + i, k, *map(float, p)) for k in (1, 2) for i, p in enumerate(scattered(400, d, k, coarse))]
    frame = spark.createDataFrame(rows, "pt_seq long, s int, " + ", ".join(f"{c} double" for c in dims))
    whole = sorted((r.pt_seq, r.component, r.label) for r in cluster.dbscan_scenes(frame, eps, min_pts, ("s",), dims).collect())
    assert max(r[2] or 0 for r in whole) > 2
    for most in (10**6, 20):
        assert sorted((r.pt_seq, r.component, r.label) for r in cluster.dbscan_tiles(frame, eps, min_pts, ("s",), dims, most, (8,)).collect()) == whole
        radii = [eps / 2, eps]
        counts = sorted((r.pt_seq, r.n_0, r.n_1) for r in cluster.counted_tiles(frame, radii, ("s",), dims, most, (2,)).collect())
        x = {k: np.array([r[2:] for r in rows if r[1] == k]) for k in (1, 2)}
        plain = {k: [(scenes.squared(x[k][:, None] - x[k][None]) <= q * q).sum(1) for q in radii] for k in (1, 2)}
        assert counts == [(r[0], int(plain[r[1]][0][r[0] % 1000]), int(plain[r[1]][1][r[0] % 1000])) for r in sorted(rows)]


def test_tile_work_of_labels(spark, monkeypatch):
    """A scene over the limit is labelled by tiles, each place in a few of them, and not over pairs of points on Spark."""
    monkeypatch.setattr(cluster, "dbscan", None)
    points = detections(spark, SF).withColumn("day", cluster.F.lit(DAY))
    found = {most: sorted((r.pt_seq, r.component, r.label) for r in cluster.labelled(points, 0.62, 3, most=most).collect()) for most in (10, 10**6)}
    assert found[10] == found[10**6]


def dense(n, d, seed, gap):
    """Boxes full of points, about `gap` apart, a thin mist around them, and strays at about that distance."""
    rng = np.random.default_rng(seed)
    full = [rng.uniform(0, 1, (n, d)) + np.eye(d)[0] * k * (1 + gap * rng.uniform(0.97, 1.03)) for k in range(3)]
    mist = rng.uniform(-1, 4.5, (n // 20, d))
    rim = np.concatenate([f[rng.integers(0, n, 20)] + rng.choice([-1, 1], (20, d)) * gap * rng.uniform(0.5, 1.2, (20, d)) for f in full])
    return rng.permutation(np.concatenate([*full, mist, rim]))


@pytest.mark.parametrize("d, n, eps, min_pts, most", [(2, 4000, 0.15, 6, 2500), (2, 4000, 0.15, 20, 2500), (3, 5000, 0.3, 6, 4000), (3, 1500, 0.3, 25, 4000)])
def test_dense_tiles(spark, monkeypatch, d, n, eps, min_pts, most):
    """Places of crowded cells don't all go to tiles, so no tile is too full, and labels are those of whole scenes."""
    monkeypatch.setattr(cluster, "dbscan", None)
    dims = ("x", "y", "z")[:d]
    rows = [(k * 100_000 + i, k, *map(float, p)) for k in (1, 2, 3) for i, p in enumerate(dense(n, d, k, eps))]
    frame = spark.createDataFrame(rows, "pt_seq long, s int, " + ", ".join(f"{c} double" for c in dims)).repartition(5)
    whole = sorted((r.pt_seq, r.component, r.label) for r in cluster.dbscan_scenes(frame, eps, min_pts, ("s",), dims).collect() if r.label)
    found = sorted((r.pt_seq, r.component, r.label) for r in cluster.dbscan_tiles(frame, eps, min_pts, ("s",), dims, most, (8,)).collect() if r.label)
    assert len({r[1] for r in whole}) >= 3
    assert found == whole


def test_boxes_that_leave_labels_open():
    """Labels of boxes, each by one place but where all places are asked for, are those of the places."""
    for seed in range(60):
        rng = np.random.default_rng(seed)
        d, min_pts, eps = 1 + seed % 3, int(rng.integers(2, 12)), 0.25
        x = dense(int(rng.integers(30, 200)), d, seed, eps)
        half = np.floor(x / scenes.side_of(eps, d) * 2)
        _, of = np.unique(half, axis=0, return_inverse=True)
        of = of.ravel()
        first, n = np.full(of.max() + 1, len(x)), np.bincount(of)
        np.minimum.at(first, of, np.arange(len(x)))
        low = np.where((n == 1)[:, None], x[first], half[first] * scenes.side_of(eps, d) / 2)
        high = np.where((n == 1)[:, None], x[first], (half[first] + 1) * scenes.side_of(eps, d) / 2)
        asked = scenes.unsure_boxes(x[first], low, high, n, eps, min_pts)
        kept = np.flatnonzero(asked[of] | (first[of] == np.arange(len(x))))
        everywhere = np.full(d, -(10**6)), np.full(d, 10**6)
        place, root, _, _ = scenes.label_tile(x[kept], np.where(asked[of[kept]], 1, n[of[kept]]), eps, min_pts, *everywhere)
        least = np.full(len(x), len(x))
        np.minimum.at(least, kept[place], kept[root])
        least = np.where(asked[of], least, least[first[of]])
        component = scenes.label_scene(x, eps, min_pts)[0]
        assert np.array_equal(np.where(component < 0, len(x), component), least)


def test_counts_of_crowded_tiles(spark, monkeypatch):
    """A crowded place is counted tile by tile, not over pairs of cells on Spark, and points without a place have counts of 0."""
    monkeypatch.setattr(cluster, "radius_counts", None)
    n, radii = 150_000, (0.01, 0.3)
    frame = spark.range(n).selectExpr("id as pt_seq", "date'2024-01-01' as day", "(id * 7919 % 149993) / 149993D as lon", "(id * 104729 % 149971) / 149971D as lat")
    odd = spark.createDataFrame([(n, DAY, None, 1.0), (n + 1, None, 0.5, 0.5), (n + 2, DAY, float("nan"), 0.5)], "pt_seq long, day date, lon double, lat double")
    found = {r.pt_seq: (r.dens_0, r.dens_1) for r in cluster.density_features(frame.unionByName(odd), radii).collect()}
    ids = np.arange(n)
    x = np.stack([ids * 7919 % 149993 / 149993, ids * 104729 % 149971 / 149971], 1)
    assert len(found) == n + 3 and all(found[n + k] == (0, 0) for k in range(3))
    for i in range(0, n, 3001):
        assert found[i] == tuple(int((scenes.squared(x - x[i]) <= r * r).sum()) for r in radii)


def test_counts_in_turns(monkeypatch):
    """Pairs of nodes are judged a bounded number at a time."""
    x = scattered(300, 2, 3, False)
    expected = np.stack([(scenes.squared(x[:, None] - x[None]) <= r * r).sum(1) for r in (0.05, 0.5)], 1)
    monkeypatch.setattr(scenes, "PAIRS", 40)
    most, gap = [], scenes.box_gap
    monkeypatch.setattr(scenes, "box_gap", lambda *boxes: most.append(len(boxes[0])) or gap(*boxes))
    assert np.array_equal(scenes.count_scene(x, (0.05, 0.5)), expected) and max(most) <= 40
