"""Rasters by tiles against the whole raster."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from burncal.functions.constants import FOOTPRINT_MODEL
from burncal.operators import raster

DAY = dt.date(2024, 9, 17)
COLUMNS = "pt_seq long, day date, lon double, lat double, frp double"


def some(n=400, seed=3, days=6):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        lon, lat = rng.normal([1.2, 0.9], 0.3) if k % 3 else rng.uniform(-0.3, 3.3, 2)
        out.append((k, DAY - dt.timedelta(days=int(rng.integers(days))), float(lon), float(lat), float(np.round(rng.gamma(1, 20), 1))))
    return out


def whole(rows, box, threshold, alias=False, model=FOOTPRINT_MODEL):
    """The forecast from one raster of the whole area, by numpy's own padding."""
    west, south, east, north = box
    cell = max(0.05, float(f"{max(east - west, north - south, 0.5) / 560:.4f}"))
    wide, high = math.ceil((east - west) / cell) + 1, math.ceil((north - south) / cell) + 1
    frame = pd.DataFrame(rows, columns=["pt_seq", "day", "lon", "lat", "frp"])
    days = sorted(frame["day"].unique())[-5:]
    frame = frame[frame["day"].isin(days)]
    frame["i"], frame["j"] = np.floor((frame["lon"] - west) / cell).astype(int), np.floor((frame["lat"] - south) / cell).astype(int)
    frame = frame[frame["i"].between(0, wide - 1) & frame["j"].between(0, high - 1)]
    if len(frame) < 30:
        return {}

    def grid(part, weights=None):
        out = np.zeros((high, wide))
        np.add.at(out, (part["j"], part["i"]), 1.0 if weights is None else part[weights])
        return out

    last = frame if alias else frame[frame["day"] == days[-1]]
    before = frame[frame["day"] == days[-2 if len(days) > 1 else -1]]
    layers = [raster.smoothed(grid(frame), s / cell) for s in (0.1, 0.35, 0.8)] + [raster.smoothed(grid(frame, "frp"), 0.35 / cell), raster.smoothed(grid(last), 0.35 / cell), raster.smoothed(grid(before), 0.35 / cell)]
    angle = 2 * math.pi * (pd.Timestamp(days[-1]) + pd.Timedelta(days=1)).dayofyear / 365
    x, y = np.meshgrid((np.arange(wide) + 0.5) * cell / (east - west), (np.arange(high) + 0.5) * cell / (north - south))
    features = [np.log1p(v) for v in layers] + [x, y, np.full_like(x, math.sin(angle)), np.full_like(x, math.cos(angle))]
    z = model["intercept"] + sum(c * (f - m) / s for f, m, s, c in zip(features, model["mean"], model["scale"], model["coef"]))
    p = 1 / (1 + np.exp(-z))
    return {(i, j): (p[j, i], bool(grid(last)[j, i])) for j in range(high) for i in range(wide) if p[j, i] >= threshold}


@pytest.mark.parametrize("tile, alias", [(7, False), (16, True), (1000, False)])
def test_tiles_equal_the_whole(spark, tile, alias):
    rows, areas = some(), {"large": (0.0, 0.0, 3.0, 2.0), "small": (1.0, 0.5, 1.6, 1.3), "empty": (50.0, 50.0, 51.0, 51.0)}
    found = raster.footprint_forecast(spark.createDataFrame(rows, COLUMNS), areas, alias, 0.2, tile=tile).collect()
    for area, box in areas.items():
        expected = whole(rows, box, 0.2, alias)
        own = {(r.i, r.j): (r.p, r.actual) for r in found if r.area == area}
        assert own.keys() == expected.keys() and (own or area == "empty")
        assert all(abs(own[k][0] - expected[k][0]) <= 0.0005 + 1e-9 and own[k][1] == expected[k][1] for k in own)
    assert {r.day for r in found} == {DAY + dt.timedelta(days=1)}


@pytest.mark.parametrize("edge", ["edge", "reflect"])
@pytest.mark.parametrize("tile", [5, 32])
def test_layers(edge, tile):
    """All layers of all tiles to 1e-9, with a Gaussian that is wider than the raster."""
    rng = np.random.default_rng(1)
    grid = raster.Grid(0, 0, 2, 1, 0.05, 41, 21)
    cells = pd.DataFrame({"i": rng.integers(0, 41, 90), "j": rng.integers(0, 21, 90)} | {c: rng.uniform(0, 5, 90) for c in ("n", "frp", "last", "before")})
    for k, (column, width) in enumerate(raster.WIDTHS):
        full = np.zeros((21, 41))
        np.add.at(full, (cells["j"], cells["i"]), cells[column])
        expected = raster.smoothed(full, width / 0.05, edge)
        got = np.zeros((21, 41))
        for ti in range(-(-41 // tile)):
            for tj in range(-(-21 // tile)):
                near = cells[cells["i"].between(ti * tile - grid.reach, (ti + 1) * tile + grid.reach) & cells["j"].between(tj * tile - grid.reach, (tj + 1) * tile + grid.reach)]
                part = raster.tile_layers(near, grid, ti, tj, edge, tile)[k]
                got[tj * tile : tj * tile + part.shape[0], ti * tile : ti * tile + part.shape[1]] = part
        assert np.abs(got / got.max() - expected).max() < 1e-9


def test_season_counts(spark):
    """The same detections half a year away from the model's season: nothing is forecast."""
    rows = [(k, dt.date(2024, 3, 1), 0.5 + k % 5 / 50, 0.5, 30.0) for k in range(60)]
    frame = spark.createDataFrame(rows, COLUMNS)
    assert raster.footprint_forecast(frame, (0, 0, 1, 1)).count() == 0
    autumn = spark.createDataFrame([(k, DAY, *r) for k, _, *r in rows], COLUMNS)
    assert raster.footprint_forecast(autumn, (0, 0, 1, 1)).count() > 0


def test_training_by_tiles(spark):
    rows = spark.createDataFrame(some(days=9), COLUMNS)
    frames = [raster.training_cells(rows, (0, 0, 3, 2), tile=t).toPandas().sort_values(["target", "i", "j"]).reset_index(drop=True) for t in (9, 500)]
    pd.testing.assert_frame_equal(*frames, rtol=1e-9)
    assert len(frames[0]) and set(frames[0]["label"]) == {0, 1}


def test_stats_of_areas(spark):
    rows, areas = some(), {"large": (0.0, 0.0, 3.0, 2.0), "small": (1.0, 0.5, 1.6, 1.3)}
    points = spark.createDataFrame(rows, COLUMNS)
    cells = raster.footprint_forecast(points, areas)
    found = {r.area: r for r in raster.forecast_stats(points, cells, areas).collect()}
    for area, box in areas.items():
        own = [r for r in cells.collect() if r.area == area]
        active = len({(math.floor((lon - box[0]) / 0.05), math.floor((lat - box[1]) / 0.05)) for _, day, lon, lat, _ in rows if day == max(r[1] for r in rows) and 0 <= (lon - box[0]) / 0.05 < math.ceil((box[2] - box[0]) / 0.05) + 1 and 0 <= (lat - box[1]) / 0.05 < math.ceil((box[3] - box[1]) / 0.05) + 1})
        overlap = sum(r.actual for r in own)
        assert (found[area].predicted, found[area].active, found[area].overlap) == (len(own), active, overlap)
        assert abs(found[area].iou - overlap / (len(own) + active - overlap)) < 1e-12


def test_forecasts_of_large_counts(spark):
    """Counts in the millions: the forecast is that of the SQL's plain least squares, to the last detection."""
    import duckdb
    import numpy as np
    import pandas as pd

    from burncal.operators import series
    from burncal.plans import series as plans

    rng, months = np.random.default_rng(3), pd.period_range("2004-01", periods=120, freq="M").strftime("%Y-%m")
    rows = [(f"r{k}", m, int(10 ** (5 + k) * np.exp(0.01 * i + np.sin(i / 2) + rng.normal() * 0.3))) for k in range(4) for i, m in enumerate(months)]
    found = sorted(map(tuple, series.harmonic_forecast(spark.createDataFrame(rows, "region string, ym string, count long")).select("region", "ym", "mean", "lo", "hi", "sigma", "r2").collect()))
    uni = pd.DataFrame(rows, columns=["region", "ym", "count"])  # noqa: F841
    parts, select = plans._regression(), plans.ORACLES["harmonic_forecast"]
    sql = "with " + ", ".join(f"{name} as ({text})" for name, text in parts.items()) + select[select.rindex(" select region, ym, ") :]
    assert found == sorted((a, b, *map(float, rest)) for a, b, *rest in duckdb.sql(sql).fetchall())
