"""Streams over several batches: tracks as state, and late and repeated rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from burncal.operators import track
from burncal.plans import streams
from burncal.streaming import detections, tracks
from tests import oracle
from tests.conftest import SF
from tests.test_tracks import COLUMNS, DAY, some


def write(spark, path, rows, schema=COLUMNS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=COLUMNS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(found):
    """Rows with the trail as longitudes and latitudes in turn."""
    return sorted((r.region, r.track_id, r.first_day, r.last_day, r.days_seen, r.latest_class, r.peak_frp, r.latest_frp, r.frp_trend, r.latest_n, [v for p in r.trail for v in (p if isinstance(p, list) else [p])]) for r in found.collect())


def test_batches_and_a_restart(spark, tmp_path):
    """Nine days in five files; the stream stops after three and goes on from its checkpoint."""
    rows = some(11, 120, 5)
    path, days = str(tmp_path), sorted({r[1] for r in rows})
    parts = [[r for r in rows if days.index(r[1]) * 5 // len(days) == k] for k in range(5)]
    for part in parts[:3]:
        write(spark, f"{path}/in", part)
    half = tracks.follow_stream(stream(spark, f"{path}/in"), path)
    assert plain(half) == plain(track.tracks(spark.createDataFrame([r for p in parts[:3] for r in p], COLUMNS)))
    for part in parts[3:]:
        write(spark, f"{path}/in", part)
    found = tracks.follow_stream(stream(spark, f"{path}/in"), path)
    assert plain(found) == plain(track.tracks(spark.createDataFrame(rows, COLUMNS)))
    assert len(spark.read.parquet(f"{path}/tracks").select("batch").distinct().collect()) == 5


@pytest.mark.parametrize("forget, expected", [(None, {"SYS-001": 3}), (3, {"SYS-001": 2, "SYS-002": 1})])
def test_timers_forget(spark, tmp_path, forget, expected):
    """A fire that comes back after ten days is a new one if tracks are forgotten after three."""
    path = str(tmp_path)
    for k, day in enumerate((0, 1, 8, 9, 11)):
        lon = 50.0 if day in (8, 9) else 0.0  # another region moves the watermark
        write(spark, f"{path}/in", [("far" if lon else "r", DAY + dt.timedelta(days=day), 1, 1, 10.0 + k, lon, 0.0, "EMERGING")])
    found = tracks.follow_stream(stream(spark, f"{path}/in"), path, forget_days=forget)
    assert {r.track_id: r.days_seen for r in found.collect() if r.region == "r"} == expected


def test_a_day_in_two_batches(spark, tmp_path):
    """What has joined a track on a day keeps it, whatever batch the day's other clusters come in."""
    path = str(tmp_path)
    write(spark, f"{path}/in", [("r", DAY, 1, 1, 10.0, 0.0, 0.0, "X"), ("r", DAY + dt.timedelta(days=1), 1, 1, 9.0, 0.1, 0.0, "X")])
    write(spark, f"{path}/in", [("r", DAY + dt.timedelta(days=1), 2, 1, 20.0, 0.0, 0.0, "X")])
    found = tracks.follow_stream(stream(spark, f"{path}/in"), path)
    assert {r.track_id: r.days_seen for r in found.collect()} == {"SYS-001": 2, "SYS-002": 1}


DETECTION = "ts timestamp, sensor string, lat double, lon double, frp double, conf_raw string, night boolean"


def test_late_and_repeated_rows(spark, tmp_path):
    at = lambda day, hour=12: dt.datetime(2024, 1, day, hour)
    row = lambda ts, frp: (ts, "VIIRS-SNPP", 1.0, 2.0, frp, "h", True)
    files = [[row(at(1), 1.0), row(at(2), 2.0)], [row(at(1), 1.0), row(at(1, 13), 4.0), row(at(4), 3.0)], [row(at(1, 14), 100.0), row(at(9), 5.0)], [row(at(12), 7.0), row(at(2, 1), 50.0)]]
    for f in files:
        write(spark, str(tmp_path / "in"), f, DETECTION)
    daily = detections.daily_summary(stream(spark, str(tmp_path / "in"), DETECTION), late="2 days")
    found = detections.appended(daily, str(tmp_path)).collect()
    # the repeat in the second file counts once; late rows of the second and third file count, as the watermark follows a batch behind; that of the fourth is too
    # late; days that may go on aren't given yet
    assert sorted((r.day.day, r.n, r.max_frp) for r in found) == [(1, 3, 100.0), (2, 1, 2.0), (4, 1, 3.0), (9, 1, 5.0)]
    write(spark, str(tmp_path / "in"), [row(at(20), 9.0), row(at(12), 7.0)], DETECTION)  # goes on from the checkpoint: the twelfth closes once
    found = detections.appended(detections.daily_summary(stream(spark, str(tmp_path / "in"), DETECTION), late="2 days"), str(tmp_path)).collect()
    assert sorted((r.day.day, r.n) for r in found) == [(1, 3), (2, 1), (4, 1), (9, 1), (12, 1)]


def test_last_days_of_months(spark, tmp_path):
    """Streams read the 31st too, and months one after another."""
    events = spark.read.parquet(f"{SF}/events.parquet").filter("day(ts) <= 8")
    moved = events.withColumn("ts", F.expr("ts + make_dt_interval(25)"))  # from the 26th to the second of February
    moved.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    only = tmp_path / "sf"
    only.mkdir()
    (only / "events.parquet").symlink_to(next((tmp_path / "events.parquet").glob("part-*")))
    for t in oracle.TABLES:
        if t != "events":
            (only / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    assert moved.filter("day(ts) = 31").count() > 0
    assert oracle.compare(spark, streams.stream_tracks, streams.ORACLES["stream_tracks"], str(only)) > 0
    assert oracle.compare(spark, streams.stream_late_summary, streams.ORACLES["stream_late_summary"], str(only)) >= 0
