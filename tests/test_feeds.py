"""Feeds as data sources: awkward files, ranges, pushed filters, streams."""

from __future__ import annotations

import datetime as dt
import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from burncal.sources import feeds


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    feeds.register(spark)


HEADER = "Latitude,LONGITUDE,frp,confidence,daynight,satellite,acq_date,acq_time\n"


def test_awkward_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '1.5,2.5,x,h,N,"Ter,ra",2024-01-02,345\n,2,3,n,D,Aqua,2024-01-02,0\n1,2\n1,2,7.5,50,D,Aqua,bad,1230\nnan,1,1,1,D,A,2024-01-01,1\n3,4,inf,,n,,2024-01-03,\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text(HEADER)
    (tmp_path / "_SUCCESS").write_text("")
    rows = spark.read.format("burncal_detections").load(str(tmp_path)).orderBy("lat", "lon").collect()
    assert [tuple(r) for r in rows] == [
        (1.0, 2.0, 7.5, "50", False, "Aqua", None, "12:30 UTC"), (1.5, 2.5, 0.0, "h", True, "Ter,ra", dt.date(2024, 1, 2), "03:45 UTC"), (3.0, 4.0, 0.0, None, True, None, dt.date(2024, 1, 3), None),
    ]
    assert spark.read.format("burncal_detections").load(str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 60, 100, 10**6])
def test_ranges(spark, tmp_path, size):
    """Every row once, however the bytes are cut."""
    (tmp_path / "a.csv").write_text(HEADER + "".join(f"{k},{k + 0.5},{k * 1.25},é{k},N,S,2024-01-01,{k}\n" for k in range(40)))
    if size == 1:  # each byte a range: in this process
        feed = feeds.Detections({"path": str(tmp_path), "range": "1"})
        found = [row[0] for part in feed.parts(feeds.files_of(str(tmp_path))) for row in feed.rows(part)]
    else:
        frame = spark.read.format("burncal_detections").option("range", size).load(str(tmp_path))
        found = [r.lat for r in frame.collect()]
        assert size > 1000 or frame.rdd.getNumPartitions() > 1
    assert sorted(found) == [float(k) for k in range(40)]


def test_filters_are_pushed(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "".join(f"{k},1,{k},{'h' if k % 3 else ''},N,S{k % 4},2024-01-{1 + k % 9:02d},0\n" for k in range(60)))
    frame = spark.read.format("burncal_detections").load(str(tmp_path))
    asked = frame.filter((F.col("frp") > 10) & F.col("satellite").isin("S1", "S2") & F.col("conf_raw").isNotNull() & (F.col("day") <= dt.date(2024, 1, 5)) & (F.length("satellite") == 2))
    assert sorted(r.frp for r in asked.collect()) == [float(k) for k in range(11, 60) if k % 4 in (1, 2) and k % 3 and 1 + k % 9 <= 5]
    reader = feeds.BatchReader(feeds.Detections({"path": str(tmp_path)}), frame.schema)
    left = list(reader.pushFilters([feeds.GreaterThan(("frp",), 57.5), feeds.EqualTo(("satellite", "x"), 1), feeds.IsNull(("conf_raw",))]))
    assert left == [feeds.EqualTo(("satellite", "x"), 1)]
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [] and [k for k, _, _ in reader.asks] == [2, 3]


def test_documents(spark, tmp_path):
    def load(kind, *documents):
        folder = tmp_path / kind
        folder.mkdir()
        for k, d in enumerate(documents):
            (folder / f"{k}.json").write_text(json.dumps(d))
        return [tuple(r) for r in spark.read.format(f"burncal_{kind}").load(str(folder)).collect()]

    point = {"lat": 1, "lon": 2.0, "frp": None, "confRaw": "n", "night": None, "sat": "A", "acq": "01:00 UTC"}
    assert load("product", {"days": {"2024-01-01": {"sensors": {"S": {"points": [point, point]}, "T": None}}, "bad": None}}, {}) == [(dt.date(2024, 1, 1), "S", k, 1.0, 2.0, 0.0, "n", False, "A", "01:00 UTC") for k in (0, 1)]
    assert load("calendar", {"region": "r", "sensors": {"S": {"monthly": [{"ym": "2000-01", "est": 5, "frp": 2.7}]}}}) == [("r", "S", 0, "2000-01", None, None, 5, 2, None, None, None)]
    assert load("outlook", {"region": "r", "history": None, "forecast": [{"ym": "2000-01", "mean": 1, "lo": 0, "hi": 2}]}) == [("r", "forecast", "2000-01", 1.0, 0.0, 2.0)]
    assert load("weather", {"daily": {"time": ["2024-01-01", "x"], "temperature_2m_max": [30.5], "precipitation_sum": [None, 2]}}) == [(dt.date(2024, 1, 1), 30.5, None, None, 0.0), (None, None, None, None, 2.0)]
    ring = {"id": "1", "title": "t", "link": "l", "sources": [{"id": "x"}], "geometry": [{"date": "d", "coordinates": [1, 2]}, {"date": "e", "coordinates": [[[3.5, 4], [5, 6]]]}]}
    assert load("events", {"events": [ring, {"id": "2", "geometry": []}]}) == [("1", "t", "l", ["x"], "e", 3.5, 4.0), ("2", None, None, [], None, None, None)]


def test_stream_and_restart(spark, tmp_path):
    """One file a batch; a second run goes on after the files of the first."""
    folder, seen = tmp_path / "in", []

    def add(k):
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.csv").write_text(HEADER + f"{k},1,5,h,N,S,2024-01-01,0\n{k},2,5,h,N,S,2024-01-01,0\n")

    def run():
        stream = spark.readStream.format("burncal_detections").option("maxFilesPerTrigger", 1).load(str(folder))
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.lat for r in df.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    add(1), add(2)
    run()
    assert [b for b in seen if b] == [[1.0, 1.0], [2.0, 2.0]]
    add(3)
    run()
    assert [b for b in seen if b] == [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]]


@pytest.mark.parametrize("step", [1, 2, 7, 1 << 16])
def test_events_one_at_a_time(step):
    """Elements as json gives them, wherever the pieces end; what is broken fails; a long document is never held whole."""
    document = {"title": 'x "events": [1]', "n": -12.5e3, "deep": {"events": [1, 2]}, "events": [{"id": "é{[", "k": [1, {"a": "]"}]}, {}, 12, None, "€"], "last": [True]}
    for text in (json.dumps(document), json.dumps(document, indent=2, ensure_ascii=False)):
        assert list(feeds.members(io.BytesIO(text.encode()), "events", step)) == document["events"]
    for text in ('{"events":[]}', "{}", '{"events":null}', "[1]", "12"):
        assert list(feeds.members(io.BytesIO(text.encode()), "events", step)) == []
    for text in ('{"events":[{}', '{"events":[{} {}]}', '{"events":[]} x', "", '{"a" 1}'):
        with pytest.raises(json.JSONDecodeError):
            list(feeds.members(io.BytesIO(text.encode()), "events", step))


def test_memory_of_long_documents(tmp_path):
    one = '{"id":"E","title":"fire","link":"l","sources":[{"id":"s"}],"geometry":[{"date":"d","coordinates":[1,2]}]}'
    (tmp_path / "a.json").write_text('{"events":[' + ",".join([one] * 50_000) + "]}")
    feed = feeds.Events({"path": str(tmp_path)})
    tracemalloc.start()
    assert sum(1 for part in feed.parts(feeds.files_of(str(tmp_path))) for _ in feed.rows(part)) == 50_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20
