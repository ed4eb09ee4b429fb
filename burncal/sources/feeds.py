"""Feeds as data sources of Spark: spark.read.format("burncal_detections") and its like, in batches and as streams.

Each feed has a schema, a partition for each file (of detections for each RANGE bytes of a file), filters that are applied while a file is parsed, and for streams
an offset: the time and path of the last file that a batch has read. Files are listed and opened with Arrow's file systems, so a path may lie on whatever
store these reach from the workers; `register` makes the names known to a session.
"""

from __future__ import annotations

import codecs
import csv
import datetime as dt
import io
import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RANGE = 64 << 20
ROWS = 4096
STEP = 1 << 16  # bytes of a document that is read piece by piece

#: What a pushed filter asks of a value; nulls pass only where it says so.
ASKS: dict[type, Callable] = {
    EqualTo: lambda f: lambda v: v is not None and v == f.value,
    EqualNullSafe: lambda f: lambda v: v == f.value,
    GreaterThan: lambda f: lambda v: v is not None and v > f.value,
    GreaterThanOrEqual: lambda f: lambda v: v is not None and v >= f.value,
    LessThan: lambda f: lambda v: v is not None and v < f.value,
    LessThanOrEqual: lambda f: lambda v: v is not None and v <= f.value,
    In: lambda f: lambda v: v is not None and v in f.value,
    IsNull: lambda f: lambda v: v is None,
    IsNotNull: lambda f: lambda v: v is not None,
    StringStartsWith: lambda f: lambda v: v is not None and v.startswith(f.value),
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[int, str, int]]:
    """(time, path, size) of all files under a path, oldest first; names that begin with _ or . don't count."""
    store, root = opened(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def number(text) -> float | None:
    """A finite number, or nothing."""
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def day_of(text) -> dt.date | None:
    try:
        return dt.date.fromisoformat(str(text).strip()[:10])
    except ValueError:
        return None


def clock(text) -> str | None:
    """HH:MM UTC of a time of up to four digits."""
    digits = (text or "").strip().zfill(4)
    return f"{digits[:2]}:{digits[2:4]} UTC" if digits.isdigit() and (text or "").strip() else None


def detections(lines: Iterator[str], header: list[str]) -> Iterator[tuple]:
    """Rows with a place and as many cells as the header; power that is no number is 0."""
    at = {c.strip().lower(): k for k, c in enumerate(header)}
    get = lambda row, c: row[at[c]] if c in at and row[at[c]] != "" else None
    for row in csv.reader(lines):
        if len(row) >= len(header):
            lat, lon = number(get(row, "latitude")), number(get(row, "longitude"))
            if lat is not None and lon is not None:
                night = (get(row, "daynight") or "").strip().upper() == "N"
                yield lat, lon, number(get(row, "frp")) or 0.0, get(row, "confidence"), night, get(row, "satellite"), day_of(get(row, "acq_date")), clock(get(row, "acq_time"))


def product(document: dict) -> Iterator[tuple]:
    for day, d in (document.get("days") or {}).items():
        for sensor, s in ((d or {}).get("sensors") or {}).items():
            for k, p in enumerate((s or {}).get("points") or []):
                yield day_of(day), sensor, k, number(p.get("lat")), number(p.get("lon")), number(p.get("frp")) or 0.0, p.get("confRaw"), bool(p.get("night")), p.get("sat"), p.get("acq")


def calendar(document: dict) -> Iterator[tuple]:
    for sensor, s in (document.get("sensors") or {}).items():
        for k, m in enumerate((s or {}).get("monthly") or []):
            yield document.get("region"), sensor, k, m.get("ym"), m.get("sampled"), m.get("days"), m.get("est"), None if m.get("frp") is None else int(m["frp"]), m.get("meanFrp"), m.get("hiConf"), m.get("night")


def outlook(document: dict) -> Iterator[tuple]:
    for h in document.get("history") or []:
        yield document.get("region"), "history", h.get("ym"), number(h.get("est")), None, None
    for f in document.get("forecast") or []:
        yield document.get("region"), "forecast", f.get("ym"), number(f.get("mean")), number(f.get("lo")), number(f.get("hi"))


def members(file, key: str, step: int = STEP) -> Iterator[dict]:
    """The elements of the list that a JSON document has under a key of its top level, one after the other: only the element at hand and `step` bytes of the file are held.
    A document that is no object, or has anything else there, has none. Of a key that comes more than once all lists count."""
    decoder, scan, text, at, ended = codecs.getincrementaldecoder("utf-8-sig")(), json.JSONDecoder().raw_decode, "", 0, False

    def more() -> bool:
        nonlocal text, at, ended
        if ended:
            return False
        data = file.read(max(step, len(text) - at))  # twice as much each time that a value does not end
        ended = not data
        text, at = text[at:] + decoder.decode(data, ended), 0
        return True

    def peek() -> str:
        """The next character that is no white space, not taken."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at < len(text):
                return text[at]
            if not more():
                return ""

    def value():
        nonlocal at
        peek()
        while True:
            try:
                found, end = scan(text, at)
                if end < len(text) or not more():  # a number may go on
                    at = end
                    return found
            except json.JSONDecodeError:
                if not more():
                    raise

    def sign(expected: str) -> str:
        nonlocal at
        if not (found := peek()) or found not in expected:
            raise json.JSONDecodeError(f"Expecting one of {expected}", text, at)
        at += 1
        return found

    if peek() != "{":
        value()
    else:
        sign("{")
        going = peek() != "}" or sign("}") != "}"
        while going:
            name = value()
            sign(":")
            if name == key and peek() == "[":
                sign("[")
                inside = peek() != "]" or sign("]") != "]"
                while inside:
                    yield value()
                    inside = sign(",]") == ","
            else:
                value()
            going = sign(",}") == ","
    if peek():
        raise json.JSONDecodeError("Extra data", text, at)


def events(document: dict) -> Iterator[tuple]:
    """The place is that of the last geometry: a point, or the first vertex of a ring."""
    for e in document.get("events") or ():
        last = (e.get("geometry") or [{}])[-1]
        place = last.get("coordinates") or [None, None]
        while isinstance(place[0], list):
            place = place[0]
        yield e.get("id"), e.get("title"), e.get("link"), [s.get("id") for s in e.get("sources") or []], last.get("date"), number(place[0]), number(place[1])


def weather(document: dict) -> Iterator[tuple]:
    daily = document.get("daily") or {}
    columns = [daily.get(c) or [] for c in ("time", "temperature_2m_max", "relative_humidity_2m_mean", "wind_speed_10m_max", "precipitation_sum")]
    for k, day in enumerate(columns[0]):
        tmax, rh, wind, rain = (number(c[k]) if k < len(c) else None for c in columns[1:])
        yield day_of(day), tmax, rh, wind, rain or 0.0


class Part(InputPartition):
    def __init__(self, path: str, first: int = 0, last: int | None = None):
        self.path, self.first, self.last = path, first, last


class Feed(DataSource):
    """A feed of JSON documents, one for each file."""

    kind, ddl, parse = "", "", staticmethod(lambda document: iter(()))

    @classmethod
    def name(cls) -> str:
        return f"burncal_{cls.kind}"

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self, schema)

    def parts(self, files: list[tuple[int, str, int]]) -> list[Part]:
        return [Part(path) for _, path, _ in files]

    def rows(self, part: Part) -> Iterator[tuple]:
        store, _ = opened(self.options["path"])
        with store.open_input_stream(part.path) as file:
            yield from self.parse(json.loads(file.read()))

    def batches(self, part: Part | None, shape: StructType, asks: list[tuple[int, Callable]]) -> Iterator[pa.RecordBatch]:
        """The rows that all pushed filters let through, in record batches. Without any file Spark asks for no part in particular."""
        if part is None:
            return
        schema, held = to_arrow_schema(shape), []
        for row in self.rows(part):
            if all(ask(row[k]) for k, ask in asks):
                held.append(row)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Detections(Feed):
    """Tables with headers in any case, read in ranges of bytes. A row belongs to the range that its first byte is in; cells hold no
    line breaks."""

    kind = "detections"
    ddl = "lat double, lon double, frp double, conf_raw string, night boolean, satellite string, day date, acquired string"

    def parts(self, files: list[tuple[int, str, int]]) -> list[Part]:
        step = int(self.options.get("range", RANGE))
        return [Part(path, first, first + step) for _, path, size in files for first in range(0, max(size, 1), step)]

    def rows(self, part: Part) -> Iterator[tuple]:
        store, _ = opened(self.options["path"])
        with store.open_input_file(part.path) as raw, io.BufferedReader(raw) as file:
            header = file.readline()
            if part.first > len(header):
                file.seek(part.first - 1)
                file.readline()  # the rest of a row that begins before

            def lines() -> Iterator[str]:
                while file.tell() < part.last and (line := file.readline()):
                    yield line.decode("utf-8", "replace")

            yield from detections(lines(), next(csv.reader([header.decode("utf-8-sig", "replace")]), []))


class Product(Feed):
    kind, parse = "product", staticmethod(product)
    ddl = "day date, sensor string, seq int, lat double, lon double, frp double, conf_raw string, night boolean, satellite string, acquired string"


class Calendar(Feed):
    kind, parse = "calendar", staticmethod(calendar)
    ddl = "region string, sensor string, seq int, ym string, sampled long, days long, est long, frp long, mean_frp double, hi_conf long, night long"


class Outlook(Feed):
    kind, parse = "outlook", staticmethod(outlook)
    ddl = "region string, part string, ym string, mean double, lo double, hi double"


class Events(Feed):
    """Documents of any length: events are read one at a time."""

    kind, parse = "events", staticmethod(events)
    ddl = "event_id string, title string, link string, sources array<string>, date string, lon double, lat double"

    def rows(self, part: Part) -> Iterator[tuple]:
        store, _ = opened(self.options["path"])
        with store.open_input_stream(part.path) as file:
            yield from self.parse({"events": members(file, "events")})


class Weather(Feed):
    kind, parse = "weather", staticmethod(weather)
    ddl = "day date, tmax double, rh double, wind double, precip double"


FEEDS = (Detections, Product, Calendar, Outlook, Events, Weather)


class BatchReader(DataSourceReader):
    def __init__(self, feed: Feed, schema: StructType):
        self.feed, self.shape, self.asks = feed, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = self.shape.names
        for f in filters:
            if type(f) in ASKS and len(f.attribute) == 1 and f.attribute[0] in names:
                self.asks.append((names.index(f.attribute[0]), type(f), f))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return self.feed.parts(files_of(self.feed.options["path"]))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.feed.batches(partition, self.shape, [(k, ASKS[kind](f)) for k, kind, f in self.asks])


class StreamReader(DataSourceStreamReader):
    """An offset is the time and path of the last file; with maxFilesPerTrigger a batch has at most so many."""

    def __init__(self, feed: Feed, schema: StructType):
        self.feed, self.shape, self.most, self.last = feed, schema, int(feed.options.get("maxFilesPerTrigger", 1 << 30)), None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        ahead = self._between(self.last or self.initialOffset(), None)[: self.most]
        self.last = {"time": ahead[-1][0], "path": ahead[-1][1]} if ahead else self.last or self.initialOffset()
        return self.last

    def _between(self, start: dict, end: dict | None) -> list[tuple[int, str, int]]:
        return [f for f in files_of(self.feed.options["path"]) if (start["time"], start["path"]) < f[:2] and (end is None or f[:2] <= (end["time"], end["path"]))]

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last = end  # also after a restart
        return self.feed.parts(self._between(start, end))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.feed.batches(partition, self.shape, [])


def register(spark: SparkSession) -> None:
    """Make the feeds known under their names, with filters pushed to them."""
    for feed in FEEDS:
        spark.dataSource.register(feed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
