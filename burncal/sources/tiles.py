"""Vector tiles of detections: a file per tile, gzip or plain, of which the first layer's attributes are read."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, lat double, lon double, frp double, conf_raw string, night boolean, day string, acquired string, satellite string"


def _varint(b: bytes, p: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[p] & 127) << shift
        p, shift = p + 1, shift + 7
        if not b[p - 1] & 128:
            return value, p


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    p = 0
    while p < len(b):
        tag, p = _varint(b, p)
        kind = tag & 7
        if kind == 0:
            value, p = _varint(b, p)
        elif kind == 2:
            size, p = _varint(b, p)
            value, p = b[p : p + size], p + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, p = b[p : p + size], p + size
        yield tag >> 3, value


def _value(b: bytes):
    for number, v in _fields(b):
        if number == 1:
            return v.decode()
        if number in (2, 3):
            return struct.unpack("<f" if number == 2 else "<d", v)[0]
        if number == 6:
            return (v >> 1) ^ -(v & 1)
        return bool(v) if number == 7 else v
    return None


def attributes(tile: bytes) -> list[dict]:
    """The attributes of the features of a tile's first layer; nothing for an empty tile."""
    raw = gzip.decompress(tile) if tile[:2] == b"\x1f\x8b" else tile
    layer = next((v for number, v in _fields(raw) if number == 3), b"")
    keys, values, features = [], [], []
    for number, v in _fields(layer):
        if number == 3:
            keys.append(v.decode())
        elif number == 4:
            values.append(_value(v))
        elif number == 2:
            features.append(v)
    out = []
    for feature in features:
        tags, p = next((v for number, v in _fields(feature) if number == 2), b""), 0
        pairs = []
        while p < len(tags):
            x, p = _varint(tags, p)
            pairs.append(x)
        out.append({keys[k]: values[v] for k, v in zip(pairs[::2], pairs[1::2])})
    return out


def read_tiles(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Detections of all tiles under a path; Spark lists and deals the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for a in attributes(content or b""):
                    text = lambda k, a=a: None if a.get(k) is None else str(a[k])
                    rows.append((where, a.get("LATITUDE"), a.get("LONGITUDE"), float(a.get("FRP") or 0.0), text("CONFIDENCE"), a.get("DAYNIGHT") == "N", text("ACQ_DATE"), text("ACQ_TIME"), text("SATELLITE")))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names)

    return files.mapInArrow(decode, SCHEMA).withColumn("day", F.col("day").try_cast("date"))
