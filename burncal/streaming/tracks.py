"""Fire tracks as keyed state: a state row for each track, timers that forget, and an upsert sink.

The state of a region is its tracks (a map from number to row) and how many have begun. A batch of clusters joins them as `operators.track.follow` does:
day by day, by falling power, each to the nearest track within the gap that was last seen on an earlier day. A batch gives the tracks that it changed.
With `forget_days` a timer goes off that long after a track was last seen, by the watermark of the clusters' days, and removes it, so the state keeps the
tracks that can still go on; without it nothing is forgotten, and the result is that of the batch operator.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from burncal.operators.track import haversine

#: Of a track: days since 1970, and the trail as longitudes and latitudes in turn.
STATE = "first_day int, last_day int, days_seen int, latest_class string, peak_frp double, first_frp double, latest_frp double, latest_n long, trail array<double>"
OUTPUT = "region string, number int, first_day date, last_day date, days_seen int, latest_class string, peak_frp double, latest_frp double, frp_trend double, latest_n long, trail array<double>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000


class Tracker(StatefulProcessor):
    def __init__(self, max_gap_km: float, forget_days: int | None):
        self.max_gap_km, self.forget_days = max_gap_km, forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "number int", STATE)
        self.begun = handle.getValueState("begun", "number int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clusters = pd.concat(list(rows)).sort_values(["day", "frp_sum", "label"], ascending=[True, False, True])
        known = {int(k[0]): list(v) for k, v in self.tracks.iterator()}
        begun = int(self.begun.get()[0]) if self.begun.exists() else 0
        numbers = np.array(sorted(known), np.int64)
        place = np.array([known[n][8][:-3:-1] for n in numbers], float).reshape(-1, 2)  # latitude, longitude
        seen = np.array([known[n][1] for n in numbers], np.int64)
        changed = set()
        for c in clusters.itertuples():
            day = (pd.Timestamp(c.day).date() - EPOCH).days
            free = np.flatnonzero(seen < day)
            away = haversine(place[free, 0], place[free, 1], c.c_lat, c.c_lon)
            if len(free) and away.min() <= self.max_gap_km:
                at = int(free[away.argmin()])  # of equals the one that began first
                number = int(numbers[at])
                first, _, days, _, peak, first_frp, _, _, trail = known[number]
                known[number] = [first, day, days + 1, c.cls, max(peak, c.frp_sum), first_frp, c.frp_sum, c.n, [*trail, c.c_lon, c.c_lat]]
                place[at], seen[at] = (c.c_lat, c.c_lon), day
            else:
                begun += 1
                number = begun
                known[number] = [day, day, 1, c.cls, c.frp_sum, c.frp_sum, c.frp_sum, c.n, [c.c_lon, c.c_lat]]
                numbers, place, seen = np.append(numbers, number), np.append(place, [[c.c_lat, c.c_lon]], 0), np.append(seen, day)
            changed.add(number)
        for number in changed:
            first, last, days, cls, peak, first_frp, latest, n, trail = known[number]
            known[number] = [int(first), int(last), int(days), cls, float(peak), float(first_frp), float(latest), int(n), [float(v) for v in trail]]
            self.tracks.updateValue((number,), tuple(known[number]))
            if self.forget_days is not None:
                self.handle.registerTimer((known[number][1] + self.forget_days + 1) * DAY_MS)
        self.begun.update((begun,))
        day_of = lambda days: EPOCH + dt.timedelta(days=int(days))
        out = [(key[0], k, day_of(t[0]), day_of(t[1]), t[2], t[3], t[4], t[6], (t[6] - t[5]) / max(t[5], 1), t[7], t[8]) for k in sorted(changed) for t in [known[k]]]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - self.forget_days - 1
        for number in [k[0] for k, t in self.tracks.iterator() if t[1] <= gone]:
            self.tracks.removeKey((number,))
        return iter([])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keeps rows by key, for queries that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def tracked(clusters: DataFrame, max_gap_km: float = 60.0, forget_days: int | None = None, late: str = "0 days") -> DataFrame:
    """Tracks of a stream of clusters (region, day, label, n, frp_sum, c_lon, c_lat, class): the changed ones of every batch."""
    rows = clusters.select("region", F.col("day").cast("timestamp").alias("ts"), "day", "label", "n", "frp_sum", "c_lon", "c_lat", F.col("class").alias("cls"))
    marked = rows if forget_days is None else rows.withWatermark("ts", late)
    return marked.groupBy("region").transformWithStateInPandas(Tracker(max_gap_km, forget_days), OUTPUT, "Update", "None" if forget_days is None else "EventTime")


def follow_stream(clusters: DataFrame, path: str, max_gap_km: float = 60.0, forget_days: int | None = None) -> DataFrame:
    """Run the stream over what is there, from its checkpoint under the path if there is one, and return the tracks as they stand: each batch lies in a
    folder of its own number, so one that is run again replaces itself, and of each track its last batch counts."""
    spark = clusters.sparkSession
    with keyed_state(spark):
        writer = tracked(clusters, max_gap_km, forget_days).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state")
        writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/tracks/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return standing(spark, path)


def standing(spark: SparkSession, path: str) -> DataFrame:
    names = [x.split()[0] for x in OUTPUT.split(", ")][2:]
    changes = spark.read.schema(OUTPUT + ", batch long").parquet(f"{path}/tracks")
    last = changes.groupBy("region", "number").agg(F.max_by(F.struct(*names), "batch").alias("t"))
    return last.select("region", F.format_string("SYS-%03d", "number").alias("track_id"), *(f"t.{c}" for c in names)).filter("latest_frp > 0")
