"""Following fire objects from day to day: a greedy nearest match.

The match is sequential only where clusters can meet: a cluster joins a track whose last place lies within the gap, so tracks never leave the
component of clusters that are linked by gaps, and components can't touch each other's matches. Components come from the places of clusters on the sphere, as those of
`cluster.labelled` with one point a cluster, and each is followed in a task of its own. Numbers of tracks, which count over a whole area in the order of
their beginnings, come from counts by day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burncal.functions.scalars import EARTH_KM
from burncal.operators import cluster
from burncal.session import cut

SCHEMA = "region string, first_day date, last_day date, days_seen int, latest_class string, peak_frp double, latest_frp double, frp_trend double, latest_n long, trail array<array<double>>, first_frp double, first_label int"


def haversine(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat2 - lat1), np.radians(lon2 - lon1)
    s = np.sin(a / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(b / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(s)))


def follow(clusters: pd.DataFrame, max_gap_km: float = 60.0, same_day: bool = False) -> list[dict]:
    """Tracks of clusters that can meet, those without power on their last day too. Clusters of a day come by falling power; each joins the nearest track within the gap that no cluster of the day has
    joined. With same_day a track begun that day can be joined too, and days_seen counts matches."""
    tracks: list[dict] = []
    last = np.zeros((len(clusters), 2))  # where each track was seen last: lat, lon
    for day, rows in clusters.sort_values(["day", "frp_sum", "label"], ascending=[True, False, True]).groupby("day", sort=True):
        free = np.zeros(len(clusters), bool)
        free[: len(tracks)] = True
        for c in rows.itertuples():
            at = np.flatnonzero(free)
            away = haversine(last[at, 0], last[at, 1], c.c_lat, c.c_lon)
            best = int(at[away.argmin()]) if len(at) and away.min() <= max_gap_km else None  # of equals the first
            if best is not None:
                t = tracks[best]
                free[best], last[best] = False, (c.c_lat, c.c_lon)
                t["days_seen"] += 1
                t["peak_frp"] = max(t["peak_frp"], c.frp_sum)
                t["frp_trend"] = (c.frp_sum - t["first_frp"]) / max(t["first_frp"], 1)
                t["trail"].append([c.c_lon, c.c_lat])
                t |= {"last_day": day, "latest_class": c.cls, "latest_frp": c.frp_sum, "latest_n": c.n}
            else:
                tracks.append({"first_day": day, "last_day": day, "days_seen": 1, "latest_class": c.cls, "peak_frp": c.frp_sum, "latest_frp": c.frp_sum, "frp_trend": 0.0, "latest_n": c.n, "trail": [[c.c_lon, c.c_lat]], "first_frp": c.frp_sum, "first_label": c.label})
                last[len(tracks) - 1] = c.c_lat, c.c_lon
                free[len(tracks) - 1] = same_day
    return tracks


def linked(clusters: DataFrame, max_gap_km: float) -> DataFrame:
    """Clusters (with a region) and the component of clusters that steps of at most the gap connect, on whatever days. An arc of the gap is longer
    than its chord, so places within the gap have chords within it."""
    lat, lon = F.radians("c_lat"), F.radians("c_lon")
    placed = clusters.withColumnRenamed("label", "own").withColumns({"pt_seq": F.monotonically_increasing_id(), "x": EARTH_KM * F.cos(lat) * F.cos(lon), "y": EARTH_KM * F.cos(lat) * F.sin(lon), "z": EARTH_KM * F.sin(lat)})
    return cluster.labelled(cut(placed), max_gap_km * (1 + 1e-9), 1, ("region",), ("x", "y", "z")).drop("pt_seq", "x", "y", "z", "label").withColumnRenamed("own", "label")


def tracks(clusters: DataFrame, max_gap_km: float = 60.0, same_day: bool = False, region: str = "aoi") -> DataFrame:
    """Tracks of all areas; clusters as from cluster_stats, with an optional region column. Tracks without power on their last day count in
    the numbers of the others, and are left out."""
    rows = clusters if "region" in clusters.columns else clusters.withColumn("region", F.lit(region))
    rows = rows.select("region", "day", "label", "n", "frp_sum", "c_lon", "c_lat", F.col("class").alias("cls"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def one(area: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([t | {"region": area["region"].iloc[0]} for t in follow(area, max_gap_km, same_day)], columns=names)

    found = cut(linked(rows, max_gap_km).groupBy("region", "component").applyInPandas(one, SCHEMA))
    before = Window.partitionBy("region").orderBy("first_day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    offsets = found.groupBy("region", "first_day").agg(F.count(F.lit(1)).alias("begun")).select("region", "first_day", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy("region", "first_day").orderBy(F.desc("first_frp"), "first_label")) + F.col("earlier")
    named = found.join(offsets, ["region", "first_day"]).withColumn("track_id", F.format_string("SYS-%03d", number))
    return named.filter("latest_frp > 0").select("region", "track_id", *(n for n in names if n not in ("region", "first_frp", "first_label")))


def track_picks(found: DataFrame, least_days: int = 2, k: int = 8) -> DataFrame:
    """Of each region the k tracks with the most power on their latest day, of those seen on enough days."""
    best = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("latest_frp"), "track_id"))
    return found.filter(F.col("days_seen") >= least_days).withColumn("rank", best).filter(F.col("rank") <= k)


def trend_class(tracks_: DataFrame) -> DataFrame:
    """Growing, decaying or steady by the change of power since the first day."""
    t = F.col("frp_trend")
    return tracks_.withColumn("trend", F.when(t > 0.25, "growing").when(t < -0.25, "decaying").otherwise("steady"))
