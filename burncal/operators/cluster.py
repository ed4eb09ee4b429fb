"""Density clustering of detections, scene by scene, and measures of the clusters.

Numbers of neighbours come from a tree in memory or, where a place is too crowded for a task, a pyramid of cell counts on Spark (`pyramid`); labels from cells whose points
are all neighbours: in memory (`scenes`), scene by scene or tile by tile, or on Spark (`dbscan`). Points are core if enough neighbours lie within eps; core points that are neighbours form components; a
border point joins the adjacent component whose first core point comes first; clusters are numbered in that order. This is the
labelling that a sequential scan in the order of pt_seq gives.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from burncal.functions.scalars import KM_LAT, KM_LON, cluster_class, complex_class, confidence, confidence_training, exact_sum, haversine_km, rounded, weak_label
from burncal.operators.components import connected_components
from burncal.operators.pyramid import radius_counts
from burncal.operators.scenes import count_scene, label_scene, label_tile, reach_of, side_of, unsure_boxes
from burncal.session import cut, written

SCENE_POINTS = 50_000  # of a scene that one task labels
COUNTED_POINTS = 20_000  # of a scene whose neighbours one task counts
SUB_CELLS = 8
TILE_PLACES = 400_000  # of a tile with its margin that one task labels
COUNTED_PLACES = 600_000  # of a tile with its margin that one task counts
TILES = (64, 32, 16, 8)  # cells along a side of a tile that labels, the widest that fits is taken
COUNTED_TILES = (16, 8, 4, 2, 1)


def _places(points: DataFrame, scene, dims) -> DataFrame:
    """The distinct places of scenes with their number of points and the first of these."""
    return points.na.drop(subset=[*scene, *dims]).groupBy(*scene, *dims).agg(F.count(F.lit(1)).alias("n"), F.min("pt_seq").alias("first"))


def _tiled(places: DataFrame, side: float, margin: int, sizes: tuple[int, ...], most: int, scene, dims) -> tuple[DataFrame, DataFrame]:
    """The places once for each tile that they are in or within `margin` cells of, with the tile's place (t0, t1, ...) and its side in cells (tile); and the scenes
    whose fullest tile has more than `most` places even at the smallest size, which are not tiled."""
    cells = [f"c{k}" for k in range(len(dims))]

    def in_tiles(rows: DataFrame) -> DataFrame:
        for k, c in enumerate(cells):
            ends = (F.floor((F.col(c) + o) / F.col("tile")) for o in (-margin, margin))
            rows = rows.withColumn(f"t{k}", F.explode(F.sequence(*ends)))
        return rows

    placed = places.withColumns({c: F.floor(F.col(x) / side) for c, x in zip(cells, dims)})
    held = placed.groupBy(*scene, *cells).agg(F.count(F.lit(1)).alias("m")).withColumn("tile", F.explode(F.array(*map(F.lit, sizes))))
    full = in_tiles(held).groupBy(*scene, "tile", *(f"t{k}" for k in range(len(dims)))).agg(F.sum("m").alias("m"))
    fit = cut(full.groupBy(*scene, "tile").agg(F.max("m").alias("m")).groupBy(*scene).agg(F.max(F.when(F.col("m") <= most, F.col("tile"))).alias("tile")))
    return in_tiles(placed.join(F.broadcast(fit.filter("tile is not null")), list(scene))).drop(*cells), fit.filter("tile is null").drop("tile")


def _types(points: DataFrame, columns) -> str:
    kinds = dict(points.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def _stacked(rows: pa.Table, dims) -> np.ndarray:
    return np.stack([rows.column(d).to_numpy() for d in dims], 1).astype(float)


def counted_tiles(points: DataFrame, radii, scene, dims, most: int = COUNTED_PLACES, sizes: tuple[int, ...] = COUNTED_TILES) -> DataFrame:
    """What `radius_counts` gives, with one task for each tile; scenes with a tile too full for a task are left to it."""
    names, side = [f"n_{k}" for k in range(len(radii))], float(max(radii)) * (1 + 1e-9)
    places = written(_places(points, scene, dims), "places")
    tiled, over = _tiled(places, side, 1, sizes, most, scene, dims)
    keys = [*scene, *(f"t{k}" for k in range(len(dims)))]

    def one(rows: pa.Table) -> pa.Table:
        x, tile = _stacked(rows, dims), rows.column("tile")[0].as_py()
        at = np.floor(np.floor(x / side) / tile)
        own = (at == np.array([rows.column(f"t{k}")[0].as_py() for k in range(len(dims))])).all(1)
        if not own.any():
            return out.empty_table()
        found = count_scene(x, radii, rows.column("n").to_numpy(), own)[own]
        kept = rows.filter(pa.array(own))
        return pa.table({c: kept.column(c) for c in (*scene, *dims)} | {n: found[:, k] for k, n in enumerate(names)})

    ddl = f"{_types(places, [*scene, *dims])}, " + ", ".join(f"{n} long" for n in names)
    out = to_arrow_schema(places.sparkSession.createDataFrame([], ddl).schema)
    by_place = tiled.groupBy(*keys).applyInArrow(one, ddl)
    if not over.head(1):
        return points.join(by_place, [*scene, *dims]).select("pt_seq", *names)
    left = radius_counts(points.join(F.broadcast(over), list(scene), "left_semi"), radii, scene, dims)
    return points.join(by_place, [*scene, *dims]).select("pt_seq", *names).unionByName(left)


def _reduced(points: DataFrame, eps: float, min_pts: int, most: int, sizes: tuple[int, ...], scene, dims) -> DataFrame:
    """What the labels of all points follow from: the halves of cells (s0, s1, ... and one of their places, with n points, the first of these) and, place by place (`alone`), those that
    `unsure_boxes` asks for. There are no more halves than the space has, however many points."""
    d, side = len(dims), side_of(eps, len(dims))
    halves = [f"s{k}" for k in range(d)]
    placed = points.select("pt_seq", *scene, *dims).na.drop(subset=[*scene, *dims]).withColumns({h: F.floor(F.col(x) / side * 2.0) for h, x in zip(halves, dims)})
    count, least = F.count(F.lit(1)).alias("n"), F.min("pt_seq").alias("first")
    boxes = written(placed.groupBy(*scene, *halves).agg(count, least, *(F.first(x).alias(x) for x in dims)), "boxes")
    tiled, over = _tiled(boxes, side, 2 * reach_of(d), sizes, most, scene, dims)

    def ask(rows: pa.Table) -> pa.Table:
        x, half, n = _stacked(rows, dims), _stacked(rows, halves), rows.column("n").to_numpy()
        tile = rows.column("tile")[0].as_py()
        own = (np.floor(half / 2 / tile) == np.array([rows.column(f"t{k}")[0].as_py() for k in range(d)])).all(1)
        if not own.any():
            return rows.select([*scene, *halves]).slice(0, 0)
        one = (n == 1)[:, None]
        low, high = np.where(one, x, half * side / 2), np.where(one, x, (half + 1) * side / 2)
        asked = unsure_boxes(x, low, high, n, eps, min_pts) & own & (n > 1)
        return rows.select([*scene, *halves]).filter(pa.array(asked))

    asked = tiled.groupBy(*scene, *(f"t{k}" for k in range(d))).applyInArrow(ask, _types(boxes, [*scene, *halves]))
    if over.head(1):  # tiles too full even of halves: all their places
        asked = asked.unionByName(boxes.join(F.broadcast(over), list(scene), "left_semi").filter("n > 1").select(*scene, *halves))
    asked = written(asked, "asked")
    alone = placed.join(asked, [*scene, *halves], "left_semi").groupBy(*scene, *halves, *dims).agg(count, least).withColumn("alone", F.lit(True))
    whole = boxes.join(asked, [*scene, *halves], "left_anti").withColumn("alone", F.lit(False))
    return written(whole.unionByName(alone), "reduced")


def dbscan_tiles(points: DataFrame, eps: float, min_pts: int, scene, dims, most: int = TILE_PLACES, sizes: tuple[int, ...] = TILES) -> DataFrame:
    """What `dbscan` gives, from tiles that are labelled one task each and components of what they share; scenes with a tile too full for a task are left to it.
    Tiles get the places that labels depend on (`_reduced`), and those of the tiles around; of points only the last joins move all."""
    d = len(dims)
    side, reach = side_of(eps, d), reach_of(d)
    halves = [f"s{k}" for k in range(d)]
    places = _reduced(points, eps, min_pts, most, sizes, scene, dims)
    tiled, over = _tiled(places, side, 2 * reach, sizes, most, scene, dims)
    keys = [*scene, *(f"t{k}" for k in range(d))]
    kept = [*scene, *halves, *dims, "alone"]

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("first")
        x, ids, tile = _stacked(rows, dims), rows.column("first").to_numpy(), rows.column("tile")[0].as_py()
        low = np.array([rows.column(f"t{k}")[0].as_py() for k in range(d)]) * tile
        place, root, node, other = label_tile(x, rows.column("n").to_numpy(), eps, min_pts, low, low + tile)
        own = rows.select(kept).take(pa.array(np.append(place, np.zeros(len(node), np.int64))))
        nodes = pa.array(np.append(np.zeros(len(place), np.int64), ids[node]), mask=np.arange(len(own)) < len(place))
        return own.append_column("root", pa.array(np.append(ids[root], ids[other]))).append_column("node", nodes)

    found = written(tiled.groupBy(*keys).applyInArrow(one, f"{_types(places, kept)}, root long, node long"), "tiles")
    linked = connected_components(found.filter("node is not null").select("node", "root"), "node", "root")
    rooted = found.filter("node is null").join(linked.withColumnRenamed("node", "root"), "root", "left").select(*kept, F.coalesce("component", "root").alias("component"))
    by_place = written(rooted.groupBy(*kept).agg(F.min("component").alias("component")), "labels")
    number = F.row_number().over(Window.partitionBy(*scene).orderBy("component"))  # clusters of a scene are few
    numbers = by_place.select(*scene, "component").distinct().select("component", number.alias("label"))
    labels = by_place.join(numbers, "component")
    whole = labels.filter("not alone").select(*scene, *halves, "component", "label")
    alone = labels.filter("alone").select(*scene, *dims, F.col("component").alias("c"), F.col("label").alias("l"))
    tiles = points.withColumns({h: F.floor(F.col(x) / side * 2.0) for h, x in zip(halves, dims)}).join(whole, [*scene, *halves], "left").join(alone, [*scene, *dims], "left")
    tiles = tiles.select(*points.columns, F.coalesce("component", "c").alias("component"), F.coalesce("label", "l").alias("label"))
    if not over.head(1):
        return written(tiles, "labelled")
    left = dbscan(points.join(F.broadcast(over), list(scene), "left_semi"), eps, min_pts, scene, dims)
    return written(tiles.join(F.broadcast(over), list(scene), "left_anti").select(*points.columns, "component", "label"), "labelled").unionByName(left.select(*points.columns, "component", "label"))


def counts_within(points: DataFrame, radii, scene=("day",), dims=("lon", "lat"), most: int = COUNTED_POINTS) -> DataFrame:
    """pt_seq and n_0, n_1, ...: points of the scene within each radius, the point itself counted. Scenes of up to `most` points are counted one task
    each, larger ones tile by tile; points without a place have none."""
    names = [f"n_{k}" for k in range(len(radii))]
    placed = points.select("pt_seq", *scene, *dims).na.drop(subset=[*scene, *dims])
    over = placed.groupBy(*scene).count().filter(F.col("count") > most).drop("count")

    def one(rows: pa.Table) -> pa.Table:
        found = count_scene(np.stack([rows.column(d).to_numpy() for d in dims], 1), radii)
        return pa.table({"pt_seq": rows.column("pt_seq")} | {n: found[:, k] for k, n in enumerate(names)})

    def small(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*scene).applyInArrow(one, "pt_seq long, " + ", ".join(f"{n} long" for n in names))

    if over.head(1):
        over = cut(over)
        large = counted_tiles(placed.join(F.broadcast(over), list(scene), "left_semi"), radii, scene, dims)
        found = small(placed.join(F.broadcast(over), list(scene), "left_anti")).unionByName(large)
    else:
        found = small(placed)
    kinds = dict(points.dtypes)
    without = [F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in (*scene, *dims)]  # what na.drop drops
    unplaced = points.filter(functools.reduce(operator.or_, without)).select("pt_seq", *(F.lit(0).cast("long").alias(n) for n in names))
    return found.unionByName(unplaced)


def neighbor_counts(points: DataFrame, eps: float, scene=("day",), dims=("lon", "lat"), most: int = COUNTED_POINTS) -> DataFrame:
    """pt_seq and number of other points within eps, 0 too."""
    return counts_within(points, [eps], scene, dims, most).select("pt_seq", F.greatest(F.col("n_0") - 1, F.lit(0)).alias("n"))


def density_features(points: DataFrame, radii=(0.05, 0.25, 1.0), scene=("day",), most: int = COUNTED_POINTS) -> DataFrame:
    """Points within each radius, the point itself counted."""
    return counts_within(points, radii, scene, most=most).withColumnsRenamed({f"n_{k}": f"dens_{k}" for k in range(len(radii))})


def _in_cells(points: DataFrame, side: float, scene, dims) -> DataFrame:
    return points.select(*scene, "pt_seq", *dims, *(F.floor(F.col(d) / side).alias(f"c{k}") for k, d in enumerate(dims)))


def _beside(rows: DataFrame, offsets, keep: list[str], scene, count: int) -> DataFrame:
    """The rows once for each offset, at the cell that the offset leads to."""
    around = F.array(*(F.struct(*(F.lit(x).alias(f"o{k}") for k, x in enumerate(o))) for o in offsets))
    return rows.select(*scene, *keep, *(f"c{k}" for k in range(count)), F.explode(around).alias("o")).select(*scene, *keep, *((F.col(f"c{k}") + F.col(f"o.o{k}")).alias(f"c{k}") for k in range(count)))


def _squared(a: str, b: str, dims):
    terms = [(F.col(f"{a}{d}") - F.col(f"{b}{d}")) * (F.col(f"{a}{d}") - F.col(f"{b}{d}")) for d in dims]
    return sum(terms[1:], terms[0])


def _met_cells(core: DataFrame, pairs: DataFrame, eps: float, side: float, dims) -> DataFrame:
    """Of pairs of cells (na, nb) those with core points (node and place) within eps of each other. Cells are cut into small ones, at most
    SUB_CELLS in each dimension: a pair is sure if two small ones lie within eps as a whole, and only where none does are the distinct
    places of small ones compared that may. So the rows of a pair are bounded by the small cells, however many points there are."""
    sub = [F.floor(F.col(x) / side).alias(f"s{k}") for k, x in enumerate(dims)]
    ends = [f for x in dims for f in (F.min(x).alias(f"low_{x}"), F.max(x).alias(f"high_{x}"))]
    small = core.groupBy("node", *sub).agg(*ends)
    names = [f"s{k}" for k in range(len(dims))] + [f"{e}_{x}" for x in dims for e in ("low", "high")]
    a = small.select(F.col("node").alias("na"), *(F.col(c).alias(f"a_{c}") for c in names))
    both = pairs.join(a, "na").join(small.withColumnRenamed("node", "nb"), "nb")
    gap = [F.greatest(F.lit(0.0), F.col(f"low_{x}") - F.col(f"a_high_{x}"), F.col(f"a_low_{x}") - F.col(f"high_{x}")) for x in dims]
    span = [F.greatest(F.col(f"high_{x}") - F.col(f"a_low_{x}"), F.col(f"a_high_{x}") - F.col(f"low_{x}")) for x in dims]
    near = sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= eps * eps * (1 + 1e-9)
    sure = sum((g * g for g in span[1:]), span[0] * span[0]) <= eps * eps * (1 - 1e-9)
    keys = [f"{p}s{k}" for p in ("a_", "") for k in range(len(dims))]
    both = cut(both.filter(near).select("na", "nb", *keys, sure.alias("sure")))
    found = both.filter("sure").select("na", "nb").distinct()
    left = both.join(found, ["na", "nb"], "left_anti")
    places = core.select("node", *sub, *dims).distinct()
    x = places.select(F.col("node").alias("na"), *(F.col(f"s{k}").alias(f"a_s{k}") for k in range(len(dims))), *(F.col(d).alias(f"a_{d}") for d in dims))
    y = places.select(F.col("node").alias("nb"), *(f"s{k}" for k in range(len(dims))), *(F.col(d).alias(f"b_{d}") for d in dims))
    close = left.join(x, ["na", *(f"a_s{k}" for k in range(len(dims)))]).join(y, ["nb", *(f"s{k}" for k in range(len(dims)))]).filter(_squared("a_", "b_", dims) <= eps * eps)
    return found.unionByName(close.select("na", "nb").distinct())


def dbscan(points: DataFrame, eps: float, min_pts: int = 3, scene=("day",), dims=("lon", "lat")) -> DataFrame:
    """The points with `component` (first core point of the cluster; null for noise) and `label` (number of the cluster in its scene, from 1).

    Cells are so small that all points of a cell are neighbours. A cell of min_pts points holds core points only, and the core points of a cell are
    connected, so no pairs inside a cell are formed: points of other cells, fewer than min_pts in each, look for neighbours in the cells around, and
    components are those of cells. Two cells are linked for certain if the boxes of their core points lie within eps as a whole, not at all if
    the boxes are further apart, and by their points only in between.
    """
    d, side = len(dims), eps / len(dims) ** 0.5 * (1 - 1e-9)
    cell, reach = [*scene, *(f"c{k}" for k in range(len(dims)))], math.floor(len(dims) ** 0.5) + 1
    offsets = list(itertools.product(range(-reach, reach + 1), repeat=d))
    placed = _in_cells(points, side, scene, dims)
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("size"))
    sized = cut(placed.join(sizes, cell))
    seekers = sized.filter(F.col("size") < min_pts).select(*cell, F.col("pt_seq").alias("a"), *(F.col(x).alias(f"a_{x}") for x in dims))
    others = sized.select(*cell, F.col("pt_seq").alias("b"), *(F.col(x).alias(f"b_{x}") for x in dims))
    wide = _beside(seekers, offsets, ["a", *(f"a_{x}" for x in dims)], scene, d)
    met = wide.join(others, cell).filter((_squared("a_", "b_", dims) <= eps * eps) & (F.col("a") != F.col("b"))).select("a", "b")
    lone_core = met.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") + 1 >= min_pts).select(F.col("a").alias("pt_seq"), F.lit(True).alias("lone"))
    core = sized.join(lone_core, "pt_seq", "left").filter((F.col("size") >= min_pts) | F.col("lone")).drop("lone", "size")
    boxes = core.groupBy(*cell).agg(F.min("pt_seq").alias("node"), *(f for x in dims for f in (F.min(x).alias(f"low_{x}"), F.max(x).alias(f"high_{x}"))))
    core = cut(core.join(boxes, cell))
    boxes = core.select(*cell, "node", *(f"{e}_{x}" for e in ("low", "high") for x in dims)).dropDuplicates(["node"])
    ahead = [o for o in offsets if o > (0,) * d]
    left = _beside(boxes.select(*cell, F.col("node").alias("na"), *(F.col(f"{e}_{x}").alias(f"a_{e}_{x}") for e in ("low", "high") for x in dims)), ahead, ["na", *(f"a_{e}_{x}" for e in ("low", "high") for x in dims)], scene, d)
    pairs = left.join(boxes.withColumnRenamed("node", "nb"), cell)
    gap = [F.greatest(F.lit(0.0), F.col(f"low_{x}") - F.col(f"a_high_{x}"), F.col(f"a_low_{x}") - F.col(f"high_{x}")) for x in dims]
    span = [F.greatest(F.col(f"high_{x}") - F.col(f"a_low_{x}"), F.col(f"a_high_{x}") - F.col(f"low_{x}")) for x in dims]
    near = sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= eps * eps * (1 + 1e-9)
    sure = sum((g * g for g in span[1:]), span[0] * span[0]) <= eps * eps * (1 - 1e-9)
    pairs = cut(pairs.filter(near).select("na", "nb", sure.alias("sure")))
    tested = _met_cells(core, pairs.filter("not sure").select("na", "nb"), eps, side / SUB_CELLS, dims)
    found = connected_components(pairs.filter("sure").select("na", "nb").unionByName(tested), "na", "nb")
    cores = core.select("pt_seq", "node").join(found, "node", "left").select("pt_seq", F.coalesce("component", "node").alias("component"))
    border = met.join(cores.withColumnRenamed("pt_seq", "b"), "b").groupBy(F.col("a").alias("pt_seq")).agg(F.min("component").alias("near"))
    labelled = points.join(cores, "pt_seq", "left").join(border, "pt_seq", "left")
    labelled = cut(labelled.withColumn("component", F.coalesce("component", "near")).drop("near"))
    numbers = labelled.filter("component is not null").select(*scene, "component").distinct()  # clusters of a scene are few
    number = F.row_number().over(Window.partitionBy(*scene).orderBy("component"))
    return labelled.join(numbers.select("component", number.alias("label")), "component", "left")


def dbscan_scenes(points: DataFrame, eps: float, min_pts: int = 3, scene=("day",), dims=("lon", "lat")) -> DataFrame:
    """What `dbscan` gives, with one task per scene; for scenes that each fit in memory."""

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pt_seq")
        ids = rows.column("pt_seq").to_numpy()
        component, label = label_scene(np.stack([rows.column(d).to_numpy() for d in dims], 1), eps, min_pts)
        noise = component < 0
        component, label = pa.array(ids[component], pa.int64(), mask=noise), pa.array(label, pa.int32(), mask=noise)
        return rows.append_column("component", component).append_column("label", label)

    schema = StructType([*points.schema.fields, StructField("component", LongType()), StructField("label", IntegerType())])
    return points.groupBy(*scene).applyInArrow(one, schema)


def labelled(points: DataFrame, eps: float, min_pts: int = 3, scene=("day",), dims=("lon", "lat"), most: int = SCENE_POINTS) -> DataFrame:
    """The points with component and label: scenes of up to `most` points one task each, larger ones tile by tile."""
    over = points.groupBy(*scene).count().filter(F.col("count") > most).drop("count")
    if not over.head(1):
        return dbscan_scenes(points, eps, min_pts, scene, dims)
    over = F.broadcast(cut(over))
    small, large = points.join(over, list(scene), "left_anti").select(*points.columns), points.join(over, list(scene), "left_semi").select(*points.columns)
    return dbscan_scenes(small, eps, min_pts, scene, dims).unionByName(dbscan_tiles(large, eps, min_pts, scene, dims).withColumn("label", F.col("label").cast("int")))


def standardized(points: DataFrame, columns: dict[str, str], scene=("day",)) -> DataFrame:
    """The points with z-scores (population deviation within the scene; 1 where it is 0) of columns under new names. Means come from a join with
    one row per scene."""
    stats = points.groupBy(*scene).agg(*(f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))) if scene else points.agg(*(f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    joined = points.join(F.broadcast(stats), list(scene)) if scene else points.crossJoin(F.broadcast(stats))
    z = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)).alias(name) for c, name in columns.items()]
    return joined.select(*points.columns, *z)


def cluster_stats(rows: DataFrame) -> DataFrame:
    """Measures of each cluster of each day. The second pass needs the centroid, which comes from a join with one row per cluster."""
    members = rows.filter("label is not null").withColumn("power", F.when(F.coalesce("frp", F.lit(0.0)) == 0, 0.5).otherwise(F.col("frp"))).withColumn("conf", confidence("conf_raw"))
    n = F.count("*")
    centroid = members.groupBy("day", "label").agg((exact_sum("lon") / n).alias("c_lon"), (exact_sum("lat") / n).alias("c_lat"))
    away = members.join(centroid, ["day", "label"]).withColumn("km", haversine_km(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")))
    stats = away.groupBy("day", "label").agg(
        n.alias("n"), exact_sum("power").alias("frp_sum"), (exact_sum("power") / n).alias("frp_mean"), F.max("power").alias("frp_max"),
        (F.count_if((F.col("conf") >= 70) | F.col("conf").isNull()) * 100.0 / n).alias("hi_pct"), (F.count_if("night") * 100.0 / n).alias("night_pct"),
        rounded(F.first("c_lon"), 4).alias("c_lon"), rounded(F.first("c_lat"), 4).alias("c_lat"), rounded(F.avg("km"), 1).alias("radius_km"), rounded(F.max("km"), 1).alias("spread_km"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
    )
    return stats.withColumn("cluster_id", F.format_string("F-%03d", "label")).withColumn("class", cluster_class("n", "frp_sum"))


def cluster_sensor_mix(rows: DataFrame) -> DataFrame:
    """Detections of each sensor in each cluster, their whole percentage, and whether the sensor leads (of equals the first seen)."""
    counts = rows.filter("label is not null").groupBy("day", "label", "sensor").agg(F.count("*").alias("n"), F.min("pt_seq").alias("first_seen"))
    w = Window.partitionBy("day", "label")
    leads = F.row_number().over(w.orderBy(F.desc("n"), "first_seen")) == 1
    return counts.select("day", "label", "sensor", "n", rounded(F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct"), leads.alias("leads"))


def cluster_classes(stats: DataFrame) -> DataFrame:
    """Clusters of each class, classes without any too."""
    order = ["MEGAFIRE", "ESTABLISHED", "EMERGING", "SCATTERED"]
    classes = stats.sparkSession.createDataFrame([(c,) for c in order], "class string")
    return classes.join(stats.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def segmentation_summary(rows: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """Per day: detections, those in no cluster, and the share inside clusters."""
    total = F.count("*")
    inside = F.count("label")
    return rows.groupBy("day").agg(total.alias("total"), (total - inside).alias("scattered"), (inside * 100.0 / total).alias("clustered_pct"), F.lit(eps).alias("eps"), F.lit(min_pts).alias("min_pts"))


def weak_labels(points: DataFrame, eps: float = 0.12, min_pts: int = 6) -> DataFrame:
    """pt_seq and training label: the class of its cluster by standardized place within the day, ISOLATED outside clusters."""
    scaled = standardized(points.select("pt_seq", "day", "frp", "lat", "lon"), {"lat": "z_lat", "lon": "z_lon"}).drop("lat", "lon")
    found = labelled(scaled, eps, min_pts, dims=("z_lat", "z_lon"))
    sizes = found.filter("label is not null").groupBy("day", "label").agg(F.count("*").alias("n"), exact_sum("frp").alias("s"))
    joined = found.select("pt_seq", "day", "label").join(sizes, ["day", "label"], "left")
    return joined.select("pt_seq", F.when(F.col("label").isNull(), "ISOLATED").otherwise(weak_label("n", "s")).alias("behavior"))


def complex_stats(points: DataFrame, eps: float = 0.12, min_pts: int = 6, k: int | None = None) -> DataFrame:
    """Complexes over all rows by standardized place and log power, with their measures, rank by power and class; those under min_pts are left out."""
    scaled = standardized(points.withColumn("log_frp", F.log1p("frp")), {"lat": "z_lat", "lon": "z_lon", "log_frp": "z_frp"}, scene=()).withColumn("scene", F.lit(0)).drop("acq_hour", "log_frp")
    found = labelled(scaled, eps, min_pts, scene=("scene",), dims=("z_lat", "z_lon", "z_frp")).filter("label is not null").withColumn("conf", confidence_training("conf_raw"))
    n = F.count("*")
    stats = found.groupBy((F.col("label") - 1).alias("complex_id")).agg(
        n.alias("detections"), rounded(exact_sum("frp"), 1).alias("total_frp_mw"), rounded(exact_sum("frp") / n, 1).alias("mean_frp_mw"), rounded(F.max("frp"), 1).alias("max_frp_mw"),
        rounded(F.sum("conf") / n, 1).alias("mean_confidence"), F.array_join(F.sort_array(F.collect_set("sensor")), "+").alias("sensors"),
        rounded(exact_sum("lat") / n, 4).alias("centroid_lat"), rounded(exact_sum("lon") / n, 4).alias("centroid_lon"), F.count_distinct("day").alias("acq_days"),
        rounded(F.count_if("night") / n, 3).alias("night_fraction"),
    ).filter(F.col("detections") >= min_pts)
    rank = F.row_number().over(Window.orderBy(F.desc("total_frp_mw"), "complex_id"))  # one row per complex
    ranked = stats.withColumn("rank", rank).withColumn("class", complex_class("detections", "total_frp_mw"))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Open ring of a monotone chain without collinear points; fewer than three points as they are."""
    if len(points) < 3:
        return points
    ordered = points[np.lexsort((points[:, 1], points[:, 0]))].tolist()

    def chain(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(ordered) + chain(ordered[::-1])
    return np.array(ring) if ring else points[:3]


def hull_measures(ring: np.ndarray, lat0: float) -> tuple[float, float]:
    """Area (km2) by the shoelace rule and perimeter (km), each edge at its own latitude."""
    following = np.roll(ring, -1, axis=0)
    step = following - ring
    area = abs((step[:, 0] * max(0.2, np.cos(np.radians(lat0))) * KM_LON * (following[:, 1] + ring[:, 1]) * KM_LAT).sum() / 2)
    at = np.maximum(0.2, np.cos(np.radians(ring[:, 1])))
    return float(area), float(np.hypot(step[:, 0] * KM_LON * at, step[:, 1] * KM_LAT).sum())


def cluster_hulls(found: DataFrame) -> DataFrame:
    """Hull, area, perimeter and elongation of each cluster. Only the extremes of thin columns of places go to the hull, as all others lie inside."""
    members = found.filter("label is not null")
    column = F.floor(F.col("lon") * 1000)
    # of the points of one longitude only the northernmost and the southernmost can be on the hull
    thin = members.groupBy("day", "label", column.alias("column"), "lon").agg(F.min("lat").alias("low"), F.max("lat").alias("high"))
    centre = members.groupBy("day", "label").agg((exact_sum("lat") / F.count("*")).alias("lat0"), (exact_sum("lon") / F.count("*")).alias("lon0"), F.count("*").alias("n"))
    radius = members.join(centre, ["day", "label"]).groupBy("day", "label").agg(F.avg(haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))).alias("radius"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        points = np.unique(np.concatenate([rows[["lon", "low"]].to_numpy(float), rows[["lon", "high"]].to_numpy(float)]), axis=0)
        ring = convex_hull(points)
        if len(ring) >= 3:
            area, around = hull_measures(ring, first["lat0"])
        else:
            area, around = np.pi * first["radius"] ** 2, 2 * np.pi * first["radius"]
        stretch = around / (2 * np.sqrt(np.pi * area)) if area > 1 else 1.0
        return pd.DataFrame({"day": [first["day"]], "label": [int(first["label"])], "hull": [ring.tolist()], "area_km2": [float(np.floor(area + 0.5))], "perimeter_km": [float(around)], "elongation": [float(np.floor(stretch * 100 + 0.5) / 100)]})

    joined = thin.join(centre, ["day", "label"]).join(radius, ["day", "label"])
    return joined.groupBy("day", "label").applyInPandas(one, "day date, label int, hull array<array<double>>, area_km2 double, perimeter_km double, elongation double")


def behavior_votes(rows: DataFrame, column: str = "behavior") -> DataFrame:
    """day, label, behavior, n, pct (whole), leads: the classes that a model gives the members of each cluster; of equals the first seen leads.
    Members without a class do not vote."""
    counts = rows.filter(F.col("label").isNotNull() & F.col(column).isNotNull()).groupBy("day", "label", F.col(column).alias("behavior")).agg(F.count("*").alias("n"), F.min("pt_seq").alias("first_seen"))
    w = Window.partitionBy("day", "label")  # classes are few
    leads = F.row_number().over(w.orderBy(F.desc("n"), "first_seen")) == 1
    return counts.select("day", "label", "behavior", "n", rounded(F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct"), leads.alias("leads"))


def behavior_mix(rows: DataFrame, column: str = "behavior") -> DataFrame:
    """day, behavior, n over all detections of a day, in clusters or not."""
    return rows.filter(F.col(column).isNotNull()).groupBy("day", F.col(column).alias("behavior")).agg(F.count("*").alias("n"))
