"""Numbers of points within radii of each point, from a pyramid of cell counts.

The plane of a scene is cut into cells of the largest radius, these into halves of their sides, and so on. Pairs of touching cells are judged
by the boxes around their points: boxes that lie within the radius as a whole give each other's points their counts, without looking at any
point; boxes further apart give nothing; of what is left the halves are judged, and once two cells have few places the places are compared. So a hot
cell of n points costs its rim, not n x n, and points at one place are one place with a number. Counts that cells have got go down to their
halves and at last to the places.

All steps are joins and sums over cells or pairs of cells. No group has more rows than a cell has halves or, at the end, TESTED pairs of places.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burncal.session import cut

TESTED = 8  # pairs of places of two cells that are compared without cutting the cells
DEEPEST = 40
SLACK = 1e-9


@dataclass
class Work:
    """How many pairs of cells were judged, and of places compared."""

    judged: int = 0
    compared: int = 0


def squared(parts: list[Column]) -> Column:
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _level(places: DataFrame, level: int, side: float, scene, dims) -> DataFrame:
    """The cells of a level: number, places and points in each, and the box around them."""
    ends = [f for k, x in enumerate(dims) for f in (F.min(x).alias(f"low{k}"), F.max(x).alias(f"high{k}"))]
    return _placed(places, level, side, scene, dims).groupBy(*scene, *(f"c{k}" for k in range(len(dims)))).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), *ends)


def _placed(places: DataFrame, level: int, side: float, scene, dims) -> DataFrame:
    """Cells are numbered by floors of x / side * 2 ** level; the factor is exact, so a number halved is the number one level up."""
    return places.withColumns({f"c{k}": F.floor(F.col(x) / side * float(1 << level)) for k, x in enumerate(dims)})


def _renamed(rows: DataFrame, prefix: str, keep) -> DataFrame:
    return rows.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in rows.columns))


def _judged(pairs: DataFrame, radii, d: int) -> DataFrame:
    """The pairs whose radius they may be within, with `sure` where they are as a whole."""
    r2 = F.element_at(F.array(*(F.lit(r * r) for r in radii)), F.col("r") + 1)
    gap = squared([F.greatest(F.lit(0.0), F.col(f"b_low{k}") - F.col(f"a_high{k}"), F.col(f"a_low{k}") - F.col(f"b_high{k}")) for k in range(d)])
    span = squared([F.greatest(F.col(f"b_high{k}") - F.col(f"a_low{k}"), F.col(f"a_high{k}") - F.col(f"b_low{k}")) for k in range(d)])
    return pairs.withColumn("sure", span <= r2 * (1 - SLACK)).filter(gap <= r2 * (1 + SLACK))


def radius_counts(points: DataFrame, radii, scene=("day",), dims=("lon", "lat"), work: Work | None = None, tested: int = TESTED) -> DataFrame:
    """pt_seq and n_0, n_1, ...: the points of the scene within each radius, the point itself counted. Points without a place have none."""
    scene, dims, radii, side = list(scene), list(dims), list(radii), float(max(radii))
    d = len(dims)
    cell = [f"c{k}" for k in range(d)]
    places = cut(points.na.drop(subset=[*scene, *dims]).groupBy(*scene, *dims).agg(F.count(F.lit(1)).alias("n")))
    ids_a, ids_b = [f"a_{c}" for c in cell], [f"b_{c}" for c in cell]
    same = [F.col(a) == F.col(b) for a, b in zip(ids_a, ids_b)]
    alike = same[0]
    for s in same[1:]:
        alike = alike & s
    ordered = F.struct(*ids_a) <= F.struct(*ids_b)
    gained: list[DataFrame] = []  # by level: scene, cell, r, add
    compared: list[DataFrame] = []  # scene, place, r, add
    nodes = _level(places, 0, side, scene, dims)
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=d) if o >= (0,) * d]
    around = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"o{k}") for k, x in enumerate(o))) for o in offsets)))
    a = _renamed(nodes, "a_", scene).withColumn("o", around)
    a = a.withColumns({f"b_c{k}": F.col(f"a_c{k}") + F.col(f"o.o{k}") for k in range(d)}).drop("o")
    pairs = a.join(_renamed(nodes, "b_", scene), [*scene, *ids_b]).withColumn("r", F.explode(F.array(*(F.lit(k) for k in range(len(radii))))))
    for level in range(DEEPEST + 1):
        judged = cut(_judged(pairs, radii, d))
        found = judged.filter("sure")
        to_a = found.select(*scene, *(F.col(x).alias(c) for x, c in zip(ids_a, cell)), "r", F.col("b_n").alias("add"))
        to_b = found.filter(~alike).select(*scene, *(F.col(x).alias(c) for x, c in zip(ids_b, cell)), "r", F.col("a_n").alias("add"))
        gained.append(to_a.unionByName(to_b).groupBy(*scene, *cell, "r").agg(F.sum("add").alias("add")))
        few = (F.col("a_m") * F.col("b_m") <= tested) | F.lit(level == DEEPEST)
        rest = judged.filter(~F.col("sure"))
        shown = rest.agg(F.count_if(few), F.count_if(~few), F.sum(F.when(few, F.when(alike, F.col("a_m") * F.col("a_m")).otherwise(F.col("a_m") * F.col("b_m"))))).first()
        if work is not None:
            work.judged += judged.count()
            work.compared += shown[2] or 0
        if shown[0]:
            compared.append(_compare(rest.filter(few), _placed(places, level, side, scene, dims), radii, scene, dims, alike))
        if not shown[1]:
            break
        open_ = rest.filter(~few).select(*scene, *ids_a, *ids_b, "r")
        nodes = _level(places, level + 1, side, scene, dims)
        halves = nodes.withColumns({f"p{k}": F.shiftright(c, 1) for k, c in enumerate(cell)})
        up = [f"p{k}" for k in range(d)]
        left = open_.withColumnsRenamed({x: p for x, p in zip(ids_a, up)}).withColumnsRenamed({x: f"q_{x}" for x in ids_b})
        left = left.join(_renamed(halves, "a_", [*scene, *up]), [*scene, *up])
        left = left.withColumn("own", _all([F.col(p) == F.col(f"q_{x}") for p, x in zip(up, ids_b)])).drop(*up).withColumnsRenamed({f"q_{x}": p for x, p in zip(ids_b, up)})
        pairs = left.join(_renamed(halves, "b_", [*scene, *up]), [*scene, *up]).filter(~F.col("own") | ordered).drop("own", *up)
    counts = _down(places, gained, side, scene, dims)
    for found in compared:
        counts = counts.unionByName(found)
    by_place = counts.groupBy(*scene, *dims).agg(*(F.coalesce(F.sum(F.when(F.col("r") == k, F.col("add"))), F.lit(0)).alias(f"n_{k}") for k in range(len(radii))))
    return points.select("pt_seq", *scene, *dims).join(by_place, [*scene, *dims], "left").select("pt_seq", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in range(len(radii))))


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found & c
    return found


def _compare(pairs: DataFrame, placed: DataFrame, radii, scene, dims, alike: Column) -> DataFrame:
    """What the places of pairs of cells give each other: scene, place, r, add."""
    cell = [f"c{k}" for k in range(len(dims))]
    side = lambda p: placed.select(*scene, *(F.col(c).alias(f"{p}_{c}") for c in cell), *(F.col(x).alias(f"{p}_{x}") for x in dims), F.col("n").alias(f"{p}_n"))
    ids = pairs.select(*scene, "r", *(f"{p}_{c}" for p in "ab" for c in cell))
    met = ids.join(side("a"), [*scene, *(f"a_{c}" for c in cell)]).join(side("b"), [*scene, *(f"b_{c}" for c in cell)])
    r2 = F.element_at(F.array(*(F.lit(r * r) for r in radii)), F.col("r") + 1)
    close = met.filter(squared([F.col(f"a_{x}") - F.col(f"b_{x}") for x in dims]) <= r2)
    both = [F.struct(*(F.col(f"{p}_{x}").alias(x) for x in dims), F.col(f"{q}_n").alias("add")) for p, q in ("ab", "ba")]
    given = close.select(*scene, "r", F.explode(F.when(alike, F.array(both[0])).otherwise(F.array(*both))).alias("g"))
    return given.groupBy(*scene, *(F.col(f"g.{x}").alias(x) for x in dims), "r").agg(F.sum("g.add").alias("add"))


def _down(places: DataFrame, gained: list[DataFrame], side: float, scene, dims) -> DataFrame:
    """What the cells of all levels have got, summed at their places: scene, place, r, add."""
    cell = [f"c{k}" for k in range(len(dims))]
    held = gained[0]
    for level, own in enumerate(gained[1:], 1):
        nodes = _level(places, level, side, scene, dims).select(*scene, *cell, *(F.shiftright(c, 1).alias(f"p{k}") for k, c in enumerate(cell)))
        above = nodes.join(held.withColumnsRenamed({c: f"p{k}" for k, c in enumerate(cell)}), [*scene, *(f"p{k}" for k in range(len(cell)))]).select(*scene, *cell, "r", "add")
        held = above.unionByName(own).groupBy(*scene, *cell, "r").agg(F.sum("add").alias("add"))
    placed = _placed(places, len(gained) - 1, side, scene, dims)
    return placed.join(held, [*scene, *cell]).select(*scene, *dims, "r", "add")
