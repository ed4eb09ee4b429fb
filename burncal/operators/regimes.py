"""Regimes of detections: k-means from a fixed start, on whole numbers, and how well its groups stand apart.

The first centre is the row with the smallest id, every further one the row that is furthest from its nearest centre (of equals the smallest id). A
round gives each row the nearest centre (of equals the first) and moves centres to the floors of their rows' means; groups without rows keep theirs.
Features are whole numbers (SCALE of a unit), so sums do not depend on their order and any engine gives the same groups. Each step is one aggregate
over the rows; the driver has the centres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burncal.functions.scalars import confidence_training, exact_sum
from burncal.session import cut

SCALE = 1_000_000
K, ROUNDS = 6, 12
FEATURES = ("u0", "u1", "u2", "u3")


def regime_features(points: DataFrame) -> DataFrame:
    """pt_seq and four whole numbers: log power, confidence, hour and night, each about a unit wide but the first."""
    whole = lambda x: F.floor(x * SCALE + F.lit(0.5)).cast("long")
    columns = (F.log1p("frp"), confidence_training("conf_raw") / 100.0, F.col("acq_hour") / 23.0, F.col("night").cast("double"))
    return points.select("pt_seq", *(whole(F.coalesce(c, F.lit(0.0))).alias(n) for n, c in zip(FEATURES, columns)))


def _distance(centre: tuple[int, ...], features) -> Column:
    terms = [(F.col(f) - F.lit(c)) * (F.col(f) - F.lit(c)) for f, c in zip(features, centre)]
    return sum(terms[1:], terms[0])


def _nearest(centres: list[tuple[int, ...]], features) -> Column:
    """distance and regime of the nearest centre."""
    return F.array_min(F.array(*(F.struct(_distance(c, features).alias("distance"), F.lit(k).alias("regime")) for k, c in enumerate(centres))))


def start(rows: DataFrame, k: int, features=FEATURES, id_col: str = "pt_seq") -> list[tuple[int, ...]]:
    first = rows.agg(F.min_by(F.struct(*features), id_col).alias("c")).first().c
    centres = [tuple(first)] if first is not None else []
    while first is not None and len(centres) < k:
        away = F.least(*(_distance(c, features) for c in centres)) if len(centres) > 1 else _distance(centres[0], features)
        centres.append(tuple(rows.agg(F.max_by(F.struct(*features), F.struct(away, -F.col(id_col))).alias("c")).first().c))
    return centres


def regimes(rows: DataFrame, k: int = K, rounds: int = ROUNDS, features=FEATURES, id_col: str = "pt_seq") -> DataFrame:
    """The rows (id and whole-number features) with regime and distance (squared)."""
    rows = cut(rows.select(id_col, *features))
    centres = start(rows, k, features, id_col)
    if not centres:
        return rows.withColumns({"regime": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")})
    exact = [F.sum(F.col(f).cast("decimal(38,0)")).alias(f) for f in features]
    for _ in range(rounds):
        sums = rows.groupBy(_nearest(centres, features)["regime"].alias("regime")).agg(F.count(F.lit(1)).alias("n"), *exact).collect()  # k rows
        moved = {r.regime: tuple(int(r[f]) // r.n for f in features) for r in sums}
        after = [moved.get(j, c) for j, c in enumerate(centres)]
        if after == centres:
            break
        centres = after
    return rows.withColumn("near", _nearest(centres, features)).select(id_col, *features, "near.regime", "near.distance")


def silhouette(found: DataFrame, features=FEATURES) -> DataFrame:
    """One row (none of no rows): groups, n, inertia and silhouette of squared distances, from the sums of each group, so no pairs of rows are looked at. A row alone in its group counts 0."""
    squares = sum((F.col(f).cast("decimal(38,0)") * F.col(f) for f in features[1:]), F.col(features[0]).cast("decimal(38,0)") * F.col(features[0]))
    stats = found.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.sum(squares.cast("decimal(38,0)")).cast("double").alias("q"), *(F.sum(F.col(f).cast("decimal(38,0)")).cast("double").alias(f) for f in features)).collect()  # a row for each group
    groups = sorted(stats, key=lambda r: r.regime)
    if not groups:
        return found.sparkSession.createDataFrame([], "groups long, n long, inertia double, silhouette double")
    own = sum((F.col(f).cast("double") * F.col(f).cast("double") for f in features[1:]), F.col(features[0]).cast("double") * F.col(features[0]).cast("double"))

    def mean_to(g) -> Column:
        """Mean squared distance to all rows of a group."""
        dot = [F.col(f).cast("double") * F.lit(g[f]) for f in features]
        return F.greatest(own - 2 * sum(dot[1:], dot[0]) / F.lit(float(g.n)) + F.lit(g.q) / F.lit(float(g.n)), F.lit(0.0))

    means = found.select("distance", (F.array_position(F.array(*(F.lit(g.regime) for g in groups)), F.col("regime")) - 1).cast("int").alias("own"), F.array(*map(mean_to, groups)).alias("m"))
    ratio = F.array(*(F.lit(g.n / (g.n - 1) if g.n > 1 else None).cast("double") for g in groups))  # the row itself is none of the others
    a = F.get("m", F.col("own")) * F.get(ratio, F.col("own"))
    b = F.array_min(F.transform("m", lambda x, k: F.when(k != F.col("own"), x)))
    each = means.select("distance", a.alias("a"), b.alias("b"))
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(s)
    n = F.count(F.lit(1))
    return each.agg(F.lit(len(groups)).cast("long").alias("groups"), n.alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).cast("double").alias("inertia"), (exact_sum(s) / n).alias("silhouette"))
