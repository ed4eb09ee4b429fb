"""Forests by flat nodes, regimes, and logistic regression against plain versions."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler

from burncal.operators import cluster, forest, logistic, models, raster, regimes
from burncal.sources import fixtures
from tests.conftest import SF


@pytest.fixture(scope="module")
def fitted(spark):
    rows = fixtures.detections(spark, SF)
    features = models.classifier_features(rows, cluster.density_features(rows)).cache()
    return models.train_classifier(features.join(cluster.weak_labels(rows, 0.3, 3), "pt_seq"), trees=6, depth=5), features


def test_flat_nodes_equal_the_model(spark, fitted):
    model, features = fitted
    scored = {r.pt_seq: r.probability.toArray() for r in model.stages[2].transform(model.stages[1].transform(features)).collect()}
    rows = features.toPandas()
    found = forest.flat(forest.nodes_of(spark, model.stages[2])).probabilities(rows[list(models.CLASSIFIER_FEATURES)].to_numpy(float))
    assert all(np.abs(found[k] - scored[i]).max() < 1e-12 for k, i in enumerate(rows["pt_seq"]))


def test_sql_over_nodes(spark, fitted):
    """Another engine walks the exported table and gives the same classes and probabilities."""
    model, features = fitted
    nodes = forest.nodes_of(spark, model.stages[2]).toPandas()  # noqa: F841
    rows = features.toPandas()
    wide = rows[["pt_seq"]].assign(x=list(rows[list(models.CLASSIFIER_FEATURES)].to_numpy(float)))  # noqa: F841
    labels = model.stages[0].labels
    said = duckdb.sql(
        """with recursive walk as (select pt_seq, tree, 0 as node, x from wide, (select distinct tree from nodes) t
             union all select w.pt_seq, w.tree, case when w.x[n.feature+1] <= n.threshold then n.left else n.right end, w.x from walk w join nodes n on n.tree=w.tree and n.node=w.node where n.feature >= 0),
           votes as (select pt_seq, c, avg(weights[c]/list_sum(weights)) as p from walk join nodes n using (tree, node), unnest(range(1, len(weights)+1)) g(c) where n.feature < 0 group by 1, 2)
           select pt_seq, cast(c as int)-1 as c, floor(p*1000+0.5)/1000 as p from (select *, row_number() over (partition by pt_seq order by p desc, c) as r from votes) v where r=1"""
    ).fetchall()
    found = {r.pt_seq: (r.behavior, r.p) for r in models.forest_scores(model, features).collect()}
    assert len(said) == len(found) == 1000
    assert sum(found[i] != (labels[c], p) for i, c, p in said) <= 2  # sums of votes in another order can tie or round otherwise


def test_forests_depend_on_the_rows_alone(spark, fitted):
    """Rows dealt otherwise, and chosen before or after, give the same nodes; what a level shuffles does not grow with the parts of the input."""
    _, features = fitted
    known = features.join(cluster.weak_labels(fixtures.detections(spark, SF), 0.3, 3), "pt_seq").cache()
    nodes = lambda rows, most: sorted(map(str, forest.nodes_of(spark, models.train_classifier(rows, trees=3, depth=4, most=most).stages[2]).collect()))
    one = nodes(known.repartition(3), 400)
    assert one == nodes(known.repartition(31, "hour"), 400) == nodes(models.learnt_rows(known, 400), models.ALL)


def test_box_counts_beside_the_points(spark):
    rows = fixtures.detections(spark, SF)
    beside = raster.with_box_counts(rows)
    assert beside.columns[: len(rows.columns)] == rows.columns
    one, two = (sorted(models.classifier_features(rows, d).collect()) for d in (raster.box_counts(rows), beside))
    assert one == two and len(one) == rows.count()


def test_odd_forests(spark):
    one = forest.Nodes(np.array([0]), np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.array([[0.25, 0.75]]))
    frame = spark.createDataFrame([(1, None), (2, 3.0)], "pt_seq long, a double")
    assert [tuple(r) for r in forest.score(frame, one, ["a"], ["x", "y"], ("pt_seq",)).orderBy("pt_seq").collect()] == [(1, "y", 0.75), (2, "y", 0.75)]
    assert forest.score(frame.limit(0), one, ["a"], ["x", "y"], ("pt_seq",)).count() == 0


def plain_regimes(rows, k, rounds):
    x = {i: v for i, *v in rows}
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    centres = [x[min(x)]]
    while len(centres) < k:
        far = max(x, key=lambda i: (min(away(x[i], c) for c in centres), -i))
        centres.append(x[far])
    for _ in range(rounds):
        at = {i: min(range(k), key=lambda j: (away(v, centres[j]), j)) for i, v in x.items()}
        for j in set(at.values()):
            own = [x[i] for i in at if at[i] == j]
            centres[j] = [sum(c) // len(own) for c in zip(*own)]
    return {i: min((away(v, c), j) for j, c in enumerate(centres)) for i, v in x.items()}


@pytest.mark.parametrize("k, n", [(4, 120), (3, 3), (5, 2)])
def test_regimes(spark, k, n):
    rng = np.random.default_rng(8)
    rows = [(int(i), *(int(v) for v in rng.integers(-9, 9, 4) * 1000 + rng.integers(0, 3))) for i in range(10, 10 + n)] + [(500 + i, 5, 5, 5, 5) for i in range(n // 3)]
    frame = spark.createDataFrame(rows, "pt_seq long, u0 long, u1 long, u2 long, u3 long").repartition(3)
    found = regimes.regimes(frame, k, 12)
    assert {r.pt_seq: (r.distance, r.regime) for r in found.collect()} == plain_regimes(rows, k, 12)
    one = regimes.silhouette(found).first()
    assert one.n == len(rows) and one.groups == len({r.regime for r in found.collect()})
    if one.groups > 1:
        ml = ClusteringEvaluator(predictionCol="regime").evaluate(VectorAssembler(inputCols=["u0", "u1", "u2", "u3"], outputCol="features").transform(found))
        assert abs(one.silhouette - ml) < 1e-6
    else:
        assert one.silhouette == 0


def test_no_regimes(spark):
    none = spark.createDataFrame([], "pt_seq long, u0 long, u1 long, u2 long, u3 long")
    assert regimes.regimes(none).count() == 0 and regimes.silhouette(regimes.regimes(none)).count() == 0


def plain_logistic(x, y, penalty):
    """Newton's method on all rows at once."""
    mean, scale = x.mean(0), x.std(0)
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / np.where(scale > 0, scale, 1)], 1)
    w = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    beta, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [penalty] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    return beta, 1 / (1 + np.exp(-z @ beta))


@pytest.mark.parametrize("penalty", [1.0, 0.01])
def test_logistic(spark, penalty):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3)) * [1, 50, 0.1] + [5, -3, 0]
    y = (x[:, 0] + x[:, 1] / 30 + rng.normal(size=600) > 6).astype(int)
    rows = [(*map(float, a), 4.0, int(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 4.0, 1), (1.0, 1.0, 1.0, 4.0, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, same double, y int").repartition(7)
    found = logistic.fit(frame, ["a", "b", "c", "same"], penalty=penalty)
    beta, p = plain_logistic(np.concatenate([x, np.full((600, 1), 4.0)], 1), y, penalty)
    assert np.abs(np.array([found.intercept, *found.coef]) - beta).max() < 1e-7 and found.steps < 20
    got = sorted(r.p for r in frame.na.drop().select(found.probability().alias("p")).collect())
    assert np.abs(np.array(got) - np.sort(p)).max() < 1e-7


def test_logistic_of_one_label(spark):
    found = logistic.fit(spark.createDataFrame([(float(i), 0) for i in range(20)], "a double, y int"), ["a"], steps=5)
    assert found.steps <= 5 and np.isfinite([found.intercept, *found.coef]).all()


def test_medians(spark):
    """The upper one of an even number, and 1 where it is 0."""
    rows = fixtures.detections(spark, SF).limit(200)
    found = models.classifier_features(rows, cluster.density_features(rows)).collect()
    power = {r.pt_seq: (r.day, r.frp) for r in rows.collect()}
    for r in found:
        day = sorted(f for d, f in power.values() if d == r.day)
        assert abs(r.frp_ratio - power[r.pt_seq][1] / (day[len(day) // 2] or 1.0)) < 1e-12


def test_forests_learn_from_all_rows(spark):
    """More rows than forests once took: leaves weigh as much as there are rows, as every tree draws as many as it is given."""
    n = 30_000
    rows = spark.range(n).selectExpr("id as pt_seq", "if(id % 3 = 0, 'a', 'b') as behavior", *(f"cast(id % {7 + k} as double) as {c}" for k, c in enumerate(models.CLASSIFIER_FEATURES)))
    nodes = forest.nodes_of(spark, models.train_classifier(rows, trees=2, depth=2).stages[2])
    roots = nodes.filter("node = 0").collect()
    assert len(roots) == 2 and all(0.97 * n < sum(r.weights) < 1.03 * n for r in roots)


def test_forest_votes_choose_no_rows(spark, monkeypatch):
    """The query hands every detection of all days but the last to the forest."""
    from burncal.plans import clusters

    rows, given, train = fixtures.detections(spark, SF), [], models.train_classifier
    monkeypatch.setattr(models, "train_classifier", lambda df, **known: given.append(df.count()) or train(df, trees=2, depth=2, **known))
    monkeypatch.setattr(models.learnt_rows, "__defaults__", (50, 42)[-len(models.learnt_rows.__defaults__) :])
    assert clusters.forest_scores(spark, SF).count() == rows.count()
    last = rows.groupBy("day").count().orderBy("day", ascending=False).first()
    assert given == [rows.count() - last["count"]]
