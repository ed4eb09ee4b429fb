"""Models on pyspark.ml, and the published linear model as one expression."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burncal.functions.constants import EVENT_MODEL, REGIONS
from burncal.functions.scalars import confidence, confidence_training, exact_sum, linear, month_of, next_month, rounded, sigmoid
from burncal.operators import forest
from burncal.operators.harmonize import all_sensor_months
from burncal.session import cut

CLASSIFIER_FEATURES = ("log_frp", "conf", "night_n", "hour", "is_viirs", "dens_0", "dens_1", "dens_2", "frp_ratio")
BALANCED = "weight"
ALL = 1 << 62
FOREST_PARTS = 8  # at least, of the rows that a forest learns from; each sends the counts of all open nodes at every level
PART_ROWS = 1_000_000  # of such a part


def event_scores(calendar: DataFrame, least: int = 15, model: dict = EVENT_MODEL) -> DataFrame:
    """Chance of an extreme month after each region's last, with band; regions with too few months are left out. Regions that the model does not
    know count as its first."""
    w = Window.partitionBy("region").orderBy("ym")
    rows = all_sensor_months(calendar).select(
        "*", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("region")).alias("n"), (F.sum("est").over(w.rowsBetween(-2, 0)) / F.least(F.row_number().over(w), F.lit(3))).alias("mean3")
    )
    year_ago = rows.select("region", next_month("ym", 12).alias("ym"), F.col("est").alias("ago"))
    last = rows.filter((F.col("i") == F.col("n")) & (F.col("n") >= least)).join(year_ago, ["region", "ym"], "left")
    ahead = month_of("ym") % 12 + 1
    angle = F.lit(6.283185307179586) * ahead / 12
    features = [F.log1p("est"), F.log1p("mean3"), F.log1p(F.coalesce("ago", "est")), F.log1p("frp"), F.col("hi_share"), F.col("night_share"), F.sin(angle), F.cos(angle)]
    features += [F.when(F.lower("region") == r, 1.0).otherwise(0.0) for r in list(REGIONS)[1:]]
    p = sigmoid(linear(features, model["mean"], model["scale"], model["coef"], model["intercept"]))
    return last.select("region", next_month("ym").alias("target_ym"), rounded(p, 3).alias("p"), F.when(p >= 0.5, "high").when(p >= 0.25, "elevated").otherwise("low").alias("band"))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weights that give each label the same sum; labels are few."""
    counts = df.groupBy(label).count()
    total = counts.agg(F.sum("count").alias("total"), F.count("*").alias("kinds"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("total") / (F.col("kinds") * F.col("count"))).alias(BALANCED))
    return df.join(F.broadcast(weights), label)


def train_logistic(df: DataFrame, features: list[str], label: str = "y", seed: int = 42):
    """Standardized, balanced logistic regression."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol=BALANCED, maxIter=200)]
    return Pipeline(stages=stages).fit(balanced(df, label))


def learnt_rows(df: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """About `most` rows, those with the smallest hashes of their ids; all rows if there are no more. For those who ask for a small forest; no query does."""
    share = most / max(most, df.count())
    return df.filter(F.xxhash64("pt_seq", F.lit(seed)) / F.lit(float(1 << 64)) + 0.5 < share) if share < 1 else df


def train_classifier(df: DataFrame, label: str = "behavior", trees: int = 40, depth: int = 12, seed: int = 42, most: int = ALL):
    """A forest over the features of a detection, from all labelled rows (or about `most`, those with the smallest hashes of their ids). Bags are drawn by part and
    place in it, so rows are dealt by their ids: the forest depends on the rows alone, and what its levels shuffle not on the number of tasks before."""
    rows = learnt_rows(df, most, seed) if most < ALL else df
    rows = rows.select("pt_seq", label, *CLASSIFIER_FEATURES)
    rows = rows.repartition(max(FOREST_PARTS, rows.count() // PART_ROWS), "pt_seq").sortWithinPartitions("pt_seq")
    stages = [StringIndexer(inputCol=label, outputCol="y"), VectorAssembler(inputCols=list(CLASSIFIER_FEATURES), outputCol="features"), RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def regimes(df: DataFrame, features: list[str], k: int = 6, seed: int = 42) -> DataFrame:
    """Rows with the number of their KMeans cluster."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return KMeans(k=k, seed=seed).fit(assembled).transform(assembled).withColumnRenamed("prediction", "regime").drop("features")


def classifier_features(points: DataFrame, densities: DataFrame, group: str = "day", hour_bug: bool = False) -> DataFrame:
    """The nine features of each detection. The power ratio is to the group's upper median (1 for none); with hour_bug midnight counts as noon. Densities that
    come with all columns of the points (`raster.with_box_counts`) need no join."""
    upper = F.expr("percentile_disc(0.5) within group (order by frp desc)")  # of an even number the upper one
    medians = points.groupBy(group).agg(upper.alias("median")).withColumn("median", F.when(F.col("median") != 0, F.col("median")).otherwise(1.0))
    hour = F.when(F.lit(hour_bug) & (F.col("acq_hour") == 0), 12).otherwise(F.col("acq_hour"))
    joined = (densities if set(points.columns) <= set(densities.columns) else points.join(densities, "pt_seq")).join(F.broadcast(medians), group)
    return joined.select(
        "pt_seq", "day", F.log1p("frp").alias("log_frp"), F.coalesce(confidence("conf_raw"), F.lit(60)).alias("conf"), F.col("night").cast("int").alias("night_n"), hour.alias("hour"),
        F.col("sensor").startswith("VIIRS").cast("int").alias("is_viirs"), "dens_0", "dens_1", "dens_2", (F.col("frp") / F.col("median")).alias("frp_ratio"),
    )


def binary_metrics(df: DataFrame, label: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, Brier score and IoU of the positive class."""
    hit, said, true = F.count_if((F.col(p) >= threshold) & (F.col(label) == 1)), F.count_if(F.col(p) >= threshold), F.count_if(F.col(label) == 1)
    right = F.count_if((F.col(p) >= threshold) == (F.col(label) == 1))
    return df.agg((right / F.count("*")).alias("accuracy"), F.try_divide(hit, said).alias("precision"), F.try_divide(hit, true).alias("recall"), F.try_divide(2 * hit, said + true).alias("f1"), F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"), F.try_divide(hit, said + true - hit).alias("iou"))


def ranking_metrics(df: DataFrame, label: str = "y", p: str = "p") -> DataFrame:
    """One row: n, positives, auc (area under the ROC curve, ties count half) and ap (mean precision at each step of recall). Rows are reduced to
    distinct scores; running totals come from range partitions and the sums of those before, so no task sees all scores."""
    scores = df.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    dealt = cut(scores.repartitionByRange(F.desc("p")).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = dealt.groupBy("part").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("a", "pos0"), ("b", "neg0"))))
    inside = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    steps = dealt.join(F.broadcast(offsets), "part").select("pos", "neg", (F.col("pos0") + F.sum("pos").over(inside)).alias("tp"), (F.col("neg0") + F.sum("neg").over(inside)).alias("fp"))
    under = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    precise = F.sum((F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).cast("decimal(28,12)")).cast("double")
    n1, n0 = F.sum("pos"), F.sum("neg")
    return steps.agg((n1 + n0).alias("n"), n1.alias("positives"), F.try_divide(under, n1 * n0).alias("auc"), F.try_divide(precise, n1).alias("ap"))


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    """truth, said, n: how often each class is given to each."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, said: str) -> DataFrame:
    """One row: n, accuracy and macro_f1, the mean over all classes that are true or said of somebody. Classes are few."""
    table = confusion(df, truth, said)
    each = table.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).alias("s")), F.struct(F.col("said").alias("class"), F.lit(0).alias("t"), F.col("n").alias("s")))).alias("c"), F.lit(0).alias("hit"))
    each = each.select("c.class", "c.t", "c.s", "hit").unionByName(table.filter("truth = said").select(F.col("truth").alias("class"), F.lit(0).alias("t"), F.lit(0).alias("s"), F.col("n").alias("hit")))
    f1 = each.groupBy("class").agg((F.sum("hit") * 2.0 / (F.sum("t") + F.sum("s"))).alias("f1")).agg(F.avg("f1").alias("macro_f1"))
    whole = table.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return whole.crossJoin(F.broadcast(f1))


def group_profile(df: DataFrame, by: str) -> DataFrame:
    """What sets the groups (regimes) apart: n, mean power and confidence, share of the night, mean hour, to three decimals."""
    mean = lambda c: rounded(F.sum(c) / F.count("*"), 3)
    conf = F.sum(confidence_training("conf_raw"))
    return df.groupBy(by).agg(
        F.count("*").alias("n"), rounded(exact_sum("frp") / F.count("*"), 3).alias("mean_frp"), rounded(conf / F.count("*"), 3).alias("mean_conf"),
        rounded(F.count_if("night") / F.count("*"), 3).alias("night_frac"), mean("acq_hour").alias("mean_hour"),
    )


def forest_scores(model, features: DataFrame) -> DataFrame:
    """pt_seq, day, behavior and p of each detection by a model of train_classifier: the mean of the trees' class probabilities, and the class where it is
    largest."""
    nodes = forest.flat(forest.nodes_of(features.sparkSession, model.stages[-1]))
    return forest.score(features, nodes, list(CLASSIFIER_FEATURES), model.stages[0].labels)


def silhouette(df: DataFrame, features: list[str], k: int = 6, seed: int = 42, sample: int | None = None) -> float:
    """Squared-distance silhouette of a KMeans clustering, with `sample` of about so many rows of it."""
    if sample:
        n = df.count()
        df = df.sample(min(1.0, sample / max(1, n)), seed)
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(assembled).transform(assembled))


def linear_weights(fitted) -> dict:
    """Features, scaler and coefficients of a model of train_logistic, as plain numbers."""
    assembler, scaler, model = fitted.stages
    return {"features": assembler.getInputCols(), "mean": scaler.mean.toArray().tolist(), "scale": scaler.std.toArray().tolist(), "coef": model.coefficients.toArray().tolist(), "intercept": model.intercept}


def train_boosted(df: DataFrame, features: list[str], label: str = "label", rounds: int = 60, depth: int = 5, rate: float = 0.08, seed: int = 42):
    """Balanced boosted trees."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), GBTClassifier(labelCol=label, weightCol=BALANCED, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)]
    return Pipeline(stages=stages).fit(balanced(df, label))


def train_footprint(cells: DataFrame, features: list[str], boosted: bool = False):
    """The footprint model fitted on all days but the last, and its scores of the last day beside a persistence baseline: the cells whose density of the
    last day is over that of three fifths of the cells that came true (without any, of 95 % of all cells)."""
    from burncal.operators.selections import split_by_last_day

    train, test = split_by_last_day(cells.withColumnRenamed("target", "day"))
    fitted = train_boosted(train, features) if boosted else train_logistic(train, features, "label")
    scored = fitted.transform(test).select("day", "i", "j", "label", F.element_at(vector_to_array("probability"), 2).alias("p"), "last_day")
    bound = scored.agg(F.coalesce(F.percentile(F.when(F.col("label") == 1, F.col("last_day")), 0.6), F.percentile("last_day", 0.95)).alias("bound"))  # one row
    return fitted, scored.crossJoin(F.broadcast(bound)).withColumn("persistence", (F.col("last_day") >= F.col("bound")).cast("double")).drop("bound")
