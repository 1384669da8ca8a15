"""Residual-correction models: leaf-wise boosting (absolute and quantile loss), and on Spark ML boosted trees, a wet/dry hurdle and
a quantile forest.

Each fit takes a table marked with `is_train` and `is_val` and returns (fitted stages, validation rows with
`predicted_bias`). Features are already numeric and zero-filled (`ablation_matrix_input`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import sorted_quantiles, wet
from pluvian.models import boosting
from pluvian.session import spread


@dataclass(frozen=True)
class TreeSettings:
    rounds: int = 100
    depth: int = 5
    step: float = 0.05
    bins: int = 64
    seed: int = 42
    subsample: float = 1.0
    partitions: int | None = None  # least number of parts of the training rows; the learners pass over them many times


def assembled(df: DataFrame, features: Sequence[str], settings: TreeSettings) -> DataFrame:
    """Split rows with their feature vector, written once; fits and scores all read the table."""
    df = df.where(F.col("is_train") | F.col("is_val"))
    out = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error").transform(df)
    return spread(out, settings.partitions)


def levels(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Of each feature at most `bins` values, in order: all that occur, or else quantiles in the middle of `bins` equal shares."""
    columns = [F.col(f).cast("double") for f in features]
    about = rows.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    probs = [(k + 0.5) / bins for k in range(bins)]
    # sets of few values only; their size is known from the count above
    found = rows.agg(*[F.collect_set(c) if n <= 2 * bins else F.percentile_approx(c, probs, 10_000) for c, n in zip(columns, about)]).first()
    out = []
    for c in found:
        distinct = sorted(set(c or ()))
        out.append(distinct if len(distinct) <= bins else [distinct[int(len(distinct) * p)] for p in probs])
    return out


def cells(rows: DataFrame, features: Sequence[str], label: str, settings: TreeSettings, groups: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows of equal bins and `groups` as one cell, for trees under squared loss: (table with `_x`, `label` and weight `_w`, its bins).

    Each value goes to the nearest level of its feature, so the thresholds of a tree, half way between levels, part raw values
    alike. A cell is two rows, one deviation to either side of its mean label (or one row without deviation): they have the number,
    mean and squares of its rows, hence the same gains, leaves and errors. There are as many cells as bins that occur together,
    however many rows. The number of bins returned makes the learner look at all cells for its thresholds.
    """
    known = levels(rows.where("is_train"), features, settings.bins)
    y = F.col(label).cast("double")
    y = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("a row has no target"))).otherwise(y)
    cut = [(f"_b{i}", f, [-math.inf, *(math.nextafter((a + b) / 2, math.inf) for a, b in zip(v, v[1:])), math.inf])
           for i, (f, v) in enumerate(zip(features, known)) if len(v) > 1]
    taken = rows.select(*groups, y.alias("_label"), *[F.col(f).cast("double").alias(f) for _, f, _ in cut])
    if cut:
        codes, names, splits = zip(*cut)
        taken = Bucketizer(inputCols=list(names), outputCols=list(codes), splitsArray=[list(x) for x in splits]).transform(taken)
    keys = [c for c, _, _ in cut]
    summed = taken.groupBy(*groups, *keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_label").alias("_mean"), F.stddev_pop("_label").alias("_dev"))
    both = F.array(*[F.struct((F.col("_mean") + d * F.col("_dev")).alias("y"), (F.col("_n") / 2).alias("w")) for d in (-1, 1)])
    one = F.array(F.struct(F.col("_mean").alias("y"), F.col("_n").cast("double").alias("w")))

    def level(i: int, v: list[float]) -> Column:
        at = F.element_at(F.array(*[F.lit(x) for x in v]), F.col(f"_b{i}").cast("int") + 1) if len(v) > 1 else F.lit(v[0] if v else 0.0)
        return at.alias(f"_f{i}")
    each = summed.withColumn("_e", F.explode(F.when(F.col("_dev") > 0, both).otherwise(one))).select(
        *groups, F.col("_e.y").alias(label), F.col("_e.w").alias("_w"), *[level(i, v) for i, v in enumerate(known)])
    out = spread(VectorAssembler(inputCols=[f"_f{i}" for i in range(len(known))], outputCol="_x").transform(each), settings.partitions)
    return out, max(settings.bins, math.isqrt(out.count()) + 1)


def signed(rows: DataFrame, features: Sequence[str], label: str, settings: TreeSettings, stop: bool, tolerance: float, learner: GBTRegressor) -> GBTRegressionModel:
    """What `learner` fits under absolute loss, from blocks of cells (`boosting.binned`) instead of passes over all rows.

    The rows of a cell have one prediction, so a tree takes from them the number above and below; only that is counted row by row,
    once a round. Thresholds lie between the levels, as in `cells`.
    """
    edges = [np.array([(a + b) / 2 for a, b in zip(v, v[1:])]) for v in levels(rows.where("is_train"), features, settings.bins)]
    val = F.col("is_val") if stop else F.lit(False)
    role = F.when(val, boosting.VALIDATE).when(~val if stop else F.col("is_train"), boosting.TRAIN).cast("tinyint")
    table = rows.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], F.col(label).alias("y"), role.alias("r0")).where("r0 is not null")
    blocks = boosting.binned(table, len(features), 1, edges, settings.partitions)
    grown = boosting.LevelFit(blocks, edges, settings.rounds, settings.depth, settings.step).run(tolerance if stop else None)
    return spark_model(rows.sparkSession, learner, grown, edges, settings.step)


def spark_model(spark: SparkSession, learner: GBTRegressor, grown: Sequence[boosting.Grown], edges: Sequence[np.ndarray], step: float) -> GBTRegressionModel:
    """The trees as a model of Spark ML, with the parameters of `learner`; the first tree counts once, the others `step` times."""
    jvm, new = spark._jvm.org.apache.spark, spark.sparkContext._gateway.new_array
    trees = new(jvm.ml.regression.DecisionTreeRegressionModel, len(grown))
    weights = new(spark._jvm.double, len(grown))
    for t, g in enumerate(grown):
        nodes = {}
        for i in reversed(range(len(g.stats))):
            n, total, squares = g.stats[i].tolist()
            stats = jvm.mllib.tree.impurity.VarianceCalculator(jvm.mllib.linalg.Vectors.parse(f"[{n!r},{total!r},{squares!r}]").toArray(), int(n))
            if g.tree.feature[i] < 0:
                nodes[i] = jvm.ml.tree.LeafNode(stats.predict(), stats.calculate(), stats)
            else:
                f = int(g.tree.feature[i])
                split = jvm.ml.tree.ContinuousSplit(f, float(edges[f][g.tree.cut[i]]))
                children = nodes.pop(int(g.tree.left[i])), nodes.pop(int(g.tree.right[i]))
                nodes[i] = jvm.ml.tree.InternalNode(stats.predict(), stats.calculate(), float(g.gain[i]), *children, split, stats)
        trees[t] = jvm.ml.regression.DecisionTreeRegressionModel(f"{learner.uid}_{t}", nodes[0], len(edges))
        weights[t] = step if t else 1.0
    model = learner._create_model(jvm.ml.regression.GBTRegressionModel(learner.uid, trees, weights, len(edges)))
    return learner._copyValues(model)


def boosted_residual(df: DataFrame, features: Sequence[str], loss: str = "squared", target: str = "target_bias",
                     settings: TreeSettings = TreeSettings(), early_stop_tol: float | None = 1e-6):
    """Boosted trees on the residual (`absolute` or `squared` loss), stopped early on the validation rows.

    A round counts as no gain only if the validation error falls by less than a share `early_stop_tol`; a step of a few
    percent gains little per round, so the tolerance is near zero. Without subsampling neither loss passes over all rows again and
    again: under squared loss the learner takes `cells`, whose number does not grow with the rows, and under absolute loss the same
    trees come from blocks of cells (`signed`).
    """
    rows = assembled(df.withColumn("_y", F.col(target).cast("double")), features, settings)
    stop = {} if early_stop_tol is None else {"validationIndicatorCol": "is_val", "validationTol": early_stop_tol}
    learned, bins, weight = rows if stop else rows.where("is_train"), settings.bins, {}
    if loss == "squared" and settings.subsample == 1.0:
        learned, bins = cells(learned, features, "_y", settings, ["is_train", "is_val"])
        weight = {"weightCol": "_w"}
    elif loss == "absolute" and settings.subsample == 1.0 and settings.bins <= 256:
        learned = None
    learner = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="predicted_bias", lossType=loss,
                           maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.step,
                           maxBins=bins, seed=settings.seed, subsamplingRate=settings.subsample,
                           checkpointInterval=10, **stop, **weight)
    fitted = learner.fit(learned) if learned is not None else signed(rows, features, "_y", settings, bool(stop), early_stop_tol, learner)
    return fitted, fitted.transform(rows.where("is_val")).drop("_x", "_y")


def leafwise_residual(df: DataFrame, features: Sequence[str], loss: str = "absolute", target: str = "target_bias",
                      settings: boosting.BoostSettings = boosting.BoostSettings()):
    """Boosted trees of 31 leaves on the residual, stopped after five rounds without a gain on the validation rows and cut
    back to the best round."""
    models = boosting.fit(df, features, [boosting.Objective(loss)], target, settings)
    return models[0], boosting.predictions(df.where("is_val"), models, features, ["predicted_bias"])


def quantile_boosting(df: DataFrame, features: Sequence[str], target: str = "target_bias", quantiles: Sequence[float] = tuple(K.QUANTILES),
                      settings: boosting.BoostSettings = boosting.BoostSettings(rounds=80, step=0.08, patience=None)):
    """Conditional residual quantiles, a booster with pinball loss for each; all of them share the passes over the rows.

    The quantiles of a row are sorted, so they never cross. `predicted_bias` is the median.
    """
    tags = [f"q{round(q * 100)}" for q in quantiles]
    models = boosting.fit(df, features, [boosting.Objective("quantile", q) for q in quantiles], target, settings)
    scored = boosting.predictions(df.where("is_val"), models, features, tags)
    ordered = scored.select(*df.columns, *sorted_quantiles(tags))
    median = tags[list(quantiles).index(0.5)] if 0.5 in quantiles else tags[0]
    return tuple(models), ordered.withColumn("predicted_bias", F.col(median))


def hurdle(df: DataFrame, features: Sequence[str], threshold: float = 0.1, observed: str = "observed_rain",
           raw: str = "nwp_rain_raw", settings: TreeSettings = TreeSettings(rounds=80)):
    """P(wet) times the amount expected when wet, minus the raw forecast.

    The amount model learns from wet rows only, or from all rows when fewer than two are wet (two counts decide). A training
    set with a single class has a constant probability. Without subsampling both models learn from `cells`: of each class by
    itself, as all rows of a cell and class have one gradient.
    """
    rows = assembled(df.withColumns({"_wet": wet(observed, threshold).cast("double"),
                                     "_amount": F.col(observed).cast("double")}), features, settings)
    train, val = rows.where("is_train"), rows.where("is_val")
    seen = train.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("_wet") == 1.0).alias("wet")).first()
    shared = dict(featuresCol="_x", maxIter=settings.rounds, maxDepth=settings.depth, maxBins=settings.bins,
                  seed=settings.seed, subsamplingRate=settings.subsample, checkpointInterval=10)
    if settings.subsample == 1.0:
        train, bins = cells(train, features, "_amount", settings, ["is_train", "_wet"])
        shared |= {"maxBins": bins, "weightCol": "_w"}
    amounts = train.where("_wet = 1.0") if seen["wet"] >= 2 else train
    amount = GBTRegressor(labelCol="_amount", predictionCol="_amount_hat", stepSize=settings.step, **shared).fit(amounts)
    scored = amount.transform(val)
    if 0 < seen["wet"] < seen["all"]:
        occurrence = GBTClassifier(labelCol="_wet", predictionCol="_class", stepSize=0.08, **shared).fit(train)
        scored = occurrence.transform(scored).withColumn("_p", vector_to_array("probability").getItem(1))
    else:
        occurrence = None
        scored = scored.withColumn("_p", F.lit(1.0 if seen["wet"] else 0.0))
    expected = F.col("_p") * F.greatest(F.lit(float(threshold)), F.col("_amount_hat"))
    out = scored.withColumn("predicted_bias", expected - F.coalesce(F.col(raw).cast("double"), F.lit(0.0)))
    return (occurrence, amount), out.drop("_x", "_wet", "_amount", "_amount_hat", "probability", "rawPrediction", "_class", "_p")


def quantile_forest(df: DataFrame, features: Sequence[str], target: str = "target_bias",
                    quantiles: Sequence[float] = tuple(K.QUANTILES), trees: int = 20, depth: int = 5,
                    settings: TreeSettings = TreeSettings(), accuracy: int = 10_000):
    """Conditional residual quantiles from a forest: the residual quantiles of the leaf a row falls in, averaged over trees.

    A different method from quantile boosting, for which Spark ML has no loss. Leaf quantiles come from mergeable sketches
    (`accuracy` bounds the rank error), so no leaf is held in one task. The leaf table has at most trees * 2^depth rows and
    is looked up as one array, so scoring is a projection.
    """
    rows = assembled(df.withColumn("_y", F.col(target).cast("double")), features, settings)
    forest = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_mean", leafCol="_leaf", numTrees=trees,
                                   maxDepth=depth, maxBins=settings.bins, seed=settings.seed).fit(rows.where("is_train"))
    tags = [f"q{round(q * 100)}" for q in quantiles]
    placed = forest.transform(rows).withColumn("_leaves", vector_to_array("_leaf"))
    leaves = (placed.where("is_train").select("_y", F.posexplode("_leaves").alias("_tree", "_node"))
              .groupBy("_tree", "_node").agg(F.percentile_approx("_y", list(quantiles), accuracy).alias("_q")))
    width = 2 ** (depth + 1)
    key = (F.col("_tree") * width + F.col("_node")).cast("int")
    by_key = F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col("_q").alias("v"))))
    # an array indexed by tree and leaf: constant-time lookups while scoring
    table = leaves.agg(by_key.alias("m")).select(F.transform(
        F.sequence(F.lit(0), F.lit(trees * width - 1)), lambda i: F.try_element_at("m", i)).alias("a")).select("a").scalar()
    per_tree = F.transform("_leaves", lambda node, tree: F.get(F.col("_table"), (tree * width + node).cast("int")))

    def averaged(i: int):
        known = F.filter(F.transform("_found", lambda q: F.get(q, F.lit(i))), lambda v: v.isNotNull())
        return F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)

    scored = (placed.where("is_val").withColumn("_table", table).withColumn("_found", per_tree)
              .select(*df.columns, *[averaged(i).alias(t) for i, t in enumerate(tags)]))
    ordered = scored.select(*df.columns, *sorted_quantiles(tags))
    median = tags[list(quantiles).index(0.5)] if 0.5 in quantiles else tags[0]
    return forest, ordered.withColumn("predicted_bias", F.col(median))


def place(folder: str, weather_model: str, model: str, ablation: str) -> str:
    """Folder of one fitted model."""
    return f"{folder}/weather_model={weather_model}/model={model}/ablation={ablation}"


def save(fitted, folder: str) -> None:
    """Write a fitted model, or the stages of one, replacing what was there."""
    stages = fitted if isinstance(fitted, tuple) else (fitted,)
    for i, stage in enumerate(stages):
        if isinstance(stage, boosting.Booster):
            stage.save(SparkSession.active(), f"{folder}/{i}-Booster")
        elif stage is not None:
            stage.write().overwrite().save(f"{folder}/{i}-{type(stage).__name__}")


def load(spark: SparkSession, folder: str) -> tuple:
    """The stages of a saved model, in order."""
    kinds = {k.__name__: k for k in (GBTRegressionModel, GBTClassificationModel, RandomForestRegressionModel)}
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    return tuple(boosting.Booster.load(spark, f"{folder}/{n}") if n.endswith("-Booster") else kinds[n.split("-", 1)[1]].load(f"{folder}/{n}")
                 for n in names)
