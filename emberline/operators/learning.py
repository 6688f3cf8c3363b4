"""Model fitting, scoring and uncertainty with Spark ML.

Estimators are Spark ML's distributed ones: trees train with per-partition
histogram aggregation, k-means with per-partition centre sums. Forests are grown
by :mod:`.forest` into Spark ML's models.
Per-tree uncertainty (M16/M17) reads the values of a fitted forest's trees in one
pass over their flat arrays and reduces them with array expressions, so no
row ever leaves the executors.
"""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .boosting import AgainstRestBoosting
from .evaluation import passport_values, with_class_weights
from .features import class_to_rank, fill_values, rank_to_class
from .forest import ForestClassifier, ForestRegressor, as_flat
from .prefix import prefix_sums
from .resources import materialise
from .splits import hash_uniform

FEATURES_COL = "features"


def assemble(df: DataFrame, features: list[str], out: str = FEATURES_COL) -> DataFrame:
    """Numeric feature columns -> one vector column (nulls must be filled before)."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def with_label(df: DataFrame, rank_col: str = "rank_tz", label: str = "label") -> DataFrame:
    """Class index 0..5 for Spark ML (class id - 1) from a rank column; unlabelled rows dropped."""
    return df.withColumn(label, (rank_to_class(rank_col) - 1).cast("double")).where(F.col(label).isNotNull())


def classifier(kind: str, params: dict | None = None, weight_col: str | None = "weight", seed: int = 42):
    p = dict(params or {})
    if kind == "decision_tree":
        est = DecisionTreeClassifier(maxDepth=p.get("max_depth", 10), minInstancesPerNode=p.get("min_samples_leaf", 10),
                                     impurity=p.get("criterion", "gini"), seed=seed)
    elif kind == "random_forest":
        est = ForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 15),
                               minInstancesPerNode=p.get("min_samples_leaf", 5), impurity=p.get("criterion", "gini"),
                               subsamplingRate=p.get("subsample", 1.0), bootstrap=p.get("bootstrap", True),
                               featureSubsetStrategy=p.get("max_features", "sqrt"), seed=seed)
    elif kind == "gradient_boosting":
        # Spark's boosting is binary: each class against the others gives the multi-class twin
        depth = p.get("max_depth", 8)
        return AgainstRestBoosting(weightCol=weight_col or "", maxIter=p.get("max_iter", 300), maxDepth=depth, maxLeaves=2 ** depth, minInstancesPerNode=1,
                                   stepSize=p.get("learning_rate", 0.1), maxBins=32)
    elif kind == "logistic":
        est = LogisticRegression(family="multinomial", maxIter=p.get("max_iter", 1000), regParam=p.get("C_inv", 0.0))
    else:
        raise ValueError(kind)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def fit(train: DataFrame, features: list[str], kind: str = "random_forest", params: dict | None = None,
        balanced: bool = True, standardize: bool = False, seed: int = 42) -> PipelineModel:
    """Assemble (+ optional z-score) + estimator as one Pipeline."""
    df = with_class_weights(train, "label") if balanced else train
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features" if standardize else FEATURES_COL,
                              handleInvalid="keep")]
    if standardize:
        stages.append(StandardScaler(inputCol="raw_features", outputCol=FEATURES_COL, withMean=True, withStd=True))
    stages.append(classifier(kind, params, "weight" if balanced else None, seed))
    return Pipeline(stages=stages).fit(spread(df))


def spread(train: DataFrame) -> DataFrame:
    """Training rows on all cores: a small written table is one file, and so one task in every pass of a fit."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(cores) if len(train.inputFiles()) < cores else train


@dataclass(frozen=True)
class Fitted:
    """A model with what its features are filled with; both learned from the training rows alone."""
    model: PipelineModel
    features: tuple[str, ...]
    fills: dict[str, float]

    def filled(self, df: DataFrame) -> DataFrame:
        return apply_fills(df, self.fills)

    def predict(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return predict(self.model, self.filled(df), keys)

    def probabilities(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, probability) of rows that need no label."""
        return self.predict(df.withColumn("label", F.lit(0.0)), keys).select(*keys, "probability")


def apply_fills(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.when(F.abs(F.col(c).cast("double")) != float("inf"), F.col(c).cast("double")), F.lit(v)) for c, v in fills.items()})


def median_fills(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians of the training rows; 0 for a column without values."""
    return {c: 0.0 if v is None else float(v) for c, v in fill_values(train, list(features), "median").items()}


def fit_filled(train: DataFrame, features: list[str], kind: str = "random_forest", params: dict | None = None,
               balanced: bool = True, standardize: bool = False, seed: int = 42) -> Fitted:
    """Medians and model of the training rows."""
    fills = median_fills(train, features)
    return Fitted(fit(apply_fills(train, fills), list(features), kind, params, balanced, standardize, seed), tuple(features), fills)


def predict(model: PipelineModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, yhat, probability array) in class ids 1..6 — the shape evaluation expects.

    A one-against-rest model gives a margin per class; its logistic values are brought to a sum of 1.
    """
    out = model.transform(df)
    if "probability" in out.columns:
        prob = _pad6(vector_to_array("probability"))
    else:
        raw = F.transform(_pad6(vector_to_array("rawPrediction"), float("-inf")), lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
        prob = scaled(raw)
    return out.select(*keys, (F.col("label") + 1).cast("int").alias("y"), (F.col("prediction") + 1).cast("int").alias("yhat"), prob.alias("probability"))


def scaled(values: Column) -> Column:
    """Class values over their sum; equal shares if all are 0."""
    # Bound as lambda variables: an expression used inside a lambda is evaluated anew for each element.
    both = F.transform(F.array(values), lambda v: F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("t")))
    shares = F.transform(both, lambda b: F.transform(b["v"], lambda x: F.when(b["t"] > 0, x / b["t"]).otherwise(1.0 / 6)))
    return F.element_at(shares, 1)


def _pad6(arr, missing: float = 0.0):
    """Arrays as 6 entries (classes unseen in training get ``missing``)."""
    return F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: F.coalesce(F.try_element_at(arr, j), F.lit(missing)))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, MSE, RMSE, R² in one aggregate."""
    e = F.col(prediction) - F.col(label)
    mean_y = F.avg(label)
    agg = pred.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), mean_y.alias("_my"),
                   F.count(F.lit(1)).alias("n"), F.var_pop(label).alias("_vy"))
    return agg.select("mae", "mse", F.sqrt("mse").alias("rmse"),
                      F.when(F.col("_vy") > 0, 1 - F.col("mse") / F.col("_vy")).alias("r2"), "n")


def fit_regressor(train: DataFrame, features: list[str], target: str, kind: str = "random_forest",
                  params: dict | None = None, seed: int = 42) -> PipelineModel:
    p = dict(params or {})
    if kind == "random_forest":
        est = ForestRegressor(labelCol=target, numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 15),
                              minInstancesPerNode=p.get("min_samples_leaf", 5), seed=seed)
    else:
        est = DecisionTreeRegressor(labelCol=target, maxDepth=p.get("max_depth", 10),
                                    minInstancesPerNode=p.get("min_samples_leaf", 10), seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol=FEATURES_COL, handleInvalid="keep"),
                            est]).fit(spread(train))


def fold_column(df: DataFrame, key: str, folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Deterministic group fold id from a hash of the key (all rows of a key share a fold)."""
    return df.withColumn(name, F.floor(hash_uniform(F.coalesce(F.col(key).cast("string"), F.lit("__missing__")), seed)
                                       * folds).cast("int"))


METRICS = ("accuracy", "f1_macro", "f1_weighted", "precision", "recall", "ordinal_mae")


def _metrics(pred: DataFrame) -> dict[str, float]:
    return passport_values(pred)


def fold_metrics(df: DataFrame, fit_one, folds: int, key: str = "event_id", seed: int = 42, fold: str | None = None) -> list[dict[str, float]]:
    """Metrics of each fold, group folds of ``key`` or those of column ``fold``; ``fit_one(train)`` gives a function from rows to predictions.

    Rows are written once and the folds fitted side by side. Folds without rows are left out.
    """
    name = fold or "fold"
    data = written(df if fold else fold_column(df, key, folds, seed), "folds")

    def one(k: int) -> dict[str, float] | None:
        train, test = data.where(F.col(name) != k), data.where(F.col(name) == k)
        return passport_values(fit_one(train)(test)) if test.limit(1).count() and train.limit(1).count() else None

    with ThreadPoolExecutor(folds) as pool:
        return [m for m in pool.map(one, range(folds)) if m]


def stratified_folds(df: DataFrame, label: str, order: list[str], folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds that each hold a ``folds``-th of every class: rows of a class take turns in the order of a seeded hash of ``order``."""
    placed = df.withColumn("u_", hash_uniform(F.concat_ws("|", *[F.col(c).cast("string") for c in order]), seed))
    return prefix_sums(placed, [label], ["u_", *order], None, "at_").withColumn(name, (F.col("at_") % folds).cast("int")).drop("u_", "at_")


def cross_validate(df: DataFrame, features: list[str], kind: str = "random_forest", params: dict | None = None,
                   folds: int = 5, key: str = "event_id", seed: int = 42, standardize: bool = False, fold: str | None = None) -> DataFrame:
    """Mean and std over folds of accuracy / F1 macro / F1 weighted; fills and model are refitted in each fold."""
    def one(train: DataFrame):
        fitted = fit_filled(train, features, kind, params, standardize=standardize, seed=seed)
        return lambda test: fitted.predict(test, [])

    rows = [(i, m.get("accuracy"), m.get("f1_macro"), m.get("f1_weighted")) for i, m in enumerate(fold_metrics(df, one, folds, key, seed, fold))]
    per = df.sparkSession.createDataFrame(rows, "fold int, accuracy double, f1_macro double, f1_weighted double")
    return per.agg(*[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("accuracy", "f1_macro", "f1_weighted")],
                   *[F.round(F.stddev_pop(c), 6).alias(f"{c}_std") for c in ("accuracy", "f1_macro", "f1_weighted")],
                   F.count(F.lit(1)).alias("folds"))


def cross_validate_regression(df: DataFrame, features: list[str], target: str, params: dict | None = None, folds: int = 5,
                              key: str = "event_id", seed: int = 42, kind: str = "random_forest", fold: str | None = None) -> DataFrame:
    """M10 for a regressor: mean of MAE, RMSE and R2 over folds, fitted side by side."""
    data = written(df if fold else fold_column(df, key, folds, seed), "folds")
    name = fold or "fold"

    def one(k: int) -> DataFrame:
        train, test = data.where(F.col(name) != k), data.where(F.col(name) == k)
        fills = median_fills(train, features)
        m = fit_regressor(apply_fills(train, fills), features, target, kind, params, seed)
        return regression_metrics(m.transform(apply_fills(test, fills)), target, "prediction")

    with ThreadPoolExecutor(folds) as pool:
        out = reduce(DataFrame.unionByName, pool.map(one, range(folds)))
    return out.agg(*[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("mae", "rmse", "r2")], F.count(F.lit(1)).alias("folds"))


@dataclass(frozen=True)
class Calibrated:
    """M8: a fitted model and, per class, what turns its probability into a calibrated one."""
    base: Fitted
    method: str
    curves: dict[int, object]

    def predict(self, df: DataFrame, keys: list[str]) -> DataFrame:
        rows = self.base.predict(df, [*keys])
        for c, curve in self.curves.items():
            p = F.element_at("probability", c)
            if self.method == "sigmoid":
                a, b = curve
                rows = rows.withColumn(f"cal_{c}", 1.0 / (1.0 + F.exp(-(F.lit(a) * p + F.lit(b)))))
            else:
                rows = curve.transform(rows.withColumn(f"raw_{c}", p))
        values = F.array(*[F.col(f"cal_{c}") if c in self.curves else F.lit(0.0) for c in range(1, 7)])
        rows = rows.select(*keys, "y", scaled(values).alias("probability"))
        best = F.array_max(F.zip_with("probability", F.sequence(F.lit(1), F.lit(6)), lambda x, j: F.struct(x.alias("p"), (-j).alias("nj"))))
        return rows.select(*keys, "y", (-best["nj"]).cast("int").alias("yhat"), "probability")


def out_of_fold(train: DataFrame, features: list[str], kind: str, params: dict | None = None, folds: int = 3, key: str = "event_id", seed: int = 42) -> DataFrame:
    """(y, yhat, probability) of every training row by a model of the other group folds, written once."""
    data, parts = written(fold_column(train, key, folds, seed), "folds"), None
    for k in range(folds):
        one = fit_filled(data.where(F.col("fold") != k), features, kind, params, seed=seed).predict(data.where(F.col("fold") == k), [])
        parts = one if parts is None else parts.unionByName(one)
    return written(parts, "scores")


def calibrate(train: DataFrame, features: list[str], kind: str, params: dict | None = None, method: str = "sigmoid", folds: int = 3,
              key: str = "event_id", seed: int = 42, scores: DataFrame | None = None, base: Fitted | None = None) -> Calibrated:
    """Out-of-fold probabilities of ``folds`` group folds fit a logistic or isotonic curve for each class; the model is refitted on all rows.

    Neither depends on the method: ``scores`` (:func:`out_of_fold`) and ``base`` of the same rows and parameters are taken if given.
    """
    from pyspark.ml.regression import IsotonicRegression

    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration {method}")
    scores = out_of_fold(train, features, kind, params, folds, key, seed) if scores is None else scores
    curves: dict[int, object] = {}
    for (c,) in sorted(scores.select("y").distinct().collect()):
        rows = scores.select(F.element_at("probability", F.lit(c)).alias(f"raw_{c}"), (F.col("y") == c).cast("double").alias("label"))
        if method == "sigmoid":
            m = LogisticRegression(featuresCol="f", maxIter=100).fit(VectorAssembler(inputCols=[f"raw_{c}"], outputCol="f").transform(rows))
            curves[c] = (float(m.coefficients[0]), float(m.intercept))
        else:
            curves[c] = IsotonicRegression(featuresCol=f"raw_{c}", predictionCol=f"cal_{c}").fit(rows)
    return Calibrated(fit_filled(train, features, kind, params, seed=seed) if base is None else base, method, curves)


def impurity_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """M14 (impurity part): the fitted model's feature importances as a table."""
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.getActiveSession().createDataFrame(
        [(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], repeats: int = 3, seed: int = 42) -> DataFrame:
    """M14 (permutation part): drop in accuracy when one feature's values are shuffled.

    Rows are numbered once in the order of a seeded hash, by prefix sums rather than
    one window; a permutation gives row i the value of row i + shift of that order,
    with a shift drawn for each feature and repeat, so all rows take part at any size.
    """
    import random

    rng, base_acc = random.Random(seed), _accuracy(model, df)
    keyed = written(df.withColumn("rid_", F.monotonically_increasing_id()), "rows")
    placed = written(prefix_sums(keyed.withColumn("u_", hash_uniform(F.col("rid_"), seed)), [], ["u_", "rid_"], None, "at_"), "placed")
    n, out = placed.count(), []
    for f in features:
        drops = []
        for _ in range(repeats):
            shift = rng.randrange(1, n) if n > 1 else 0
            values = placed.select(((F.col("at_") + F.lit(shift)) % F.lit(n)).alias("to_"), F.col(f).alias("v_"))
            shuffled = placed.join(values, F.col("at_") == F.col("to_")).withColumn(f, F.col("v_"))
            drops.append(base_acc - _accuracy(model, shuffled))
        mean = sum(drops) / len(drops)
        out.append((f, float(mean), float(math.sqrt(sum((d - mean) ** 2 for d in drops) / len(drops)))))
    return df.sparkSession.createDataFrame(out, "feature string, importance_mean double, importance_std double")


def _accuracy(model: PipelineModel, df: DataFrame) -> float:
    p = model.transform(df)
    return p.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def tree_probabilities(model: PipelineModel, df: DataFrame, keys: list[str], n_trees: int | None = None, seed: int = 42) -> DataFrame:
    """Per-tree class-probability arrays (``tree_probs``: array<array<double>>) of all trees, or of ``n_trees`` drawn ones where a query names their number."""
    import random
    forest = as_flat(model.stages[-1])
    trees = list(range(forest.getNumTrees))
    if n_trees is not None and len(trees) > n_trees:
        rng = random.Random(seed)
        trees = sorted(rng.sample(range(len(trees)), n_trees))
    assembled = model.stages[0].transform(df) if len(model.stages) > 1 else df
    classes = forest.numClasses
    rows = materialise(assembled.select(*keys, "label", forest.tree_values(trees).alias("values_")), ["values_"])
    each = F.transform(F.sequence(F.lit(0), F.lit(len(trees) - 1)), lambda i: _pad6(F.slice("values_", i * classes + 1, classes)))
    return rows.select(*keys, "label", each.alias("tree_probs"))


def ensemble_uncertainty(model: PipelineModel, df: DataFrame, keys: list[str], n_trees: int | None = None, seed: int = 42) -> DataFrame:
    """mean/std/p05/p95 of per-class probabilities across all trees (or ``n_trees`` drawn ones); maxima over classes (like the source).

    Also emits the entropy of the mean distribution (the source reads an entropy
    it never computes).
    """
    return reduce_tree_probabilities(tree_probabilities(model, df, keys, n_trees, seed), keys)


def reduce_tree_probabilities(tp: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, std, 5 % and 95 % quantile over trees of each class's probability in ``tree_probs``, then maxima over classes.

    Values by class, means and sorted values are columns of their own, evaluated once a row.
    """
    cls = F.sequence(F.lit(1), F.lit(6))

    def mean(xs):
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.size(xs)

    def std(xs, m):
        return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(xs))

    def pct(s, q):
        h = (F.size(s) - 1) * q
        lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
        a, b = F.element_at(s, lo + 1), F.element_at(s, hi + 1)
        return a + (b - a) * (h - lo)

    probs = materialise(tp.select(*keys, "tree_probs"), ["tree_probs"])
    by_class = F.transform(cls, lambda j: F.transform("tree_probs", lambda a: F.element_at(a, j)))
    values = materialise(probs.select(*keys, F.size("tree_probs").alias("n_trees"), by_class.alias("values_")), ["n_trees", "values_"])
    values = materialise(values.select("*", F.transform("values_", mean).alias("mean_probs"), F.transform("values_", lambda xs: F.array_sort(xs)).alias("sorted_")),
                         ["mean_probs", "sorted_"])
    stats = values.select(*keys, "mean_probs", F.zip_with("values_", "mean_probs", std).alias("std_probs"),
                          F.transform("sorted_", lambda s: pct(s, 0.05)).alias("p05"), F.transform("sorted_", lambda s: pct(s, 0.95)).alias("p95"), "n_trees")
    best = F.array_max(F.zip_with("mean_probs", F.sequence(F.lit(1), F.lit(6)),
                                  lambda p, j: F.struct(p.alias("p"), (-j).alias("nj"))))
    entropy = -F.aggregate("mean_probs", F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return stats.select(*keys, (-best["nj"]).alias("predicted_class"), class_to_rank(-best["nj"]).alias("predicted_rank"),
                        F.array_max("mean_probs").alias("mean_prob_class"), F.array_max("std_probs").alias("std_prob_class"),
                        F.array_max("p05").alias("ci_lower_prob"), F.array_max("p95").alias("ci_upper_prob"),
                        entropy.alias("entropy"), "n_trees")


def resource_quantiles(model: PipelineModel, df: DataFrame, keys: list[str], qs=(0.2, 0.5, 0.8)) -> DataFrame:
    """Per-row quantiles, min, max, std of the per-tree predictions of a forest regressor."""
    rows = model.stages[0].transform(df).select(*keys, as_flat(model.stages[-1]).tree_values().alias("tree_values"))
    return reduce_tree_values(rows, keys, qs)


def reduce_tree_values(rows: DataFrame, keys: list[str], qs=(0.2, 0.5, 0.8)) -> DataFrame:
    """Quantiles, minimum, maximum and population std of the numbers in ``tree_values``."""
    base = materialise(rows.select(*keys, F.array_sort("tree_values").alias("_v")), ["_v"])
    n = F.size("_v")
    base = materialise(base.select("*", (F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / n).alias("_mean")), ["_mean"])

    def q(p):
        h = (n - 1) * p
        lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
        a, b = F.element_at("_v", lo + 1), F.element_at("_v", hi + 1)
        return a + (b - a) * (h - lo)
    mean = F.col("_mean")
    return base.select(*keys, *[q(p).alias(f"p{int(p * 100)}") for p in qs], F.element_at("_v", 1).alias("min"),
                       F.element_at("_v", -1).alias("max"),
                       F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n).alias("std"))


def standardize(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """(x - mean) / population std per column (one aggregate for all moments)."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return df.select(*keep, *[((F.col(c) - F.lit(st[f"m_{c}"])) /
                               F.lit(st[f"s_{c}"] if st[f"s_{c}"] else 1.0)).alias(c) for c in features])


def segment(df: DataFrame, features: list[str], k: int = 4, seed: int = 42, algorithm: str = "kmeans",
            keep: list[str] = (), restarts: int = 1) -> tuple[DataFrame, dict]:
    """K-means (or bisecting k-means in place of agglomerative) on filled features; the best of ``restarts`` seeds."""
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    data = written(filled, "segments")
    model = segment_model(assemble(data, features), k, seed, algorithm, restarts)
    out = model.transform(assemble(data, features)).withColumnRenamed("prediction", "cluster")
    info = {"k": k, "inertia": float(model.summary.trainingCost), "centres": [c.tolist() for c in model.clusterCenters()]}
    return out.drop(FEATURES_COL), info


def segment_model(vectors: DataFrame, k: int, seed: int = 42, algorithm: str = "kmeans", restarts: int = 1):
    """The fitted model of least cost over ``restarts`` seeds."""
    best = None
    for r in range(restarts):
        est = KMeans(k=k, seed=seed + r, maxIter=50) if algorithm == "kmeans" else BisectingKMeans(k=k, seed=seed + r)
        model = est.fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def clustering_grid(df: DataFrame, groups: dict[str, list[str]], rank: str, ks: list[int], key: str = "key", algorithms: tuple[str, ...] = ("kmeans", "ward"),
                    time_flag: str | None = "flag_time_invalid", restarts: int = 20, seed: int = 42) -> DataFrame:
    """Every feature group x {dropna, impute} x algorithm x k, one row per run with validity, silhouettes and alignment.

    Runs of fewer than max(2k, 10) rows are skipped, as are rows without ``rank``, and rows with
    invalid times for groups of time features. The standardised rows of all groups lie in
    one written table (shorter vectors are padded with zeros, which no distance sees), so that
    each step of all runs is one pass and the labels of all runs are evaluated together.
    """
    from . import segmentation as SG
    from .evaluation import cluster_validity, rank_alignment

    spark, width = df.sparkSession, max(len(f) for f in groups.values())
    every = list(dict.fromkeys(c for g in groups.values() for c in g))
    doubles = df.select(key, rank, *([time_flag] if time_flag else []), *[F.col(c).cast("double").alias(c) for c in every])
    timely = {name: bool(time_flag) and any(f.endswith("_min") for f in feats) for name, feats in groups.items()}
    rows_of = {False: doubles, True: doubles.where(~F.col(time_flag)) if time_flag else doubles}
    fills = {t: median_fills(rows_of[t], sorted({c for n, g in groups.items() if timely[n] == t for c in g})) for t in set(timely.values())}
    names = [(name, imputation) for name in groups for imputation in ("dropna", "impute")]

    def scaled_set(s: int) -> DataFrame:
        name, imputation = names[s]
        feats, rows = groups[name], rows_of[timely[name]]
        base = rows.dropna(subset=feats) if imputation == "dropna" else apply_fills(rows, {c: fills[timely[name]][c] for c in feats})
        z = standardize(base.where(F.col(rank).isNotNull()), feats, keep=[key, rank])
        x = F.array(*[F.col(c) for c in feats], *[F.lit(0.0)] * (width - len(feats)))
        return z.select(F.lit(s).alias("set_id"), F.col(key).alias("key"), F.col(rank).alias("rank"), x.alias("x"))

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(scaled_set, range(len(names))))
    points = written(spread(written(reduce(DataFrame.unionByName, parts), "scaled")), "points")
    sizes = {r["set_id"]: r["count"] for r in points.groupBy("set_id").count().collect()}
    centres = SG.kmeans_many(points, ks, restarts, seed) if "kmeans" in algorithms else {}
    trees = {}
    if "ward" in algorithms:
        for s, (c, n) in SG.summaries(points, seed=seed).items():
            trees[s] = (c, SG.ward(c, n))
    runs, about, run = {}, [], 0
    for s, (name, imputation) in enumerate(names):
        for a in algorithms:
            for k in ks:
                if sizes.get(s, 0) >= max(2 * k, 10):
                    found = None
                    if a == "kmeans" and (s, k) in centres:
                        found = (centres[s, k][0], np.arange(k))
                    elif a == "ward" and len(trees[s][0]) >= k:
                        found = (trees[s][0], SG.cut(trees[s][1], len(trees[s][0]), k))
                    if found:
                        runs.setdefault(s, []).append((run, *found))
                        about.append((run, name, imputation, a, k))
                run += 1
    labels = written(SG.labelled(points, runs), "labels")
    feats = [f"x{i}" for i in range(width)]
    long = written(labels.select("rank", *[F.element_at("x", i + 1).alias(f) for i, f in enumerate(feats)], F.inline("labels")), "runs")
    by = ["run_id"]
    one = cluster_validity(long, feats, "cluster", by, silhouette=True).join(rank_alignment(long, "cluster", "rank", by), by).join(SG.euclidean_silhouettes(labels), by, "left")
    known = spark.createDataFrame(about, "run_id int, feature_set string, imputation string, algorithm string, asked_k int")
    out = written(one.join(known, by), "grid")
    return out.select("run_id", "feature_set", "imputation", "algorithm", F.col("asked_k").alias("k"), F.col("n").alias("rows_used"),
                      F.col("euclidean_silhouette").alias("silhouette"), F.col("silhouette").alias("squared_silhouette"), "davies_bouldin", "calinski_harabasz",
                      "inertia", "cluster_min", "cluster_max", (F.col("cluster_min") / F.col("n")).alias("cluster_smallest_share"), "spearman", "purity", "nmi")


def pca_2d(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Two principal components of standardised features."""
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    z = assemble(standardize(filled, features, keep), features)
    model = PCA(k=2, inputCol=FEATURES_COL, outputCol="pc").fit(z)
    arr = vector_to_array("pc")
    return model.transform(z).select(*keep, arr[0].alias("pc1"), arr[1].alias("pc2"))


def subset_study(df: DataFrame, pool: list[str], test_flag: str = "is_test", max_size: int = 4, trees: int = 50,
                 seed: int = 42) -> DataFrame:
    """Every 2..max_size subset of ``pool`` -> forest -> test F1 macro, ranked.

    ``df`` is read once per subset, so give it written; the loop is bounded by the pool.
    """
    rows = []
    train, test = df.where(~F.col(test_flag)), df.where(F.col(test_flag))
    for size in range(2, max_size + 1):
        for subset in itertools.combinations(pool, size):
            m = _metrics(fit_filled(train, list(subset), "random_forest", {"n_estimators": trees, "max_depth": 10}, seed=seed).predict(test, []))
            rows.append((",".join(subset), size, m.get("f1_macro"), m.get("accuracy")))
    res = df.sparkSession.createDataFrame(rows, "features string, size int, f1_macro double, accuracy double")
    return res.orderBy(F.desc("f1_macro"), "features")


# ---- neighbour oversampling (M30) ------------------------------------------------

#: Least recall of the neighbour index, and the share of rows (every so many) it is measured on against all rows.
RECALL, QUERY_EVERY = 0.9, 100
#: Least rows of an order that a task looks at together.
STRETCH = 4096


def _is_query(key: Column, every: int) -> Column:
    """Whole numbers divisible by ``every``; other keys by their hash."""
    number = key.try_cast("long")
    return F.coalesce((number % every == 0), (F.xxhash64(key.cast("string")) % every == 0))


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return out


def exact_near(df: DataFrame, key: str, features: list[str], k: int, by: list[str], every: int = QUERY_EVERY) -> DataFrame:
    """(key, place, d): distances of the ``k`` nearest rows, of the rows whose key is divisible by ``every``, against all rows of their group.

    Queries are dealt into blocks and rows into chunks; each pair of them gives its ``k`` best, so the work is rows x queries and nothing larger than
    a block and a chunk is held.
    """
    point = F.array(*[F.col(c).cast("double") for c in features])
    rows = written(df.select(F.col(key).alias("key_"), *by, point.alias("x_")), "points")
    spread_ = F.abs(F.xxhash64("key_"))
    n = max((r["n"] for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()), default=0)
    asked = rows.where(_is_query(F.col("key_"), every)).groupBy(*[F.col(c).alias(f"{c}_r") for c in by], (spread_ % (n // (every * 256) + 1)).alias("b_")) \
        .agg(F.collect_list(F.struct("key_", "x_")).alias("queries"))
    chunks = rows.groupBy(*by, (spread_ % (n // 4096 + 1)).alias("c_")).agg(F.collect_list(F.struct("key_", "x_")).alias("points"))
    pairs = chunks.join(asked, _same(by)).select("queries", "points")

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            for q, p in zip(batch.column(0), batch.column(1), strict=True):
                names, there = q.values.field("key_"), p.values.field("key_").to_pylist()
                x, y = (s.values.field("x_").flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1) for s in (q, p))
                d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
                place = {name: i for i, name in enumerate(there)}
                for i, name in enumerate(names.to_pylist()):
                    if name in place:
                        d[i, place[name]] = np.inf
                best = np.sort(d, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(x)), best.shape[1]))), pa.array(best.ravel())], ["key_", "d"])

    kind = dict(rows.dtypes)["key_"]
    found = pairs.mapInArrow(nearest, f"key_ {kind}, d double").where(F.col("d") < float("inf"))
    place = F.row_number().over(Window.partitionBy("key_").orderBy("d"))
    return found.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("key_", key)


@dataclass(frozen=True)
class NeighbourIndex:
    """Rows in the order of several random projections, each order written once, and how many rows on either side are looked at."""
    key: str
    by: tuple[str, ...]
    orders: tuple[DataFrame, ...]
    width: int
    recall: float

    def near(self, k: int, queries: Column | None = None) -> DataFrame:
        """(key, near, d, place): up to ``k`` nearest rows among the candidates of all rows, or of those for which ``queries`` (of ``key_``) holds.

        An order is cut into stretches; a task holds one with the rows that its ends look at, and gives the ``k`` best of each row alone.
        """
        pairs, by, width = None, list(self.by), self.width
        side = max(STRETCH, 8 * width)
        asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
        for at in self.orders:
            sides = F.explode(F.sequence(F.floor((F.col("at_") - width) / side), F.floor((F.col("at_") + width) / side))).alias("b_")
            kind = dict(at.dtypes)["key_"]
            one = (at.select(*by, "key_", "x_", "at_", asked.alias("asked_"), sides).groupBy(*by, "b_")
                   .applyInArrow(_nearest(k, width, side), f"key_ {kind}, near {kind}, d double"))
            pairs = one if pairs is None else pairs.unionByName(one)
        place = F.row_number().over(Window.partitionBy("key_").orderBy("d", "near"))
        return pairs.distinct().withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("key_", self.key)


def _nearest(k: int, width: int, side: int):
    """Of the rows of a stretch of ``side`` rows, the ``k`` nearest of the ``width`` rows before and after, each key once; a missing distance comes first."""
    steps = np.concatenate([np.arange(-width, 0), np.arange(1, width + 1)])

    def nearest(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.sort_by("at_")
        n, names = rows.num_rows, rows.column("key_").combine_chunks()
        rank = pc.rank(names, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        values = rows.column("x_").combine_chunks().flatten()
        x = values.to_numpy(zero_copy_only=False).reshape(n, -1)
        empty = values.is_null().to_numpy(zero_copy_only=False).reshape(n, -1).any(axis=1)
        own = rows.column("at_").to_numpy() // side == rows.column("b_")[0].as_py()
        here = np.flatnonzero(own & rows.column("asked_").to_numpy(zero_copy_only=False))
        out, block = [], max(1, (1 << 19) // len(steps))
        for q in (here[i:i + block] for i in range(0, len(here), block)):
            c = q[:, None] + steps
            there = (c >= 0) & (c < n)
            c = np.clip(c, 0, n - 1)
            d = np.zeros(c.shape)
            for j in range(x.shape[1]):
                d += (x[q, j][:, None] - x[c, j]) ** 2
            d = np.where(empty[q][:, None] | empty[c], -1.0, np.sqrt(d))
            order = np.lexsort((rank[c], d, ~there), axis=1)
            c, d, there = (np.take_along_axis(v, order, axis=1) for v in (c, d, there))
            again = (rank[c][:, 1:] == rank[c][:, :-1]) & ((d[:, 1:] == d[:, :-1]) | (np.isnan(d[:, 1:]) & np.isnan(d[:, :-1])))
            there[:, 1:] &= ~again
            row, col = np.nonzero(there & (np.cumsum(there, axis=1) <= k))
            out.append((q[row], c[row, col], d[row, col]))
        left, right, d = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"key_": names.take(pa.array(left)), "near": names.take(pa.array(right)), "d": pa.array(d, mask=d < 0)})

    return nearest


def neighbour_index(df: DataFrame, key: str, features: list[str], k: int, by: list[str], projections: int = 6, width: int = 8, recall: float = RECALL,
                    every: int = QUERY_EVERY, seed: int = 42) -> NeighbourIndex:
    """An index whose recall at ``k`` was measured to be ``recall`` or more.

    Recall is the share of the exact ``k`` nearest distances that the index reaches too, of the rows whose key is divisible by ``every``
    (of all rows if none is) against all rows. The looked-at stretch is doubled until it is enough; at the size of the
    largest group the index is exact. Candidates of a row are twice the stretch a projection, whatever the group's size.
    """
    import random

    rng = random.Random(seed)
    point = F.array(*[F.col(c).cast("double") for c in features])
    rows = written(df.select(F.col(key).alias("key_"), *by, point.alias("x_")), "points")
    orders = []
    for _ in range(projections):
        w = [rng.gauss(0, 1) for _ in features]
        line = sum((F.element_at("x_", i + 1) * F.lit(v) for i, v in enumerate(w)), F.lit(0.0))
        orders.append(written(prefix_sums(rows.withColumn("p_", line), by, ["p_", "key_"], None, "at_"), "order"))
    if not rows.where(_is_query(F.col("key_"), every)).limit(1).count():
        every = 1
    want = written(exact_near(df, key, features, k, by, every), "exact")
    total = want.count()
    last = want.groupBy(F.col(key).alias("key_")).agg(F.max("d").alias("limit_"))
    largest = max((r["count"] for r in rows.groupBy(*by).count().collect()), default=0)
    while True:
        index = NeighbourIndex(key, tuple(by), tuple(orders), width, 1.0)
        found = index.near(k, _is_query(F.col("key_"), every)).withColumnRenamed(key, "found_")
        hits = found.join(last, F.col("found_") == F.col("key_")).where(F.col("d") <= F.col("limit_") + 1e-9).count()
        reached = hits / total if total else 1.0
        if reached >= recall or width >= largest:
            return NeighbourIndex(key, tuple(by), tuple(orders), width, reached)
        width *= 2


def near_rows(df: DataFrame, key: str, features: list[str], k: int, by: list[str], projections: int = 6, width: int = 8, recall: float = RECALL,
              seed: int = 42) -> DataFrame:
    """(key, near, d, place): up to ``k`` nearest rows inside the groups ``by``, with exact distances, by an index of measured ``recall``."""
    return neighbour_index(df, key, features, k, by, projections, width, recall, seed=seed).near(k)


def margin_rows(df: DataFrame, key: str, label: str, features: list[str], seed: int = 42) -> DataFrame:
    """(key) of the rows on or inside the margin of a linear machine that tells their class from all others: its support vectors."""
    vectors = written(assemble(df.select(key, label, *[F.col(c).cast("double").alias(c) for c in features]), features), "vectors")
    classes = sorted(r[0] for r in vectors.select(label).distinct().collect())
    if len(classes) < 2:
        return vectors.select(key)

    def one(c) -> DataFrame:
        mine = (F.col(label) == c).cast("double")
        model = LinearSVC(labelCol="mine_", weightCol="share_", regParam=0.01, maxIter=50).fit(
            vectors.withColumn("mine_", mine).join(F.broadcast(_shares(vectors, label, c)), F.col("mine_") == F.col("side_")))
        return model.transform(vectors.where(F.col(label) == c)).where(vector_to_array("rawPrediction")[1] <= 1.0).select(key)

    with ThreadPoolExecutor(len(classes)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, classes))


def _shares(rows: DataFrame, label: str, c) -> DataFrame:
    """Two rows: the balanced weight of a class and of all others."""
    n = rows.agg(F.count_if(F.col(label) == c).alias("own"), F.count(F.lit(1)).alias("all")).first()
    return rows.sparkSession.createDataFrame([(1.0, n["all"] / (2.0 * n["own"])), (0.0, n["all"] / (2.0 * max(1, n["all"] - n["own"])))], "side_ double, share_ double")


def oversample(df: DataFrame, key: str, label: str, features: list[str], plan: DataFrame, method: str = "smote", k: int = 5, m: int = 10,
               categorical: list[str] = (), seed: int = 42, neighbours: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``df``'s (label, features) and the synthetic rows that ``plan(cls, n, target)`` asks for, with ``synthetic``.

    A synthetic row lies between a seed row and one of its ``k`` nearest rows of the
    same class, at a seeded place; categorical features take the commonest value of
    those neighbours. Seeds: all rows of a class in turn (``smote``), those of which
    half or more of the ``m`` nearest rows belong to other classes (``borderline``),
    all in proportion to that share (``adasyn``), or those on the margin of a linear machine
    (``svm``), of which rows with only other classes around are left out, and rows with fewer than
    half of them lead outwards, away from the neighbour by half the way at most. A class without
    such seeds uses all its rows; rows without a neighbour are repeated as they are.
    ``neighbours`` are tables of :func:`near_rows` inside the classes and among all rows, where several methods share them.
    """
    if method not in ("smote", "borderline", "adasyn", "svm"):
        raise ValueError(f"unknown method {method}")
    numeric = [c for c in features if c not in categorical]
    rows = written(df.where(F.col(label).isNotNull()).select(F.col(key).alias("rid_"), label, *features), "rows")
    near = neighbours[0].withColumnRenamed(key, "rid_") if neighbours else written(near_rows(rows, "rid_", numeric, k, [label], seed=seed), "near")
    weight, reach = F.lit(1.0), F.lit(1.0)
    seeds = rows.select("rid_", label)
    if method != "smote":
        other = neighbours[1].withColumnRenamed(key, "rid_") if neighbours else near_rows(rows.select("rid_", *numeric), "rid_", numeric, m, [], seed=seed + 1)
        labels = rows.select(F.col("rid_").alias("near_id"), F.col(label).alias("near_label"))
        share = (other.join(seeds, "rid_").join(labels, F.col("near") == F.col("near_id"))
                 .groupBy("rid_").agg(F.avg((F.col("near_label") != F.col(label)).cast("double")).alias("share_")))
        seeds = seeds.join(share, "rid_", "left")
        share = F.coalesce(F.col("share_"), F.lit(0.0))
        if method == "svm":
            margin = margin_rows(rows, "rid_", label, numeric, seed).withColumnRenamed("rid_", "margin_")
            seeds = seeds.join(margin, F.col("rid_") == F.col("margin_"), "left")
            weight, reach = (F.col("margin_").isNotNull() & (share < 1.0)).cast("double"), F.when(share >= 0.5, 1.0).otherwise(-0.5)
        else:
            weight = share if method == "adasyn" else (share >= 0.5).cast("double")
    seeds = written(seeds.select("rid_", label, weight.alias("w_"), reach.alias("reach_")), "seeds")
    totals = seeds.groupBy(F.col(label).alias("cls_")).agg(F.sum("w_").alias("sum_"), F.count(F.lit(1)).alias("n_"))
    want = plan.select(F.col("cls").alias("plan_"), (F.col("target") - F.col("n")).alias("extra_")).where(F.col("extra_") > 0)
    asked = totals.join(want, F.col("cls_") == F.col("plan_"))
    # Systematic shares: the copies of a row are the whole numbers in its stretch of the summed shares.
    shared = seeds.join(asked, F.col(label) == F.col("cls_")).withColumn("part_", F.when(F.col("sum_") > 0, F.col("w_") / F.col("sum_")).otherwise(1.0 / F.col("n_")) * F.col("extra_"))
    placed = prefix_sums(shared.select("rid_", label, "part_", "extra_"), [label], ["rid_"], "part_", "from_")
    # Sums of fractions are rounded to a grid, so that the last stretch ends on the whole total.
    grid = lambda c: F.round(c, 6)
    n = F.least(F.ceil(grid(F.col("from_") + F.col("part_"))), F.col("extra_")) - F.least(F.ceil(grid(F.col("from_"))), F.col("extra_"))
    made = placed.withColumn("n_", n.cast("int")).where(F.col("n_") > 0).select("rid_", label, F.explode(F.sequence(F.lit(1), F.col("n_"))).alias("i_"))
    known = near.groupBy("rid_").agg(F.max("place").alias("known_"))
    u = lambda salt: hash_uniform(F.concat_ws(":", "rid_", "i_", F.lit(salt)), seed)
    drawn = made.join(known, "rid_", "left").withColumn("place_", (F.floor(u("near") * F.coalesce("known_", F.lit(1))) + 1).cast("int")).withColumn("gap_", u("gap"))
    pick = near.select(F.col("rid_").alias("seed_"), F.col("place").alias("p_"), F.col("near").alias("near_"))
    drawn = drawn.join(pick, (F.col("rid_") == F.col("seed_")) & (F.col("place_") == F.col("p_")), "left")
    ends = rows.select(F.col("rid_").alias("end_"), *[F.col(c).alias(f"end_{c}") for c in numeric])
    reaches = seeds.select(F.col("rid_").alias("reach_id_"), "reach_")
    both = (drawn.join(rows.drop(label), "rid_").join(ends, F.coalesce("near_", "rid_") == F.col("end_"))
            .join(reaches, F.col("rid_") == F.col("reach_id_")))
    cols = {c: (F.col(c) + F.col("reach_") * F.col("gap_") * (F.col(f"end_{c}") - F.col(c))) for c in numeric}
    if categorical:
        values = rows.select(F.col("rid_").alias("val_"), *categorical)
        seen = near.join(values, F.col("near") == F.col("val_"))
        for c in categorical:
            top = seen.groupBy("rid_", c).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
            one = top.groupBy(F.col("rid_").alias(f"m_{c}")).agg(F.max_by(c, F.struct("n", -F.col("first"))).alias(f"mode_{c}"))
            both = both.join(one, F.col("rid_") == F.col(f"m_{c}"), "left")
            cols[c] = F.coalesce(F.col(f"mode_{c}"), F.col(c))
    new = both.select(label, *[cols[c].alias(c) for c in features], F.lit(True).alias("synthetic"))
    return rows.select(label, *features, F.lit(False).alias("synthetic")).unionByName(new)
