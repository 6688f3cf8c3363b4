"""Registered queries: Spark ML fitting, scoring, uncertainty, clustering, pipelines.

Fits are iterative or randomised and have no SQL twin; what is done with their
outputs is checked on deterministic tables in ``catalog_reduce``. Estimators run
with the reference's parameters unless a query's docstring says otherwise.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import feature_sets as FS
from ..operators import evaluation as E
from ..operators import exploration as X
from ..operators import features as FE
from ..operators import learning as L
from ..operators import splits as SP
from ..operators import stages as ST
from ..operators.boosting import SoftmaxBoosting
from ..session import written
from . import incidents as V
from .registry import register

K = ["sheet_ord", "row_id"]
FEATS = FS.TRAINING_SETS["managed"]
FOREST = {"n_estimators": 100, "max_depth": 15, "min_samples_leaf": 5}


def training_rows(spark, sf, extra: list[str] = ()):
    """Labelled canonical rows with label 0..5 and a group split, written once; features are as they come, not filled."""
    lab = V.labelled(spark, sf).where(F.col("is_canonical_event_record") & F.col("usable_for_training"))
    cols = list(dict.fromkeys([*K, "event_id", "equipment_count", "rank_tz", *FEATS, *extra]))
    return written(SP.split(written(L.with_label(lab.select(*cols)), "labelled"), "group_shuffle", 0.25, 42), "split")


def _parts(rows):
    return rows.where(~F.col("is_test")), rows.where(F.col("is_test"))


def fitted(spark, sf, kind: str, params: dict | None = None, standardize: bool = False):
    """Fills and model of the training part, and the test part."""
    train, test = _parts(training_rows(spark, sf))
    return L.fit_filled(train, FEATS, kind, params, standardize=standardize), test


@register("m3_decision_tree", ids=("M3", "M12"))
def m3_decision_tree(spark, sf):
    """Balanced decision tree (depth 10, leaf 10) -> test metric passport."""
    m, test = fitted(spark, sf, "decision_tree", {"max_depth": 10, "min_samples_leaf": 10})
    return E.metric_passport(m.predict(test, K))


@register("m4_random_forest", ids=("M4", "M12"))
def m4_random_forest(spark, sf):
    """Balanced random forest (100 trees, depth 15, leaf 5) -> test metric passport."""
    m, test = fitted(spark, sf, "random_forest", FOREST)
    return E.metric_passport(m.predict(test, K))


def _regression(spark, sf, kind: str = "random_forest", params: dict | None = None):
    train, test = _parts(training_rows(spark, sf).where(F.col("equipment_count").isNotNull()))
    fills = L.median_fills(train, FEATS)
    m = L.fit_regressor(L.apply_fills(train, fills), FEATS, "equipment_count", kind, params or FOREST)
    return m, train, L.apply_fills(test, fills)


@register("m5_resource_regressor", ids=("M5",))
def m5_resource_regressor(spark, sf):
    """Forest and tree regressors of the equipment count -> MAE, MSE, RMSE, R2."""
    out = None
    for kind, params in (("random_forest", FOREST), ("decision_tree", {"max_depth": 10, "min_samples_leaf": 10})):
        m, _, test = _regression(spark, sf, kind, params)
        one = L.regression_metrics(m.transform(test), "equipment_count", "prediction").select(F.lit(kind).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("m6_gradient_boosting_ovr", ids=("M6",))
def m6_gradient_boosting_ovr(spark, sf):
    """One-against-rest boosted trees (300 rounds of depth 8) -> test metric passport."""
    m, test = fitted(spark, sf, "gradient_boosting", {"max_iter": 300, "max_depth": 8})
    return E.metric_passport(m.predict(test, K))


BOOSTING = {"maxIter": 300, "maxDepth": 8, "maxLeaves": 31, "minInstancesPerNode": 20, "stepSize": 0.05, "maxBins": 255}


@register("m6_softmax_boosting", ids=("M6", "M12"))
def m6_softmax_boosting(spark, sf):
    """Multinomial boosted trees (depth 8, 31 leaves of 20 rows, step 0.05, 300 rounds) with balanced weights; missing values go the way of more gain.

    Test metric passport, and the training loss before the first and the last round.
    """
    train, test = _parts(training_rows(spark, sf))
    shaped = lambda part: L.assemble(part, FEATS)
    model = SoftmaxBoosting(weightCol="weight", **BOOSTING).fit(L.spread(shaped(E.with_class_weights(train, "label"))))
    found = E.metric_passport(L.predict(model, shaped(test), K))
    losses = spark.createDataFrame([("loss_first", float(model.losses[0])), ("loss_last", float(model.losses[-1]))], "metric string, value double")
    return found.unionByName(losses)


@register("m7_logistic_regression", ids=("M7",))
def m7_logistic_regression(spark, sf):
    """Multinomial logistic regression (1000 iterations) on z-scored features -> test metric passport."""
    m, test = fitted(spark, sf, "logistic", {"max_iter": 1000}, standardize=True)
    return E.metric_passport(m.predict(test, K))


@register("m8_calibration", ids=("M8",))
def m8_calibration(spark, sf):
    """Test metrics of a tree as it is, with sigmoid and with isotonic calibration on three out-of-fold parts."""
    train, test = _parts(training_rows(spark, sf))
    params = {"max_depth": 10, "min_samples_leaf": 10}
    base, scores = L.fit_filled(train, FEATS, "decision_tree", params), L.out_of_fold(train, FEATS, "decision_tree", params)
    out = E.metric_passport(base.predict(test, K)).select(F.lit("none").alias("calibration"), "*")
    for method in ("sigmoid", "isotonic"):
        c = L.calibrate(train, FEATS, "decision_tree", params, method, scores=scores, base=base)
        out = out.unionByName(E.metric_passport(c.predict(test, K)).select(F.lit(method).alias("calibration"), "*"))
    return out


@register("m10_cross_validation", ids=("M10",))
def m10_cross_validation(spark, sf):
    """5 group folds (hash of event id) -> mean and std of accuracy / F1 macro / F1 weighted of the forest."""
    return L.cross_validate(training_rows(spark, sf), FEATS, "random_forest", FOREST, folds=5)


@register("m10_regression_folds", ids=("M10", "M5"))
def m10_regression_folds(spark, sf):
    """5 group folds -> mean MAE, RMSE, R2 of a forest of 30 trees on the equipment count."""
    rows = training_rows(spark, sf).where(F.col("equipment_count").isNotNull())
    return L.cross_validate_regression(rows, FEATS, "equipment_count", {"n_estimators": 30, "max_depth": 10}, folds=5)


@register("m10_tree_folds", ids=("M10",))
def m10_tree_folds(spark, sf):
    """5 stratified folds -> mean and std of accuracy / F1 macro / F1 weighted of the decision tree (depth 10, leaf 10)."""
    rows = L.stratified_folds(training_rows(spark, sf), "label", K, 5)
    return L.cross_validate(rows, FEATS, "decision_tree", {"max_depth": 10, "min_samples_leaf": 10}, folds=5, fold="fold")


@register("m10_tree_regression_folds", ids=("M10", "M5"))
def m10_tree_regression_folds(spark, sf):
    """5 folds of rows -> mean MAE, RMSE, R2 of the decision tree (depth 10, leaf 10) on the equipment count."""
    rows = training_rows(spark, sf).where(F.col("equipment_count").isNotNull()).withColumn("one_", F.lit(0))
    return L.cross_validate_regression(L.stratified_folds(rows, "one_", K, 5), FEATS, "equipment_count", {"max_depth": 10, "min_samples_leaf": 10}, folds=5,
                                       kind="decision_tree", fold="fold")


@register("m11_grouped_search", ids=("M11",))
def m11_grouped_search(spark, sf):
    """20 settings from the whole space of a decision tree over three inner group folds, every stage refitted in each; best first.

    Settings are drawn by a seeded generator where the reference lets earlier trials guide later ones.
    """
    feats = FS.CONTRACT_SETS["dispatch_initial_safe"][0]
    train, _ = _parts(training_rows(spark, sf, feats))
    return ST.grouped_search(train, feats, "decision_tree", trials=20, parallelism=8)[0]


@register("m14_feature_importance", ids=("M14",))
def m14_feature_importance(spark, sf):
    """Impurity importance of the forest joined with permutation importance (3 repeats) on the test split."""
    m, test = fitted(spark, sf, "random_forest", FOREST)
    perm = L.permutation_importance(m.model, m.filled(test), FEATS, repeats=3)
    return L.impurity_importance(m.model, FEATS).join(perm, "feature").orderBy(F.desc("importance"))


@register("m15_batch_scoring", ids=("M15", "T3"))
def m15_batch_scoring(spark, sf):
    """Score every incident (not only labelled ones) with fills and forest of the training rows: top-3 ranks per row."""
    m, _ = fitted(spark, sf, "random_forest", FOREST)
    return E.top_k(m.probabilities(V.labelled(spark, sf).select(*K, *FEATS), K), K, 3)


@register("m15_batch_export", ids=("M15", "M18", "S10"))
def m15_batch_export(spark, sf):
    """Every incident as it came in, with its three likeliest ranks, confidence over the trees, the model's passport and the inputs that the table lacks.

    The model is a stored and loaded pipeline of preprocessor, weights and forest; the table lacks the distance to the station.
    """
    from ..sources.files import load_model, save_model
    from ..streaming import scratch

    feats = FS.CONTRACT_SETS["dispatch_initial_safe"][0]
    rows = training_rows(spark, sf, [*feats, "fire_date"])
    train, _ = _parts(rows)
    overlap = SP.passport(rows, "group_shuffle").first()["event_overlap_rate"]
    path = scratch(spark, "model")
    info = {"model_id": "m15", "model_name": "random_forest_rank_tz_vector", "deployment_role": "rank_tz_lpr_production", "semantic_target": "rank_tz_vector",
            "availability_stage": "dispatch_initial", "split_protocol": "group_shuffle", "event_overlap_rate": float(overlap)}
    save_model(ST.rank_pipeline(feats, "random_forest", FOREST).fit(L.spread(train)), path, info)
    model, passport = load_model(spark, path)
    incoming = V.labelled(spark, sf).select(*K, *[c for c in feats if c != "distance_to_station"])
    return ST.batch_scoring(model, written(incoming, "incoming"), K, passport)[0]


@register("m16_ensemble_uncertainty", ids=("M16",))
def m16_ensemble_uncertainty(spark, sf):
    """Per-row mean/std/p05/p95 of class probabilities over 30 of the forest's trees (+ entropy)."""
    m, test = fitted(spark, sf, "random_forest", FOREST)
    return L.ensemble_uncertainty(m.model, m.filled(test), K, n_trees=30)


@register("m18_prediction_with_confidence", ids=("M18", "M15", "M16"))
def m18_prediction_with_confidence(spark, sf):
    """Top-1 class of the forest joined by row key with the uncertainty over all its trees."""
    m, test = fitted(spark, sf, "random_forest", FOREST)
    top = E.top_k(m.predict(test, K), K, 1).drop("position")
    return top.join(L.ensemble_uncertainty(m.model, m.filled(test), K), K)


@register("m17_resource_quantiles", ids=("M17",))
def m17_resource_quantiles(spark, sf):
    """P20/P50/P80, min, max, std of per-tree equipment-count predictions."""
    m, _, test = _regression(spark, sf)
    return L.resource_quantiles(m, test, K)


_SEG = ["building_floors", "fire_floor", "distance_to_station", "t_detect_min"]


@register("m20_kmeans_segmentation", ids=("M20", "A19"))
def m20_kmeans_segmentation(spark, sf):
    """k-means (k=4, best of 10 seeds) on all rows, missing values as 0, standardised -> cluster profile."""
    rows = V.labelled(spark, sf).select(*K, "rank_tz", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _SEG])
    z = L.standardize(written(rows, "rows"), _SEG, keep=K + ["rank_tz"])
    seg, info = L.segment(z, _SEG, k=4, keep=K + ["rank_tz"], restarts=10)
    return E.cluster_profile(seg, "cluster", _SEG, "rank_tz").withColumn("inertia", F.lit(info["inertia"]))


_OUTPUTS, _OBSERVED, _MANAGED = ["fatalities", "injuries", "direct_damage"], ["fire_floor", "t_detect_min", "t_arrival_min"], ["region_code", "building_floors", "distance_to_station"]
GROUPS = {"managed": _MANAGED, "observed": _OBSERVED, "outputs": _OUTPUTS, "mixed_core": _SEG, "managed+observed": _MANAGED + _OBSERVED,
          "observed+outputs": _OBSERVED + _OUTPUTS, "managed+outputs": _MANAGED + _OUTPUTS}


@register("m21_clustering_grid", ids=("M21", "M22", "M23", "M24"))
def m21_clustering_grid(spark, sf):
    """7 feature groups x {dropna, impute} x {k-means, Ward} x k 2..10 against the severity rank -> composite leaderboard.

    k-means is the best of 20 starts; the silhouette is that of all rows, by Euclidean distances to all rows.
    """
    cols = list(dict.fromkeys(c for g in GROUPS.values() for c in g))
    number = F.col("row_id") * 8 + F.col("sheet_ord")
    rows = written(V.cleaned(spark, sf).select(number.cast("long").alias("key"), *cols, "rank_ref", "flag_time_invalid"), "segments")
    return E.composite_score(L.clustering_grid(rows, GROUPS, "rank_ref", list(range(2, 11)))).orderBy(F.desc("final_score"), "run_id")


@register("m25_pca", ids=("M25",))
def m25_pca(spark, sf):
    """Two principal components of standardised numeric features, missing values as 0."""
    rows = V.labelled(spark, sf).select(*K, *[F.col(c).cast("double").alias(c) for c in _SEG])
    return L.pca_2d(written(rows, "rows"), _SEG, keep=K)


@register("m27_feature_subset_study", ids=("M27",))
def m27_feature_subset_study(spark, sf):
    """All 2..4-feature subsets of a pool of four -> forest (50 trees, depth 10) -> F1 ranking."""
    pool = ["region_code", "building_floors", "fire_floor", "distance_to_station"]
    return L.subset_study(training_rows(spark, sf), pool, "is_test", max_size=4, trees=50)


@register("m28_rank_vs_resource", ids=("M28", "R11"))
def m28_rank_vs_resource(spark, sf):
    """Rank classifier accuracy vs regressor MAE vs rank induced from the predicted resource count."""
    from ..functions.resources import rank_from_resources

    reg, train, test = _regression(spark, sf)
    clf = L.fit_filled(train, FEATS, "random_forest", FOREST)
    c = clf.predict(test, []).agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("classifier_accuracy"))
    r = reg.transform(test)
    induced = r.select((FE.rank_to_class(rank_from_resources(F.col("prediction"))) - 1).alias("p"), "label")
    i = induced.agg(F.avg((F.col("p") == F.col("label")).cast("double")).alias("induced_rank_accuracy"))
    mae = r.agg(F.avg(F.abs(F.col("prediction") - F.col("equipment_count"))).alias("regressor_mae"))
    return c.crossJoin(mae).crossJoin(i)  # one row each


@register("m30_neighbour_oversampling", ids=("M30", "M29"))
def m30_neighbour_oversampling(spark, sf):
    """Real and synthetic rows per class after each kind of neighbour oversampling of the training part."""
    train, _ = _parts(training_rows(spark, sf))
    num = ["building_floors", "fire_floor", "distance_to_station"]
    rows = written(L.apply_fills(train, L.median_fills(train, num)).select((F.col("row_id").cast("long") * 8 + F.col("sheet_ord")).alias("id"), (F.col("label") + 1).cast("int").alias("cls"), *num, "region_code"), "rows")
    plan = written(E.oversampling_plan(rows, "cls"), "plan")
    near = (written(L.near_rows(rows, "id", num, 5, ["cls"]), "near"), written(L.near_rows(rows, "id", num, 10, []), "around"))
    out = None
    for method in ("smote", "borderline", "adasyn", "svm"):
        one = L.oversample(rows, "id", "cls", [*num, "region_code"], plan, method, categorical=["region_code"], neighbours=near)
        one = one.groupBy("cls").agg(F.count_if(~F.col("synthetic")).alias("n_real"), F.count_if("synthetic").alias("n_synthetic")).select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("m30_neighbour_recall", ids=("M30",))
def m30_neighbour_recall(spark, sf):
    """Measured recall of the neighbour indexes that oversampling uses: 5 nearest inside the class and 10 nearest of all rows, of the rows whose id is
    divisible by 100 against all rows; with the stretch of rows that was needed."""
    train, _ = _parts(training_rows(spark, sf))
    num = ["building_floors", "fire_floor", "distance_to_station"]
    rows = written(L.apply_fills(train, L.median_fills(train, num)).select((F.col("row_id").cast("long") * 8 + F.col("sheet_ord")).alias("id"), "label", *num), "rows")
    found = [(scope, k, ix.width, ix.recall) for scope, k, by in (("class", 5, ["label"]), ("all", 10, [])) for ix in [L.neighbour_index(rows, "id", num, k, by)]]
    return spark.createDataFrame(found, "scope string, k int, width int, recall double")


@register("m34_train_pipeline", ids=("M34", "U1", "S13"))
def m34_train_pipeline(spark, sf):
    """Stage features -> group split -> preprocessor of the training part -> tree -> calibration -> passport, importances, stored model."""
    from ..sources.files import load_model, save_model
    from ..streaming import scratch

    feats = FS.CONTRACT_SETS["arrival_update_safe"][0]
    lab = V.labelled(spark, sf).where(F.col("is_canonical_event_record") & F.col("usable_for_training"))
    staged = FE.ensure_columns(FE.stage_features(lab, "arrival_update_safe"), feats)
    rows = written(SP.split(written(L.with_label(staged.select(*K, "event_id", "fire_date", "rank_tz", *feats)), "labelled"), "group_shuffle", 0.25, 42), "split")
    train, test = _parts(rows)
    fitted = ST.rank_pipeline(feats, "decision_tree", {"max_depth": 10, "min_samples_leaf": 10}, "sigmoid").fit(L.spread(train))
    path = scratch(spark, "model")
    save_model(fitted, path, {"feature_set": "arrival_update_safe", "rows": train.count()})
    # All that follows is said by the model as it was stored: preprocessor, tree and curves.
    kept, _ = load_model(spark, path)
    metrics = E.metric_passport(ST.rank_predictions(kept, test, K)).select(F.lit("test").alias("section"), "metric", "value")
    top = ST.importances(kept).orderBy(F.desc("importance"), "feature").limit(10)
    split = SP.passport(rows, "group_shuffle").select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("event_overlap_rate", "train_event_count", "test_event_count", "train_rows", "test_rows")])).alias("s"))
    return (metrics.unionByName(top.select(F.lit("importance").alias("section"), F.col("feature").alias("metric"), F.col("importance").alias("value")))
            .unionByName(split.select(F.lit("split").alias("section"), "s.metric", "s.value")))


@register("m37_pipeline_audit", ids=("M37",))
def m37_pipeline_audit(spark, sf):
    """Test metrics with all features, with late ones set to 0, and under four fill and weight strategies; missing % of features."""
    train, test = _parts(training_rows(spark, sf, FS.TRAINING_SETS["online_early"]))
    feats, params = FS.TRAINING_SETS["online_early"], {"max_depth": 10, "min_samples_leaf": 10}
    full = L.fit_filled(train, feats, "decision_tree", params)
    late = [c for c in feats if c not in FS.TRAINING_SETS["minimal"]]
    variants = [("full", full.predict(test, [])), ("late_features_zero", full.predict(test.withColumns({c: F.lit(0.0) for c in late}), []))]
    for fill in (-1.0, 0.0):
        for balanced in (True, False):
            fills = {c: fill for c in feats}
            m = L.fit(L.apply_fills(train, fills), feats, "decision_tree", params, balanced=balanced)
            variants.append((f"fill={fill:g},{'balanced' if balanced else 'plain'}", L.predict(m, L.apply_fills(test, fills), [])))
    out = None
    for name, pred in variants:
        one = E.metric_passport(pred).where(F.col("metric").isin(*L.METRICS)).select(F.lit(name).alias("variant"), "metric", "value")
        out = one if out is None else out.unionByName(one)
    from ..operators.profiling import missing_report

    miss = missing_report(test, feats, 20)
    return out.unionByName(miss.select(F.lit("missing_pct").alias("variant"), F.col("column").alias("metric"), F.col("missing_pct").alias("value")))


@register("m40_variant_comparison", ids=("M40", "T4", "J8"))
def m40_variant_comparison(spark, sf):
    """Original, enhanced, generated and combined feature tables x tree, forest and logistic over three group folds -> leaderboard.

    Tables are joined by row key. The forest has 20 trees here, for the reference's 100 and 200, as twelve tables and models are folded.
    """
    base = training_rows(spark, sf, ["fire_date", "t_detect_min", "t_report_min", "t_arrival_min"])
    enhanced = FE.add_all(FE.ensure_columns(base, ["t_first_hose_min", "t_contained_min", "t_extinguished_min"]))
    extra = ["season", "is_weekend", "is_high_rise", "fire_floor_ratio", "is_far", "distance_category", "building_floors_bin"]
    named = {f"g{i}": e for i, e in enumerate(list(X.generated_features(["building_floors", "fire_floor", "distance_to_station"]).values())[3:23])}
    made = base.select(*K, *[e.alias(n) for n, e in named.items()])
    rows = written(base.join(enhanced.select(*K, *extra), K).join(made, K), "variants")
    tables = {"original": FEATS, "enhanced": FEATS + extra, "generated": list(named), "combined": FEATS + extra + list(named)}
    models = {"tree": ("decision_tree", {"max_depth": 10, "min_samples_leaf": 10}, False), "forest": ("random_forest", {"n_estimators": 20, "max_depth": 10}, False),
              "logistic": ("logistic", {"max_iter": 200}, True)}
    def one(pair):
        (t, feats), (m, (kind, params, scale)) = pair
        cv = L.cross_validate(rows, feats, kind, params, folds=3, standardize=scale)
        return cv.select(F.lit(f"{t}+{m}").alias("name"), F.lit(len(feats)).alias("n_features"), "*")

    with ThreadPoolExecutor(3) as pool:
        out = reduce(DataFrame.unionByName, pool.map(one, itertools.product(tables.items(), models.items())))
    runs = written(out, "variants")
    board = X.leaderboard(runs, "f1_macro_mean", "name", "original+tree", top=len(tables) * len(models))
    return board.join(runs.drop("f1_macro_mean"), "name").orderBy(F.desc("f1_macro_mean"), "name")
