"""Fits on planted rows: held-out bounds, exact reductions, round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.operators import evaluation as E
from emberline.operators import learning as L
from emberline.sources import files as IO

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Class 0..2 told by a and b, count by a; c says nothing. Some values are missing."""
    rng = random.Random(7)
    out = []
    for i in range(900):
        a, b, c = rng.random() * 10, rng.random() * 10, rng.random()
        y = 0.0 if a < 4 else 1.0 if b < 5 else 2.0
        out.append((i, f"e{i // 3}", a if rng.random() > 0.03 else None, b, c, y, 3.0 * a + rng.gauss(0, 0.1), i % 3 == 0))
    df = spark.createDataFrame(out, "id long, event_id string, a double, b double, c double, label double, n double, is_test boolean").persist()
    yield df
    df.unpersist()


def parts(rows):
    return rows.where("not is_test"), rows.where("is_test")


@pytest.mark.parametrize(("kind", "params", "scale", "bound"), [
    ("decision_tree", {"max_depth": 5, "min_samples_leaf": 5}, False, 0.93), ("random_forest", {"n_estimators": 15, "max_depth": 6}, False, 0.93),
    ("gradient_boosting", {"max_iter": 5, "max_depth": 3}, False, 0.9), ("logistic", {"max_iter": 50}, True, 0.8)])
def test_classifiers_hold_out(rows, kind, params, scale, bound):
    train, test = parts(rows)
    pred = L.fit_filled(train, FEATS, kind, params, standardize=scale).predict(test, ["id"])
    found = E.passport_values(pred)
    assert found["accuracy"] > bound and found["test_size"] == 300 and found["n_classes"] == 3
    assert all(len(r["probability"]) == 6 and abs(sum(r["probability"]) - 1) < 1e-9 for r in pred.collect())


def test_passport_against_plain(rows):
    train, test = parts(rows)
    pred = L.fit_filled(train, FEATS, "decision_tree", {"max_depth": 2, "min_samples_leaf": 5}).predict(test, ["id"])
    got, data = E.passport_values(pred), pred.collect()
    y, p = np.array([r["y"] for r in data]), np.array([r["yhat"] for r in data])
    f1 = []
    for c in sorted({*y, *p}):
        hit = ((y == c) & (p == c)).sum()
        f1.append(2 * hit / ((y == c).sum() + (p == c).sum()))
    assert got["accuracy"] == pytest.approx((y == p).mean()) and got["f1_macro"] == pytest.approx(np.mean(f1))
    conf = np.array([max(r["probability"]) for r in data])
    bucket = np.minimum((conf * 10).astype(int), 9)
    ece = sum((bucket == b).sum() * abs((y == p)[bucket == b].mean() - conf[bucket == b].mean()) for b in set(bucket)) / len(y)
    assert got["calibration_error"] == pytest.approx(ece)
    places = [sum((q, -j) > (r["probability"][r["y"] - 1], -(r["y"] - 1)) for j, q in enumerate(r["probability"])) + 1 for r in data]
    assert got["top_2_accuracy"] == pytest.approx(np.mean([x <= 2 for x in places]))
    assert E.passport_values(pred.limit(0))["accuracy"] is None


def test_calibration_sums_to_one_and_keeps_accuracy(rows):
    train, test = parts(rows)
    for method in ("sigmoid", "isotonic"):
        pred = L.calibrate(train, FEATS, "decision_tree", {"max_depth": 5, "min_samples_leaf": 5}, method).predict(test, ["id"])
        assert E.passport_values(pred)["accuracy"] > 0.9
        assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in pred.collect())


def test_calibrations_share_their_fits(rows, monkeypatch):
    train, test = parts(rows)
    params = {"max_depth": 5, "min_samples_leaf": 5}
    base, scores = L.fit_filled(train, FEATS, "decision_tree", params), L.out_of_fold(train, FEATS, "decision_tree", params)
    assert scores.count() == train.count()
    monkeypatch.setattr(L, "fit_filled", None)  # nothing is fitted again
    for method in ("sigmoid", "isotonic"):
        pred = L.calibrate(train, FEATS, "decision_tree", params, method, scores=scores, base=base).predict(test, ["id"])
        assert E.passport_values(pred)["accuracy"] > 0.9


@pytest.mark.parametrize("kind", ["random_forest", "decision_tree"])
def test_regressors_hold_out(rows, kind):
    train, test = parts(rows.where("a is not null"))
    model = L.fit_regressor(train, FEATS, "n", kind, {"n_estimators": 15, "max_depth": 8, "min_samples_leaf": 3})
    found = L.regression_metrics(model.transform(test), "n", "prediction").first()
    assert found["r2"] > 0.95 and found["mae"] < 2 and found["n"] == test.count()
    if kind == "random_forest":
        trees = [[t.predict(r["features"]) for t in model.stages[-1].trees] for r in model.transform(test).orderBy("id").limit(20).collect()]
        got = L.resource_quantiles(model, test, ["id"]).orderBy("id").limit(20).collect()
        for values, r in zip(trees, got, strict=True):
            assert [r["p20"], r["p50"], r["p80"]] == pytest.approx(list(np.quantile(values, [0.2, 0.5, 0.8]))) and r["std"] == pytest.approx(np.std(values))


def test_folds(rows):
    placed = L.stratified_folds(rows, "label", ["id"], 5)
    sizes = [(r["label"], r["n"]) for r in placed.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    for y in (0.0, 1.0, 2.0):
        own = [n for c, n in sizes if c == y]
        assert len(own) == 5 and max(own) - min(own) <= 1
    cv = L.cross_validate(placed, FEATS, "decision_tree", {"max_depth": 5, "min_samples_leaf": 5}, folds=5, fold="fold").first()
    assert cv["folds"] == 5 and cv["accuracy_mean"] > 0.9 and 0 <= cv["accuracy_std"] < 0.1
    data = L.fold_column(rows, "event_id", 3)
    assert data.groupBy("event_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    reg = L.cross_validate_regression(rows, FEATS, "n", {"max_depth": 8, "min_samples_leaf": 3}, folds=3, kind="decision_tree").first()
    assert reg["folds"] == 3 and reg["r2_mean"] > 0.8


def test_importances_find_what_decides(rows):
    train, test = parts(rows)
    m = L.fit_filled(train, FEATS, "random_forest", {"n_estimators": 15, "max_depth": 6})
    impurity = {r["feature"]: r["importance"] for r in L.impurity_importance(m.model, FEATS).collect()}
    shuffled = {r["feature"]: r["importance_mean"] for r in L.permutation_importance(m.model, m.filled(test), FEATS, repeats=2).collect()}
    for found in (impurity, shuffled):
        assert found["a"] > found["c"] and found["b"] > found["c"]
    assert abs(shuffled["c"]) < 0.05 < shuffled["a"]


def test_uncertainty_over_trees_against_plain(rows):
    train, test = parts(rows)
    m = L.fit_filled(train, FEATS, "random_forest", {"n_estimators": 7, "max_depth": 4})
    some = m.filled(test).where("id < 60")
    got = {r["id"]: r for r in L.ensemble_uncertainty(m.model, some, ["id"]).collect()}
    for r in m.model.stages[0].transform(some).select("id", "features").collect():
        p = np.array([t.predictProbability(r["features"]).toArray() for t in m.model.stages[-1].trees])
        mean = p.mean(axis=0)
        assert got[r["id"]]["predicted_class"] == mean.argmax() + 1 and got[r["id"]]["mean_prob_class"] == pytest.approx(mean.max())
        assert got[r["id"]]["std_prob_class"] == pytest.approx(p.std(axis=0).max()) and got[r["id"]]["n_trees"] == 7


def test_confidence_is_over_all_trees(rows, monkeypatch):
    from emberline.plans import catalog_ml as CM

    train, test = parts(rows)
    m = L.fit_filled(train, FEATS, "random_forest", {"n_estimators": 33, "max_depth": 3})
    some = test.where("id < 60").withColumns({"sheet_ord": F.lit(1), "row_id": F.col("id")})
    monkeypatch.setattr(CM, "fitted", lambda *_: (m, some))
    got = {r["row_id"]: r for r in CM.m18_prediction_with_confidence(None, "").collect()}
    assert len(got) == some.count()
    for r in m.model.stages[0].transform(m.filled(some)).select("row_id", "features").collect():
        p = np.array([t.predictProbability(r["features"]).toArray() for t in m.model.stages[-1].trees])
        assert got[r["row_id"]]["n_trees"] == 33 and got[r["row_id"]]["std_prob_class"] == pytest.approx(p.std(axis=0).max())


def test_subsets_segments_and_components(rows):
    study = L.subset_study(rows, FEATS, max_size=2, trees=5).collect()
    assert len(study) == 3 and study[0]["features"] == "a,b"
    seg, info = L.segment(rows.withColumn("far", F.when(F.col("label") == 2, 100.0).otherwise(0.0)), ["far"], k=2, keep=["label"], restarts=2)
    sizes = {(r["label"] == 2, r["cluster"]) for r in seg.select("label", "cluster").distinct().collect()}
    assert len(sizes) == 2 and info["inertia"] == pytest.approx(0, abs=1e-6)
    pc = L.pca_2d(rows.withColumn("twin", F.col("b") * 2), ["b", "twin"], keep=["id"])
    assert pc.agg(F.stddev_pop("pc2")).first()[0] == pytest.approx(0, abs=1e-6) and pc.agg(F.stddev_pop("pc1")).first()[0] == pytest.approx(2 ** 0.5, rel=0.01)


def test_predictions_round_trip(spark, rows, tmp_path):
    train, test = parts(rows)
    top = E.top_k(L.fit_filled(train, FEATS, "decision_tree", {"max_depth": 3}).predict(test, ["id"]), ["id"], 3)
    path = IO.write_predictions(top, str(tmp_path / "p"), {"model": "tree", "k": 3, "words": "ранг"})
    back, meta = IO.read_predictions(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in top.schema]))
    assert meta == {"model": "tree", "k": 3, "words": "ранг"} and sorted(map(tuple, back.collect())) == sorted(map(tuple, top.collect()))


def test_work_per_row_of_the_reductions(spark):
    """A sum over trees is worked out once a row: each level of arrays is a column of its own, made by one Generate."""
    probs = spark.range(1).select("id", F.array(*[F.array(*[F.lit((i + j) / 30.0) for j in range(6)]) for i in range(5)]).alias("tree_probs"))
    plan = L.reduce_tree_probabilities(probs, ["id"])._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 6 and plan.count("array_sort(") == 1
    r = L.reduce_tree_probabilities(probs, ["id"]).first()
    assert r["mean_prob_class"] == pytest.approx(7 / 30) and r["std_prob_class"] == pytest.approx(2 ** 0.5 / 30)
    assert L.reduce_tree_values(spark.range(1).select("id", F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("tree_values")), ["id"]).first()["std"] == pytest.approx((2 / 3) ** 0.5)
