import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from emberline.operators import boosting as B


def table(spark, n=600, seed=3):
    """Three classes that two of four features tell apart, with some missing values and a weight."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), rng.random()]
        y = 0 if x[0] > 0.5 else 1 if x[1] > 0 or x[2] == 3 else 2
        if rng.random() < 0.1:
            x[rng.randrange(4)] = float("nan")
        rows.append((i, x, y, 1.0 + (y == 0)))
    df = spark.createDataFrame(rows, "id long, x array<double>, label int, weight double")
    return df.select("id", array_to_vector("x").alias("features"), "label", "weight")


def plain(rows, edges, base, params, rounds):
    """The same boosting in plain loops over all rows, splits by falling gain from one heap."""
    x = B.binned(np.array([r["x"] for r in rows], float), edges)
    y, w = np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])
    raw, losses = np.tile(base, (len(y), 1)), []

    def split_of(idx, g, h):
        best = None
        G, H = g[idx].sum(), h[idx].sum()
        for f in range(x.shape[1]):
            b = x[idx, f]
            for missing_left in ((True, False) if (b == 0).any() else (True,)):
                for at in range(1, len(edges[f]) + 1):
                    left = np.where(b == 0, missing_left, b <= at)
                    nl = left.sum()
                    gl, hl = g[idx][left].sum(), h[idx][left].sum()
                    if min(nl, len(idx) - nl) < params["least"] or min(hl, H - hl) < 1e-3:
                        continue
                    gain = gl ** 2 / (hl + 1e-12) + (G - gl) ** 2 / (H - hl + 1e-12) - G ** 2 / (H + 1e-12)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, idx[left], idx[~left])
        return best

    for _ in range(rounds):
        p = B._softmax(raw)
        losses.append(-(w * np.log(p[np.arange(len(y)), y])).sum() / w.sum())
        new = raw.copy()
        for c in range(raw.shape[1]):
            g, h = w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c])
            leaves = [(np.arange(len(y)), 0)]
            while len(leaves) < params["leaves"]:
                options = [(s, k) for k, (idx, d) in enumerate(leaves) if d < params["depth"] and (s := split_of(idx, g, h))]
                if not options:
                    break
                s, k = max(options, key=lambda o: o[0][0])
                d = leaves.pop(k)[1] + 1
                leaves += [(s[1], d), (s[2], d)]
            for idx, _ in leaves:
                new[idx, c] += -params["step"] * g[idx].sum() / (h[idx].sum() + 1e-12)
        raw = new
    return B._softmax(raw), losses


def test_equals_plain_boosting_and_loss_falls(spark):
    df = table(spark).persist()
    model = B.SoftmaxBoosting(weightCol="weight", maxIter=10, maxDepth=4, maxLeaves=6, minInstancesPerNode=15, stepSize=0.3, maxBins=16).fit(df.repartition(4))
    rows = df.select("id", vector_to_array("features").alias("x"), "label", "weight").orderBy("id").collect()
    want, losses = plain(rows, model.edges, model.base, {"least": 15, "depth": 4, "leaves": 6, "step": 0.3}, 10)
    got = {r["id"]: r["p"] for r in model.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}
    assert np.abs(np.array([got[r["id"]] for r in rows]) - want).max() < 1e-8
    assert np.allclose(model.losses, losses, rtol=1e-10) and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    assert all(sum(f < 0 for f in t.feature) <= 6 for trees in model.rounds for t in trees)
    hit = model.transform(df).where(F.col("prediction") == F.col("label")).count()
    assert hit > 0.85 * 600
    df.unpersist()


def test_stored_model_scores_the_same(spark, tmp_path):
    df = table(spark, 300)
    model = B.SoftmaxBoosting(maxIter=3, minInstancesPerNode=5).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = B.SoftmaxBoostingModel.load(str(tmp_path / "m"))
    score = lambda m: sorted((r["id"], tuple(r["p"]), r["prediction"]) for r in m.transform(df).select("id", "prediction", vector_to_array("probability").alias("p")).collect())
    assert score(model) == score(again) and again.losses == model.losses


def test_degenerate_rows(spark):
    one = spark.createDataFrame([(1, [1.0, float("nan")], 0), (2, [2.0, float("nan")], 0)], "id long, x array<double>, label int").withColumn("features", array_to_vector("x"))
    model = B.SoftmaxBoosting(maxIter=2).fit(one)
    assert [list(r["p"]) for r in model.transform(one).select(vector_to_array("probability").alias("p")).collect()] == [[1.0], [1.0]]
    with pytest.raises(ValueError):
        B.SoftmaxBoosting(maxIter=2).fit(one.where("id < 0"))


def test_against_rest_is_sparks_boosting(spark):
    """Features of few values, so that both see the same bins: margins of Spark's own boosting of each class against the others."""
    from pyspark.ml.classification import GBTClassifier

    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = [float(rng.randrange(6)), float(rng.randrange(5)), float(rng.randrange(3))]
        rows.append((i, x, int(x[0] > 2) + int(x[1] > 3 and x[2] > 0) if rng.random() > 0.1 else rng.randrange(3), 1.0 + rng.randrange(2)))
    df = spark.createDataFrame(rows, "id long, x array<double>, label int, weight double").select("id", array_to_vector("x").alias("features"), "label", "weight").persist()
    model = B.AgainstRestBoosting(weightCol="weight", maxIter=6, maxDepth=3, maxLeaves=8, minInstancesPerNode=1, stepSize=0.1, maxBins=32).fit(df.repartition(3))
    got = {r["id"]: r["m"] for r in model.transform(df).select("id", vector_to_array("rawPrediction").alias("m")).collect()}
    for c in range(3):
        one = GBTClassifier(labelCol="mine", weightCol="weight", maxIter=6, maxDepth=3, stepSize=0.1, maxBins=32).fit(df.withColumn("mine", (F.col("label") == c).cast("double")))
        for r in one.transform(df.withColumn("mine", F.lit(0.0))).select("id", vector_to_array("rawPrediction").alias("m")).collect():
            assert abs(got[r["id"]][c] - r["m"][1]) < 1e-6
    df.unpersist()


def test_sums_of_many_parts_are_those_of_few(spark, monkeypatch):
    df = table(spark, 200)
    fit = lambda: B.SoftmaxBoosting(maxIter=2, minInstancesPerNode=5).fit(df.repartition(5))
    few = fit()
    monkeypatch.setattr(B, "FEW_PARTS", 2)
    assert np.allclose(fit().losses, few.losses)


def test_registered_boostings_are_whole(monkeypatch):
    """300 rounds of depth 8, and all 255 bins where the estimator takes them."""
    from emberline.plans import catalog_ml as CM

    asked = []
    monkeypatch.setattr(CM, "fitted", lambda *a, **_: asked.append(a) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        CM.m6_gradient_boosting_ovr(None, "")
    assert asked[0][2:] in [("gradient_boosting",), ("gradient_boosting", {"max_iter": 300, "max_depth": 8})]
    assert {**{"maxBins": 255}, **CM.BOOSTING} == {"maxIter": 300, "maxDepth": 8, "maxLeaves": 31, "minInstancesPerNode": 20, "stepSize": 0.05, "maxBins": 255}
