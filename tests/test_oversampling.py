"""Neighbour oversampling: counts follow the plan, new rows lie between rows of their class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import evaluation as E
from emberline.operators import learning as L


def _data(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 1, float(x), float(y), "a") for i, (x, y) in enumerate(rng.normal(0, 1, (60, 2)))]
    rows += [(100 + i, 2, float(x), float(y), "b" if i % 3 else "c") for i, (x, y) in enumerate(rng.normal(1, 0.5, (12, 2)))]
    rows += [(200, 3, 50.0, 50.0, "z"), (300, None, 0.0, 0.0, "a")]
    return spark.createDataFrame(rows, "id long, cls int, x double, y double, c string"), rows


def test_near_rows_are_mostly_the_nearest(spark):
    df, rows = _data(spark)
    pts = {r[0]: np.array(r[2:4]) for r in rows if r[1] == 1}
    found = L.near_rows(df.where("cls = 1"), "id", ["x", "y"], 3, [])
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["near"])
        assert abs(r["d"] - np.linalg.norm(pts[r["id"]] - pts[r["near"]])) < 1e-9
    want = {i: set(sorted((j for j in pts if j != i), key=lambda j: np.linalg.norm(pts[i] - pts[j]))[:3]) for i in pts}
    assert np.mean([len(got[i] & want[i]) / 3 for i in pts]) > 0.85 and all(len(v) == 3 for v in got.values())


def test_index_reaches_its_recall_on_a_large_group(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, *map(float, p)) for i, p in enumerate(rng.normal(size=(3000, 4)))]
    df = spark.createDataFrame(rows, "id long, cls int, a double, b double, c double, d double")
    index = L.neighbour_index(df, "id", ["a", "b", "c", "d"], 5, ["cls"], projections=4, width=2)
    assert index.width > 2 and index.recall >= 0.9
    x = np.array([r[2:] for r in rows])
    got: dict[int, list] = {}
    for r in index.near(5, F.col("key_") % 100 == 0).collect():
        got.setdefault(r["id"], []).append(r["d"])
    exact = {r["id"]: [] for r in df.where("id % 100 = 0").collect()}
    for r in L.exact_near(df, "id", ["a", "b", "c", "d"], 5, ["cls"]).collect():
        exact[r["id"]].append(r["d"])
    hits = 0
    for i in range(0, 3000, 100):
        want = sorted(np.linalg.norm(x[i] - x[j]) for j in range(i % 2, 3000, 2) if j != i)[:5]
        assert np.allclose(sorted(exact[i]), want)
        hits += sum(d <= want[-1] + 1e-9 for d in got[i])
    assert hits / 150 == pytest.approx(index.recall)


def test_margin_rows_lie_between_the_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, float(rng.normal(6 * (i % 2) - 3, 1)), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, cls int, x double, y double")
    found = {r["id"] for r in L.margin_rows(df, "id", "cls", ["x", "y"]).collect()}
    assert 0 < len(found) < 200
    near, far = [abs(r[2]) for r in rows if r[0] in found], [abs(r[2]) for r in rows if r[0] not in found]
    assert np.mean(near) < np.mean(far)


@pytest.mark.parametrize("method", ["smote", "borderline", "adasyn", "svm"])
def test_counts_and_places(spark, method):
    df, rows = _data(spark)
    plan = E.oversampling_plan(df, "cls")
    out = L.oversample(df, "id", "cls", ["x", "y", "c"], plan, method, categorical=["c"]).collect()
    for cls, n in ((1, 60), (2, 60), (3, 60)):
        assert sum(r["cls"] == cls for r in out) == n, method
    assert sum(not r["synthetic"] for r in out) == len(rows) - 1
    low, high = np.min([r[2:4] for r in rows if r[1] == 2], axis=0), np.max([r[2:4] for r in rows if r[1] == 2], axis=0)
    for r in out:
        if r["synthetic"] and r["cls"] == 2 and method != "svm":
            assert (np.array([r["x"], r["y"]]) >= low - 1e-9).all() and (np.array([r["x"], r["y"]]) <= high + 1e-9).all() and r["c"] in ("b", "c")
        if r["cls"] == 3:
            assert (r["x"], r["y"], r["c"]) == (50.0, 50.0, "z")
    if method != "adasyn":
        return
    again = L.oversample(df.repartition(5), "id", "cls", ["x", "y", "c"], plan, method, categorical=["c"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_nothing_to_add(spark):
    df, _ = _data(spark)
    plan = E.oversampling_plan(df.where("cls = 1"), "cls")
    out = L.oversample(df.where("cls = 1"), "id", "cls", ["x", "y"], plan)
    assert out.count() == 60 and not out.where("synthetic").count()
    with pytest.raises(ValueError):
        L.oversample(df, "id", "cls", ["x"], plan, "other")


def test_near_rows_come_from_stretches_of_bounded_size(spark, monkeypatch):
    """The nearest of the rows beside each row in any order, across the ends of stretches, with keys and points that come twice, missing values and missing groups;
    no more than k rows an order and row leave a task."""
    rng = np.random.default_rng(2)
    rows = [(int(i % 90), None if i % 5 == 0 else int(i % 2), float(round(p[0], 1)), None if i == 7 else float(p[1])) for i, p in enumerate(rng.normal(size=(100, 2)))]
    df = spark.createDataFrame(rows, "id long, cls int, x double, y double")
    monkeypatch.setattr(L, "STRETCH", 16)
    index = L.neighbour_index(df, "id", ["x", "y"], 3, ["cls"], projections=2, width=2)
    index = L.NeighbourIndex(index.key, index.by, index.orders, 2, 0.0)
    want: dict = {}
    for order in index.orders:
        group: dict = {}
        for r in order.collect():
            group.setdefault(r["cls"], []).append(r)
        for own in group.values():
            own.sort(key=lambda r: r["at_"])
            for i, r in enumerate(own):
                for o in own[max(0, i - 2):i] + own[i + 1:i + 3]:
                    gap = None if None in (*r["x_"], *o["x_"]) else float(np.sqrt(sum((a - b) ** 2 for a, b in zip(r["x_"], o["x_"]))))
                    want.setdefault(r["key_"], set()).add((-1.0 if gap is None else gap, o["key_"]))
    got: dict = {}
    for r in index.near(3).collect():
        got.setdefault(r["id"], []).append((-1.0 if r["d"] is None else r["d"], r["near"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v)[:3] for i, v in want.items()}
    one = index.orders[0].select("cls", "key_", "x_", "at_", F.lit(True).alias("asked_"), F.lit(0).cast("long").alias("b_"))
    few = one.groupBy("cls").applyInArrow(L._nearest(3, 50, 1000), "key_ long, near long, d double")
    assert few.count() <= 3 * 100
