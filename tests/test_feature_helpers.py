"""Schema-level feature helpers."""

from emberline.operators import features as FE


def test_ordered_union_keeps_first_appearance():
    assert FE.ordered_union(["a", "b"], ["b", "c", "a"], ["d"]) == ["a", "b", "c", "d"]
    assert FE.ordered_union() == []


def test_feature_types(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "n int, v double, s string, f boolean")
    got = {r["feature"]: r["kind"] for r in FE.feature_types(df, ["n", "v", "s", "f", "missing"]).collect()}
    assert got == {"n": "numeric", "v": "numeric", "s": "categorical", "f": "numeric"}
