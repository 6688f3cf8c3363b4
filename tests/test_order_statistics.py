"""Percentiles and ranks by prefix sums: many values, many groups, infinite values, ties."""

import math

import numpy as np
from pyspark.sql import functions as F

from emberline.operators.prefix import prefix_sums, row_at
from emberline.operators.profiling import average_ranks, dense_ranks, robust_summary, value_counts
from emberline.operators.quantiles import percentile_values, percentiles


def test_average_ranks_of_many_values(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"))
    wrong = average_ranks(df, "v").where(F.col("avg_rank") != F.col("value") + 1).count()
    assert wrong == 0


def test_percentiles_of_many_groups(spark):
    df = spark.range(600_000).select((F.col("id") % 200_000).alias("g"), F.col("id").cast("double").alias("v"))
    found = percentiles(df, "v", {0.5: "median", 0.25: "q"}, ["g"])
    bad = found.where((F.col("median") != F.col("g") + 200_000) | (F.col("q") != F.col("g") + 100_000) | (F.col("n") != 3)).count()
    assert found.count() == 200_000 and bad == 0


def test_infinite_and_missing_values(spark):
    rows = [(float(i),) for i in range(1999)] + [(math.inf,), (math.nan,), (None,)]
    df = spark.createDataFrame(rows, "v double")
    got = percentile_values(df, "v", [0.0, 0.5, 1.0])
    assert got == {("v", 0.0): 0.0, ("v", 0.5): 999.5, ("v", 1.0): math.inf}
    assert percentile_values(df.where("v is null"), "v", [0.5]) == {}


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), np.round(rng.normal(size=3000), 1))]
    rows += [(None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in percentiles(df, "v", {0.05: "a", 0.5: "b", 0.95: "c"}, ["g"]).collect():
        values = [v for g, v in rows if g == r["g"]]
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(values, [0.05, 0.5, 0.95]))
    s = {r["g"]: r for r in robust_summary(df, ["v"], ["g"]).collect()}
    assert s[None]["median"] == 2.5 and s[None]["mad"] == 1.5


def test_dense_ranks_and_prefix_sums(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("b", 9), (None, 2), (None, 5), ("b", None)], "g string, v int")
    got = {(r["g"], r["value"]): r["dense_rank"] for r in dense_ranks(df, "v", ["g"]).collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, ("b", 9): 1, (None, 2): 1, (None, 5): 2}
    sums = {r["v"]: r["s"] for r in prefix_sums(df.where("g = 'a'").distinct(), [], ["v"], "v", "s").collect()}
    assert sums == {1: 0, 3: 1}
    assert row_at(df.where("v is not null"), ["v"], 2)["v"] == 3 and row_at(df.limit(0), ["v"], 0) is None


def test_value_counts_without_and_with_groups(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", None)] * 2 + [("b", "y")], "g string, v string")
    assert [(r["value"], r["count"], r["pos"]) for r in value_counts(df, "v", 2).orderBy("pos").collect()] == [("x", 3, 1), ("__missing__", 2, 2)]
    got = {(r["g"], r["value"], r["share"], r["pos"]) for r in value_counts(df, "v", 1, ["g"]).collect()}
    assert got == {("a", "x", 0.6, 1), ("b", "y", 1.0, 1)}
