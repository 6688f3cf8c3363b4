"""The full profile: plain re-computation on a few rows, tables without target, numbers or rows."""

import statistics

from emberline.operators.full_profile import statistical_profile

ROWS = [(1.0, "a", 1.0), (2.0, "a", 1.0), (4.0, None, 2.0), (None, "b", 2.0), (9.0, "b", None)]


def _found(df, **args):
    return {(r["section"], r["rank"], r["column"], r["key"], r["metric"]): r["value"] for r in statistical_profile(df, **args).collect()}


def test_profile_of_few_rows(spark):
    got = _found(spark.createDataFrame(ROWS, "x double, kind string, rank_tz double"))
    v = [1.0, 2.0, 4.0, 9.0]
    med = statistics.median(v)
    assert got["numeric", None, "x", None, "median"] == med and got["numeric", None, "x", None, "missing"] == 1
    assert got["numeric", None, "x", None, "mad"] == statistics.median(abs(x - med) for x in v)
    assert got["numeric", None, "x", None, "std"] == round(statistics.pstdev(v), 6)
    assert got["rank_numeric", 1.0, "x", None, "mean"] == 1.5 and got["missingness", None, "kind", None, "missing_pct"] == 20.0
    assert got["categorical", None, "kind", "__missing__", "count"] == 1 and got["rank_categorical", 2.0, "kind", "b", "count"] == 1
    assert got["rank", 2.0, None, None, "share"] == 0.5 and got["table", None, None, None, "canonical_rows"] is None
    assert got["rank_link", 2.0, "kind", "b", "share"] == 1.0 and got["correlation", None, "x", "x", "r"] == 1.0
    # Most frequent values alone: kind a, then b.
    assert {k[3] for k in _found(spark.createDataFrame(ROWS, "x double, kind string, rank_tz double"), top_links=1) if k[0] == "rank_link"} == {"a"}


def test_profile_without_target_numbers_or_rows(spark):
    df = spark.createDataFrame(ROWS, "x double, kind string, rank_tz double")
    assert {k[0] for k in _found(df.select("kind"))} == {"table", "missingness", "categorical"}
    assert {k[0] for k in _found(df.select("x"))} == {"table", "missingness", "numeric"}
    assert {k[0] for k in _found(df.select("rank_tz"))} == {"table", "missingness", "numeric", "rank", "rank_numeric"}
    got = _found(df.limit(0))
    assert got["table", None, None, None, "row_count"] == 0 and got["missingness", None, "x", None, "missing_pct"] is None
