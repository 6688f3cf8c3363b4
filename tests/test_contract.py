"""Stage contract checks on hand-made rows."""

from pyspark.sql import functions as F

from emberline import schema as S
from emberline.operators import contract as CT


def test_forbidden_features_only_at_dispatch(spark):
    df = spark.createDataFrame([(["year", "t_arrival_min", "fatalities", "region_code"],)], "f array<string>")
    row = df.select(CT.forbidden_features(F.col("f"), S.STAGE_DISPATCH).alias("d"),
                    CT.forbidden_features(F.col("f"), S.STAGE_ARRIVAL).alias("a"),
                    CT.production_safe(F.col("f"), S.STAGE_DISPATCH).alias("safe")).first()
    assert row["d"] == ["fatalities", "t_arrival_min"]
    assert row["a"] == []
    assert row["safe"] is False


def test_missing_for_stage(spark):
    df = spark.createDataFrame([(None, None), (5.0, None), (5.0, 9.0)], "t_arrival_min double, t_first_hose_min double")
    got = df.select(CT.missing_for_stage(S.STAGE_ARRIVAL).alias("a"),
                    CT.missing_for_stage(S.STAGE_FIRST_HOSE).alias("h")).collect()
    assert [r["a"] for r in got] == [["t_arrival_min"], [], []]
    assert [r["h"] for r in got] == [["t_arrival_min", "t_first_hose_min"], ["t_first_hose_min"], []]


def test_rejection_rules_count_on_survivors(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    kept, log = CT.apply_rejection_rules(df, [("a", F.col("a")), ("b", F.col("b"))])
    assert kept.count() == 1
    assert [tuple(r) for r in log.orderBy("step").collect()] == [(1, "a", 2, 2), (2, "b", 1, 1)]
