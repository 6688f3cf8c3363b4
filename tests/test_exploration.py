"""Literal expectations for operators whose oracle shares definitions with the Spark side."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.operators import evaluation as E
from emberline.operators import exploration as X
from emberline.operators import features as FE
from emberline.operators import preprocessing as PP


def test_monotone_times(spark):
    df = spark.createDataFrame([(10.0, 5.0, None, 12.4), (None, -3.0, 2.0, None)], "t_detect_min double, t_report_min double, t_arrival_min double, t_first_hose_min double")
    got = [tuple(r) for r in X.monotone_times(df).collect()]
    assert got == [(10.0, 10.0, None, 12.0), (None, 0.0, 2.0, None)]


def test_generated_features_order_and_zero_division(spark):
    f = X.generated_features(["a", "b"], most=50)
    assert list(f)[:12] == ["a", "b", "absolute(a)", "absolute(b)", "negate(a)", "negate(b)", "multiply(a,b)", "divide(a,b)", "divide(b,a)",
                            "modulo(a,b)", "modulo(b,a)", "absolute(absolute(a))"]
    assert len(f) == 50
    row = spark.createDataFrame([(-7.0, 0.0), (7.0, -4.0)], "a double, b double").select(f["divide(a,b)"].alias("d"), f["modulo(a,b)"].alias("m")).collect()
    assert [tuple(r) for r in row] == [(None, None), (-1.75, -1.0)]


def test_search_decisions(spark):
    df = spark.createDataFrame([(17, 5, dt.datetime(2024, 1, 2, 3, 4), 2.0, "Привет Мир"), (27, None, dt.datetime(2023, 1, 2), None, None)],
                               "decision_id long, fire_id long, decided_at timestamp, decision_rank double, comment string")
    ids = lambda **k: [r[0] for r in X.search_decisions(df, **k).orderBy("decision_id").collect()]
    assert ids() == [17, 27] and ids(id_part="2") == [27] and ids(time_part="02.01.2024 03") == [17] and ids(rank=2.0) == [17]
    assert ids(comment_part=" мир ") == [17] and ids(fire_part="5") == [17] and ids(id_part="7", rank=3.0) == []


@pytest.mark.parametrize(("total", "want"), [
    (None, {1: 10, 2: 10, 3: 10}), (0, {1: 10, 2: 10, 3: 10}), (12, {1: 10, 2: 4, 3: 1}), (1000, {1: 10, 2: 10, 3: 10}),
    (20, {1: 10, 2: 6, 3: 4}), (18, {1: 10, 2: 5, 3: 3})])
def test_oversampling_plan(spark, total, want):
    df = spark.createDataFrame([(1,)] * 10 + [(2,)] * 4 + [(3,)] + [(None,)], "c int")
    assert {r["cls"]: r["target"] for r in E.oversampling_plan(df, "c", total).collect()} == want


def test_oversampling_plan_of_nothing(spark):
    assert E.oversampling_plan(spark.createDataFrame([], "c int"), "c", 5).count() == 0


def test_rank_alignment_of_a_perfect_and_a_single_cluster(spark):
    df = spark.createDataFrame([(0, 3.0)] * 5 + [(1, 1.0)] * 5, "c int, r double")
    r = E.rank_alignment(df, "c", "r").first()
    assert (r["spearman"], r["purity"]) == (1.0, 1.0) and abs(r["nmi"] - 1) < 1e-12
    assert E.rank_alignment(df.withColumn("c", F.lit(0)), "c", "r").first()["spearman"] is None


def test_preprocessor_learns_from_training_rows_alone(spark):
    schema = "region_code double, building_floors double, t_detect_min double"
    train = spark.createDataFrame([(1.0, 2.0, 10.0), (2.0, 4.0, 10.0), (None, None, 30.0)], schema)
    test = spark.createDataFrame([(9.0, None, None), (2.0, 100.0, 5.0)], schema)
    m = PP.fit(train, ["region_code", "building_floors", "t_detect_min", "distance_to_station"])
    assert m.outputs == ["region_code__missing", "region_code__1.0", "region_code__2.0", "region_code____missing__", "region_code__unknown",
                         "building_floors__missing", "building_floors", "t_detect_min__missing", "t_detect_min", "distance_to_station__missing", "distance_to_station"]
    got = [tuple(r) for r in m.transform(test).collect()]
    assert got == [(0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 3.0, 1.0, 10.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 100.0, 0.0, 5.0, 1.0, 0.0)]
    again = PP.fit(train.unionByName(test.limit(0)), ["building_floors"])
    assert again.features[0].fill == m.features[1].fill


def test_frequency_encoding(spark):
    train = spark.createDataFrame([(float(i % 12),) for i in range(24)] + [(0.0,)] * 6, "region_code double")
    m = PP.fit(train, ["region_code"], "constant")
    got = m.transform(spark.createDataFrame([(0.0,), (5.0,), (77.0,), (None,)], "region_code double")).collect()
    assert [round(r["region_code"], 6) for r in got] == [round(8 / 30, 6), round(2 / 30, 6), 0.0, 0.0]
    with pytest.raises(ValueError):
        PP.fit(train, ["region_code"], "mean")


def test_experiment_feature_sets(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0, True)], "row_id int, building_floors double, fatalities double, rank_ref double, my_equipment double, flag_x boolean")
    sets = FE.experiment_feature_sets(df)
    assert list(sets) == ["features_10_dispatch", "features_13_arrival", "features_15_first_hose", "features_19_retrospective_time",
                          "features_35_enhanced_retrospective", "features_50_wide_no_target", "features_all_known_numeric"]
    assert sets["features_all_known_numeric"] == ["building_floors"]
    assert [len(sets[n]) for n in list(sets)[:5]] == [10, 13, 15, 19, 35]


def test_interactive_slice_of_nothing(spark):
    df = spark.createDataFrame([], "year int, region_code double, v double, flag_a boolean")
    got = [tuple(r) for r in X.interactive_slice(df, "v", (2000, 2001), 1.0).collect()]
    assert got == [("rows", "", 0.0), ("missing_pct", "v", None), ("flag_rate", "flag_a", None)]
