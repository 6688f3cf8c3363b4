"""Unit tests of the resource parsing and rank expressions on hand-made rows."""

from pyspark.sql import functions as F

from emberline.functions import resources as R


def _one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("o")).first()["o"]


def test_tokens_strip_and_drop_empties(spark):
    assert _one(spark, R.tokens, "  23, 58 ;; АЦ-40 ") == ["23", "58", "АЦ-40"]
    assert _one(spark, R.tokens, "nan") == []
    assert _one(spark, R.tokens, None) == []


def test_token_categories_code_then_abbreviation(spark):
    assert _one(spark, R.token_categories, "23, 58, АЦ-40, 999") == ["AL", "APS", "AC", None]


def test_equipment_map_counts_in_first_seen_order(spark):
    m = _one(spark, R.equipment_map, "49, 23, 49")
    assert m == {"AC": 2, "AL": 1}


def test_nearest_rank_exact_prototypes(spark):
    cats = R.normative_categories()
    assert cats == ["AC", "AG", "AL", "APS", "AR"]

    def rank(vec):
        row = spark.createDataFrame([([float(x) for x in vec],)], "v array<double>").select(
            R.nearest_rank(F.col("v")).alias("n")).first()["n"]
        return None if row is None else (row["rank"], round(row["distance"], 9))

    assert rank([1.0, 0, 0, 0, 0]) == (1.0, 0.0)
    assert rank([2.0, 0, 1.0, 0, 0]) == (2.0, 0.0)
    assert rank([5.0, 1.0, 2.0, 2.0, 1.0]) == (5.0, 0.0)
    assert rank([0.0, 0, 0, 0, 0]) is None


def test_rank_by_count(spark):
    df = spark.createDataFrame([(n,) for n in [None, 0, 1, 2, 3, 4, 5, 7]], "n int")
    got = [(r["r"]["rank"], r["r"]["distance"]) for r in df.select(R.rank_by_count("n").alias("r")).collect()]
    assert got[:2] == [(None, None), (None, None)]
    assert got[2:7] == [(1.0, 0.0), (1.5, 0.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0)]
    assert got[7][0] == 5.0 and abs(got[7][1] - 0.2) < 1e-12


def test_rank_from_resources_nearest_minimum_lower_on_ties(spark):
    df = spark.createDataFrame([(n,) for n in [None, 1, 4, 6, 20]], "n int")
    got = [r[0] for r in df.select(R.rank_from_resources("n")).collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 5.0]


def test_rank_description_and_label(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (7.0,)], "r double")
    got = df.select(R.rank_description("r").alias("d"), R.rank_label("r").alias("l")).collect()
    assert [x["d"] for x in got] == ["Ранг 1-бис (2 единицы техники)", "Ранг 2", "Ранг 7.0"]
    assert [x["l"] for x in got] == ["1-бис", "2", None]
