"""Stripping, first digits and times of day against plain Python."""

from pyspark.sql import functions as F

from emberline.functions.text import first_int, norm_free_text, strip, time_invalid, time_minutes
from emberline.operators.identity import _non_blank

REGEX = r"(?U)^\s+|\s+$"


def test_strip_trims_what_the_regex_trims(spark):
    texts = [f"{chr(c)}a{chr(c)} b{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts += ["", " ", "\t\n", "  x \n", "x\r\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert df.where(~strip("v").eqNullSafe(F.regexp_replace("v", REGEX, ""))).count() == 0
    collapsed = F.coalesce(F.regexp_replace(F.lower(F.regexp_replace("v", REGEX, "")), r"(?U)\s+", " "), F.lit(""))
    assert df.where(~norm_free_text("v").eqNullSafe(collapsed)).count() == 0
    plan = df.select(strip("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_digits_and_times(spark):
    rows = [(None, None, None, False), ("", None, None, True), ("x", None, None, True), ("7", 7.0, 420, False), ("24", 24.0, None, True), (" 10:20:00 ", 10.0, 1200, False),
            ("23:59", 23.0, 1439, False), ("24:00", 24.0, None, True), ("12:61\n", 12.0, None, True), ("123", 123.0, None, True), ("a1b2", 1.0, 62, False)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, v string")
    got = df.select("i", first_int("v"), time_minutes("v"), time_invalid("v")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]


def test_fingerprints_of_bars_alone_are_blank(spark):
    df = spark.createDataFrame([("|||",), ("",), ("|a|",), ("||\n",), ("| |",)], "v string")
    assert [r[0] for r in df.select(_non_blank(F.col("v"))).collect()] == [False, False, True, True, True]
