"""Incident view over the driver's star-schema tables.

No incident table ships with the test data, so every registered query binds the
operators to this derived view (``orders ⋈ customer ⋈ nation ⟕ lineitem``). Two
"sheets" are produced: the merged sheet with every order and a per-period sheet
that repeats every fifth order, which yields cross-sheet duplicate groups.

Plan shape: lineitem is pre-aggregated per order (partial aggregation on the map
side, one shuffle on ``l_orderkey``) before it meets orders, so the join never
sees line-level rows. Join strategies are left to the planner and AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CANONICAL_SOURCE_SHEET
from ..session import read_table

# Fixture binding: partkey residue -> equipment code text.
_CODE_BY_PARTKEY_MOD8 = {0: "23", 1: "58", 2: "27", 3: "33", 4: "АЦ-40", 5: "11", 6: "52"}


def _lpad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def equipment_per_order(lineitem: DataFrame) -> DataFrame:
    code = F.lit(None).cast("string")
    pm = F.col("l_partkey") % 8
    expr = F.when(F.col("l_suppkey") % 20 == 0, F.lit("999")).otherwise(F.lit("49"))
    for residue, text in sorted(_CODE_BY_PARTKEY_MOD8.items(), reverse=True):
        expr = F.when(pm == residue, F.lit(text)).otherwise(expr)
    code = expr
    return (lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
            .select("l_orderkey", code.alias("code"))
            .groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("n_units"),
                 F.array_join(F.array_sort(F.collect_list("code")), ", ").alias("equipment")))


def incident_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = equipment_per_order(read_table(spark, sf_dir, "lineitem"))

    ok = F.col("o_orderkey")
    ck = F.col("o_custkey")
    joined = (orders
              .join(li, ok == F.col("l_orderkey"), "left")
              .join(customer, ck == F.col("c_custkey"), "inner")
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner"))
    return joined.select(
        ok.alias("row_id"),
        F.when(ok % 13 == 0, None).otherwise(
            F.concat((F.col("c_nationkey") + 100).cast("string"), F.lit(" ("), F.col("n_name"), F.lit(")"))
        ).alias("region"),
        F.when(ok % 97 == 0, F.col("o_orderdate").cast("date"))
         .otherwise(F.add_months(F.col("o_orderdate").cast("date"), 60)).alias("fire_date"),
        F.col("o_orderpriority").alias("settlement_type"),
        F.concat((ck % 12 + 10).cast("string"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")")).alias("enterprise_type"),
        F.when(ok % 11 == 0, None).otherwise((ok % 30 + 1).cast("double")).alias("building_floors"),
        F.when(ok % 17 == 0, None).otherwise(((ok * 7) % 26 - 1).cast("double")).alias("fire_floor"),
        F.when(ok % 19 == 0, None).otherwise((ck % 140).cast("double") / 8).alias("distance_to_station"),
        F.when(ok % 5 == 0, (ck % 3).cast("double")).alias("fatalities"),
        F.when(ok % 4 == 0, (ck % 5).cast("double")).alias("injuries"),
        F.when(ok % 3 == 0, None).when(ok % 50 == 1, F.lit(0.0))
         .otherwise(F.col("o_totalprice")).alias("direct_damage"),
        F.concat(_lpad2(ok % 25), F.lit(":"), _lpad2(ck % 62)).alias("t_detect"),
        F.concat(_lpad2(ok % 24), F.lit(":"), _lpad2((ck + 5) % 60)).alias("t_report"),
        F.concat(_lpad2(ok % 24), F.lit(":"), _lpad2((ck + 17) % 60),
                 F.when(ok % 7 == 0, F.lit(":00")).otherwise(F.lit(""))).alias("t_arrival"),
        F.concat((ck % 4 + 1).cast("string"), F.lit(" ("), F.col("o_orderstatus"), F.lit(")")).alias("fire_protection"),
        F.when(ok % 29 == 0, None).otherwise((ck % 40).cast("string")).alias("source_item"),
        F.col("c_name").alias("object_name"),
        F.col("c_mktsegment").alias("address"),
        F.col("equipment"),
        F.when(ok % 23 == 0, None).otherwise(
            (F.col("n_units") + F.when(ok % 9 == 0, 1).otherwise(0)).cast("double")).alias("equipment_count"),
    )


def incident_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sheet raw incident table with ingest order ``(sheet_ord, row_id)``."""
    base = incident_base(spark, sf_dir)
    row, nozzles = F.col("row_id"), (F.col("row_id") % 4).cast("double")
    merged = F.struct(F.lit(CANONICAL_SOURCE_SHEET).alias("source_sheet"), F.lit(0).alias("sheet_ord"), nozzles.alias("nozzle_count"))
    period = F.struct(F.when(row % 2 == 0, F.lit("1...2000-2008")).otherwise(F.lit("2...2009-2020")).alias("source_sheet"),
                      F.lit(1).alias("sheet_ord"), (nozzles + F.when(row % 20 == 0, 1.0).otherwise(0.0)).alias("nozzle_count"))
    sheets = F.when(row % 5 == 0, F.array(merged, period)).otherwise(F.array(merged))
    # One join, then one or two sheet rows of each incident.
    rows = base.select("*", F.inline(sheets))
    return rows.select("source_sheet", "sheet_ord", *base.columns, "nozzle_count")
