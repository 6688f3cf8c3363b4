"""Leakage-safe train/test splits (M1) and their passport (M2).

Randomness is a hash of (key, seed) built from ``md5`` so that the same split
comes out of every engine and every re-run; ``rand()`` is never used. Group
splits rank *distinct groups*, never rows, and exact counts come from prefix sums
over the order keys (no global window).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .prefix import row_at

GROUP_SHUFFLE = "group_shuffle"
GROUP_KFOLD = "group_kfold"
TEMPORAL_HOLDOUT = "temporal_holdout"
SOURCE_HOLDOUT = "source_holdout"
ROW_RANDOM = "row_random_legacy"
PRODUCTION_SAFE = {GROUP_SHUFFLE, GROUP_KFOLD, TEMPORAL_HOLDOUT}
MISSING_GROUP = "__missing__"


def hash_uniform(key: Column, seed: int) -> Column:
    """Deterministic uniform in [0, 1) from the first 52 bits of md5(key|seed)."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def split(df: DataFrame, protocol: str, test_size: float = 0.25, seed: int = 42, group_col: str = "event_id",
          date_col: str = "fire_date", source_col: str = "source_sheet", order_cols=("sheet_ord", "row_id"),
          label_col: str | None = None, n_folds: int = 5) -> DataFrame:
    """Add ``is_test`` (boolean) according to ``protocol``."""
    order_cols = list(order_cols)
    if protocol in (GROUP_SHUFFLE, GROUP_KFOLD):
        g = F.coalesce(F.col(group_col).cast("string"), F.lit(MISSING_GROUP))
        keyed = df.withColumn("_g", g).withColumn("_u", hash_uniform(F.col("_g"), seed))
        if protocol == GROUP_KFOLD:
            n_groups = keyed.select("_g").distinct().count()
            folds = max(2, min(n_folds, int(n_groups)))
            return keyed.withColumn("is_test", F.floor(F.col("_u") * folds) == 0).drop("_g", "_u")
        groups = written(keyed.select("_g", "_u").distinct(), "groups")
        n_test = int(math.ceil(test_size * groups.count()))
        if n_test <= 0:
            return keyed.withColumn("is_test", F.lit(False)).drop("_g", "_u")
        cut = row_at(groups, ["_u", "_g"], n_test - 1)
        at_most = F.struct("_u", "_g") <= F.struct(F.lit(cut["_u"]).alias("_u"), F.lit(cut["_g"]).alias("_g"))
        return keyed.withColumn("is_test", at_most).drop("_g", "_u")
    if protocol == TEMPORAL_HOLDOUT:
        return _temporal(df, test_size, date_col, order_cols)
    if protocol == SOURCE_HOLDOUT:
        held = df.where(F.col(source_col).isNotNull()).agg(F.max(source_col)).first()[0]
        return df.withColumn("is_test", F.coalesce(F.col(source_col) == F.lit(held), F.lit(False)))
    if protocol == ROW_RANDOM:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in order_cols])
        strat = F.coalesce(F.col(label_col).cast("string"), F.lit("")) if label_col else F.lit("")
        return df.withColumn("is_test", hash_uniform(F.concat(strat, F.lit("#"), key), seed) < test_size)
    raise ValueError(f"unknown split protocol {protocol}")


def _temporal(df: DataFrame, test_size: float, date_col: str, order_cols: list[str]) -> DataFrame:
    """First ``max(1, int(n*(1-test_size)))`` rows in (date, ingest order) train; undated rows last.

    The last training row is found by prefix sums over the order keys alone; its
    key, compared as a struct, splits the rows.
    """
    last = F.struct(F.col(date_col).isNull().alias("undated"), F.col(date_col).alias("date"), *[F.col(c) for c in order_cols])
    keys = written(df.select(last.alias("k")), "order")
    n = keys.count()
    cut = row_at(keys, ["k"], max(1, int(n * (1 - test_size))) - 1) if n else None
    if cut is None:
        return df.withColumn("is_test", F.lit(False))
    fields = keys.schema["k"].dataType.fields
    limit = F.struct(*[F.lit(cut["k"][f.name]).cast(f.dataType).alias(f.name) for f in fields])
    return df.withColumn("is_test", last > limit)


def passport(df: DataFrame, protocol: str, group_col: str = "event_id", date_col: str = "fire_date") -> DataFrame:
    """M2: event overlap rate, event counts, date ranges, production_safe."""
    g = F.col(group_col)
    per_side = df.where(g.isNotNull() & (g != "")).select(g.alias("_g"), "is_test").distinct()
    overlap = per_side.groupBy("_g").agg(F.countDistinct("is_test").alias("sides"),
                                         F.max(F.col("is_test").cast("int")).alias("in_test"))
    ov = overlap.agg(F.count_if(F.col("sides") == 2).alias("both"), F.count_if(F.col("in_test") == 1).alias("n_test"),
                     F.count_if((F.col("sides") == 2) | (F.col("in_test") == 0)).alias("n_train"))
    dates = df.agg(F.min(F.when(~F.col("is_test"), F.col(date_col))).alias("train_date_min"),
                   F.max(F.when(~F.col("is_test"), F.col(date_col))).alias("train_date_max"),
                   F.min(F.when(F.col("is_test"), F.col(date_col))).alias("test_date_min"),
                   F.max(F.when(F.col("is_test"), F.col(date_col))).alias("test_date_max"),
                   F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))
    return ov.crossJoin(dates).select(
        F.lit(protocol).alias("split_protocol"),
        F.when(F.col("n_test") > 0, F.round(F.col("both") / F.col("n_test"), 6)).otherwise(F.lit(0.0))
        .alias("event_overlap_rate"),
        F.col("n_train").alias("train_event_count"), F.col("n_test").alias("test_event_count"),
        "train_date_min", "train_date_max", "test_date_min", "test_date_max", "train_rows", "test_rows",
        F.lit(protocol in PRODUCTION_SAFE).alias("production_safe"))
