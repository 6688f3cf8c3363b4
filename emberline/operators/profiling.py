"""Profiles and distribution statistics.

Shapes used throughout:
* every multi-column statistic is computed in ONE aggregate (``agg`` over all
  columns) or by stacking columns into a long (column, value) table first;
* exact quantiles come from :mod:`emberline.operators.quantiles`, average and dense
  ranks from prefix sums over distinct values (:mod:`emberline.operators.prefix`);
  no group, column or global window goes to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .prefix import prefix_sums
from .quantiles import percentiles

MISSING = "__missing__"


def missing_report(df: DataFrame, columns: list[str] | None = None, top_n: int = 20) -> DataFrame:
    """A2: missing % per column (round 1), highest first, ties by column name."""
    cols = columns or df.columns
    row = df.select(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    stacked = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share"))
                                              for c in cols])).alias("s"))
    return (stacked.select(F.col("s.column").alias("column"), F.round(F.col("s.share") * 100, 1).alias("missing_pct"))
            .orderBy(F.desc("missing_pct"), "column").limit(top_n))


def _long(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*by, F.explode(arr).alias("s")).select("s.column", *by, "s.value")


def describe(df: DataFrame, columns: list[str], spark=None) -> DataFrame:
    """A3: count, mean, std (sample), min, exact quartiles, max per column."""
    long = _long(df, columns, [])
    base = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))
    q = percentiles(df, columns, {0.25: "q25", 0.5: "q50", 0.75: "q75"}).drop("n")
    return base.join(q, "column", "left")


def robust_summary(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, missing, mean, std(pop), median, q05/25/75/95, IQR, MAD, min, max.

    MAD needs the median first: a second percentile pass runs over ``|x - median|``.
    Both joins are on (column, group) with one row per key on the summary's side.
    """
    by = list(by or [])
    keys = ["column", *by]
    # Read by three passes: written, so that what it comes from is worked out once.
    df = written(df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns if c not in by]), "summary")
    long = _long(df, columns, by)
    base = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = written(percentiles(df, columns, {0.5: "median", 0.05: "q05", 0.25: "q25", 0.75: "q75", 0.95: "q95"}, by).drop("n"), "quantiles")
    dev = _matched(long, q.select(*keys, "median"), keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("dev"))
    mad = percentiles(dev.withColumnRenamed("column", "of_"), "dev", {0.5: "mad"}, ["of_", *by]).drop("column", "n").withColumnRenamed("of_", "column")
    out = _matched(_matched(base, q, keys, "left"), mad, keys, "left")
    return out.select("column", *by, "count", "missing", "mean", "std", "median", "q05", "q25", "q75", "q95",
                      (F.col("q75") - F.col("q25")).alias("iqr"), "mad", "min", "max")


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null group meets the null group; the keys of ``left`` stay."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_right"))
    renamed = right.withColumnsRenamed({k: f"{k}_right" for k in keys})
    return left.join(renamed, same, how).drop(*[f"{k}_right" for k in keys])


def robust_scale(summary: DataFrame, fallback: float = 1.0) -> DataFrame:
    """IQR/1.349, then 1.4826*MAD, then std, first positive; else ``fallback``."""
    iqr = F.when(F.col("q75") != F.col("q25"), (F.col("q75") - F.col("q25")) / 1.349).otherwise(F.lit(0.0))
    mad = F.col("mad") * 1.4826
    std = F.col("std")
    scale = (F.when(iqr > 0, iqr).when(mad > 0, mad).when(std > 0, std).otherwise(F.lit(fallback)))
    keys = [c for c in summary.columns if c not in ("count", "missing", "mean", "std", "median", "q05", "q25",
                                                      "q75", "q95", "iqr", "mad", "min", "max")]
    return summary.select(*keys, scale.alias("scale"))


def value_counts(df: DataFrame, column: str, top_n: int = 30, by: list[str] | None = None) -> DataFrame:
    """A5: counts with ``__missing__`` for nulls, share of the group, top-N by count then value."""
    by = list(by or [])
    v = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    g = df.groupBy(*by, v.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = g.groupBy(*by).agg(F.sum("count").alias("total_"))
    if by:
        # Spark keeps only the first rows of each group before the shuffle of this window.
        pos = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "value"))
        top = _matched(g.withColumn("pos", pos).where(F.col("pos") <= top_n), total, by)
    else:
        # A top-N of a sort; the window numbers at most N rows.
        first = g.orderBy(F.desc("count"), "value").limit(top_n).crossJoin(total)
        top = first.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("count"), "value")))
    return top.select(*by, "value", "count", F.round(F.col("count") / F.col("total_"), 6).alias("share"), "pos")


def max_row(df: DataFrame, column: str, keep: list[str], order: list[str]) -> DataFrame:
    """The row holding the column maximum; ties -> first in ``order`` (one aggregate)."""
    best = df.where(F.col(column).isNotNull()).agg(
        F.min_by(F.struct(*[F.col(c) for c in keep]),
                 F.struct((-F.col(column)).alias("neg"), *[F.col(c) for c in order])).alias("r"),
        F.max(column).alias("max_value"))
    return best.select(F.lit(column).alias("column"), "max_value", "r.*")


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count and rate of each flag plus the share of rows with any flag."""
    anyf = F.lit(False)
    for f in flags:
        anyf = anyf | F.coalesce(F.col(f), F.lit(False))
    row = df.agg(*[F.count_if(f).alias(f"n_{f}") for f in flags],
                 *[F.avg(F.col(f).cast("double")).alias(f"r_{f}") for f in flags],
                 F.avg(anyf.cast("double")).alias("any_share"), F.count(F.lit(1)).alias("n"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"n_{f}").alias("count"),
                                                   F.round(F.col(f"r_{f}"), 6).alias("rate"))
                                          for f in flags])).alias("s"), "any_share") \
        .select("s.*", F.round("any_share", 6).alias("any_flag_share"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r of every pair of eligible columns (null -> 0, round 4) in one aggregate.

    A column is eligible with three values or more that are not all equal. Only
    pairs a < b are computed; r is symmetric and 1 on the diagonal.
    """
    num = [F.col(c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = df.agg(*[F.corr(num[i], num[j]).alias(f"r_{i}_{j}") for i, j in pairs],
                 *[((F.count(x) >= 3) & (F.min(x) != F.max(x))).alias(f"ok_{i}") for i, x in enumerate(num)])

    def cell(i: int, j: int):
        r = F.lit(1.0) if i == j else F.round(F.coalesce(F.col(f"r_{min(i, j)}_{max(i, j)}"), F.lit(0.0)), 4)
        return F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), r.alias("r"),
                        (F.col(f"ok_{i}") & F.col(f"ok_{j}")).alias("ok"))

    cells = F.array(*[cell(i, j) for i in range(len(columns)) for j in range(len(columns))])
    return row.select(F.explode(cells).alias("s")).where("s.ok").select("s.a", "s.b", "s.r")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, avg_rank): 1-based average rank of each distinct non-null value (ties averaged)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    placed = prefix_sums(counts, [], ["value"], "cnt", "below")
    return placed.select("value", (F.col("below") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))


def dense_ranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, dense_rank): distinct non-null values numbered from 1 in rising order."""
    by = list(by or [])
    distinct = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("value")).distinct()
    return prefix_sums(distinct, by, ["value"], None, "below").select(*by, "value", (F.col("below") + 1).alias("dense_rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman rho over pairwise-complete rows (average ranks, then Pearson)."""
    both = written(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b")), "pairs")
    ra = average_ranks(both, "_a").withColumnRenamed("value", "_a").withColumnRenamed("avg_rank", "ra")
    rb = average_ranks(both, "_b").withColumnRenamed("value", "_b").withColumnRenamed("avg_rank", "rb")
    ranked = both.join(ra, "_a").join(rb, "_b")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def crosstab_share(df: DataFrame, column: str, target: str, top: int = 20) -> DataFrame:
    """A10: row-normalised crosstab of the top-``top`` values of ``column`` against ``target``."""
    v = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    tops = (df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(top))
    sub = df.where(F.col(target).isNotNull()).select(v.alias("value"), F.col(target).alias("target"))
    cells = sub.join(F.broadcast(tops.select("value")), "value").groupBy("value", "target").agg(
        F.count(F.lit(1)).alias("n"))
    tot = cells.groupBy("value").agg(F.sum("n").alias("row_total"))
    return cells.join(tot, "value").select("value", "target", F.round(F.col("n") / F.col("row_total"), 4).alias("share"))


def histogram(df: DataFrame, column: str, nbins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is right-closed."""
    st = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    x = F.col(column).cast("double")
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (hi - lo) / nbins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(nbins - 1))
    g = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lower"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("upper"), "count")


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Per-group count, exact quartiles, IQR whiskers (1.5 IQR clipped to data)."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    q = percentiles(df.where(F.col(by).isNotNull()), [column], names, [by]).drop("column", "n")
    base = df.where(F.col(by).isNotNull() & F.col(column).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"))
    j = base.join(q, by)
    iqr = F.col("q3") - F.col("q1")
    return j.select(by, "count", "q1", "median", "q3", F.greatest(F.col("min"), F.col("q1") - 1.5 * iqr).alias("whisker_low"),
                    F.least(F.col("max"), F.col("q3") + 1.5 * iqr).alias("whisker_high"))


def integer_like(df: DataFrame, columns: list[str], eps: float = 1e-8) -> DataFrame:
    """All non-null values within ``eps`` of an integer (one aggregate)."""
    row = df.agg(*[F.coalesce(F.bool_and(F.abs(F.col(c) - F.round(F.col(c))) <= eps), F.lit(False)).alias(c)
                   for c in columns],
                 *[F.count(c).alias(f"n_{c}") for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                   (F.col(c) & (F.col(f"n_{c}") > 0)).alias("integer_like"))
                                          for c in columns])).alias("s")).select("s.*")
