"""Exact, linearly interpolated percentiles of large columns, as DataFrame plans.

Values are counted per (column, group, value) with map-side partial aggregation, so
ties cost one row; prefix sums of the counts (:mod:`.prefix`) say which order
statistics each value holds, and one grouped aggregate picks those that the wanted
percentiles need. No group or column goes to one task, nothing but the result is
ever on the driver, and there is no bound on groups or values.

Interpolation is ``v[floor(h)] + (v[ceil(h)] - v[floor(h)]) * (h - floor(h))`` with
``h = (n - 1) * p`` (pandas/NumPy "linear", SQL ``quantile_cont``). NaN counts as
missing; infinite values take part like any other and are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums


def long_values(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(column, group..., value) rows of the non-missing values of ``columns``."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    rows = df.select(*by, stacked.alias("s_")).select("s_.column", *by, "s_.value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _picked(p: float, n: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The value if it holds the order statistic just below (just above) percentile ``p``."""
    h = (n - 1) * F.lit(float(p))
    return (F.max(F.when((low <= F.floor(h)) & (F.floor(h) < high), F.col("value"))),
            F.max(F.when((low <= F.ceil(h)) & (F.ceil(h) < high), F.col("value"))))


def percentiles(df: DataFrame, columns: list[str] | str, names: dict[float, str], by: list[str] | None = None) -> DataFrame:
    """One row per (column, group): ``n`` and, for each percentile in ``names``, its value under that name."""
    columns, by = [columns] if isinstance(columns, str) else list(columns), list(by or [])
    keys = ["column", *by]
    counted = long_values(df, columns, by).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("k_"))
    placed = prefix_sums(counted, keys, ["value"], "k_", "low_")
    sizes = placed.groupBy(*[F.col(c).alias(f"{c}_of") for c in keys]).agg(F.sum("k_").alias("n"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    rows = placed.join(sizes, same)
    picks = []
    for p, name in names.items():
        low, high = _picked(p, F.col("n"), F.col("low_"), F.col("low_") + F.col("k_"))
        picks += [low.alias(f"{name}_lo"), high.alias(f"{name}_hi")]
    found = rows.groupBy(*keys).agg(F.max("n").alias("n"), *picks)

    def between(p: float, name: str) -> Column:
        h = (F.col("n") - 1) * F.lit(float(p))
        a, b = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(a == b, a).otherwise(a + (b - a) * (h - F.floor(h))).alias(name)

    return found.select(*keys, "n", *[between(p, name) for p, name in names.items()])


def percentile_values(df: DataFrame, columns: list[str] | str, probs: list[float]) -> dict[tuple[str, float], float]:
    """``{(column, p): value}``; columns without values are absent. As many numbers as the arguments name."""
    names = {p: f"p{i}_" for i, p in enumerate(probs)}
    return {(r["column"], p): r[name] for r in percentiles(df, columns, names).collect() for p, name in names.items()}
