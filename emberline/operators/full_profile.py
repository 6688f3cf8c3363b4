"""Full statistical profile of a table as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import written
from . import profiling as P
from .exploration import infer_categorical
from .features import numeric_columns

STATS = ["count", "missing", "mean", "std", "median", "q05", "q25", "q75", "q95", "iqr", "mad", "min", "max"]
OF, COLUMN = "of_rank", "of_column"


def _rows(df: DataFrame, section: str, metrics: dict[str, Column], rank: Column | None = None, column: Column | None = None, key: Column | None = None) -> DataFrame:
    """(section, rank, column, key, metric, value), one row per metric of each row of ``df``."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()]))
    return df.select(F.lit(section).alias("section"), (F.lit(None) if rank is None else rank).cast("double").alias("rank"), text(column).alias("column"),
                     text(key).alias("key"), cells.alias("m")).select("section", "rank", "column", "key", "m.metric", "m.value")


def _values(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row per row and column: ``by``, the column's name and its value as text."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias(COLUMN), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*by, cells.alias("s")).select(*by, f"s.{COLUMN}", "s.value")


def _rank_links(rows: DataFrame, columns: list[str], top: int) -> DataFrame:
    """Share of each rank within the ``top`` most frequent values of each column; rows without rank count for the choice alone."""
    counts = _values(rows, columns, [OF]).groupBy(COLUMN, F.coalesce("value", F.lit(P.MISSING)).alias("value"), OF).agg(F.count(F.lit(1)).alias("n"))
    ranked = F.count_if(F.col(OF).isNotNull())
    sums = counts.groupBy(COLUMN, "value").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col(OF).isNotNull(), F.col("n"))).alias("n_ranked"), ranked.alias("ranks"))
    place = F.row_number().over(Window.partitionBy(COLUMN).orderBy(F.desc("n_all"), "value"))
    tops = sums.select("*", place.alias("place")).where((F.col("place") <= top) & (F.col("ranks") > 0)).select(COLUMN, "value", "n_ranked")
    return counts.where(F.col(OF).isNotNull()).join(tops, [COLUMN, "value"]).withColumn("share", F.round(F.col("n") / F.col("n_ranked"), 4))


def statistical_profile(df: DataFrame, target: str = "rank_tz", sheet: str = S.CANONICAL_SOURCE_SHEET, most: int = 50, top: int = 30, top_links: int = 20) -> DataFrame:
    """(section, rank, column, key, metric, value) of all that a profile holds.

    Sections: table, numeric, categorical (``top`` values), missingness (%), rank,
    rank_numeric, rank_categorical, correlation (the first ``most`` eligible numeric
    columns, two at least; ``key`` is the other one) and rank_link (``top_links`` values of each
    categorical column). Without ``target`` the rank sections are absent. The table
    is read once and written; every section is grouped over all columns together.
    """
    rows = written(df.select("*", F.col(target).cast("double").alias(OF)) if target in df.columns else df, "profile")
    names = [c for c in rows.columns if c != OF]
    numeric = [c for c in numeric_columns(rows) if c != OF]
    other = [c for c in names if c not in numeric]
    stats = {m: F.col(m) if m in ("count", "missing", "min", "max") else F.round(m, 6) for m in STATS}
    canonical = F.count_if(F.col("source_sheet") == sheet) if "source_sheet" in names else F.lit(None).cast("long")
    parts = [_rows(rows.agg(F.count(F.lit(1)).alias("row_count"), canonical.alias("canonical_rows")), "table",
                   {"row_count": F.col("row_count"), "column_count": F.lit(len(names)), "canonical_rows": F.col("canonical_rows")})]
    gone = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    gone = gone.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in names])).alias("s"))
    parts.append(_rows(gone, "missingness", {"missing_pct": F.round(F.col("s.v") * 100, 4)}, column=F.col("s.c")))
    if numeric:
        parts.append(_rows(P.robust_summary(rows, numeric), "numeric", stats, column=F.col("column")))
        varied = _eligible(rows, numeric)[:most]
        if len(varied) > 1:
            parts.append(_rows(P.pearson_matrix(rows, varied), "correlation", {"r": F.col("r")}, column=F.col("a"), key=F.col("b")))
    if other:
        found = P.value_counts(_values(rows, other, []), "value", top, [COLUMN])
        parts.append(_rows(found, "categorical", {"count": F.col("count")}, column=F.col(COLUMN), key=F.col("value")))
    if target in names:
        ranked = rows.where(F.col(OF).isNotNull())
        total = Window.partitionBy()  # over one row per rank
        shares = ranked.groupBy(OF).agg(F.count(F.lit(1)).alias("count")).withColumn("share", F.round(F.col("count") / F.sum("count").over(total), 6))
        parts.append(_rows(shares, "rank", {"count": F.col("count"), "share": F.col("share")}, F.col(OF)))
        if numeric:
            parts.append(_rows(P.robust_summary(ranked, numeric, [OF]), "rank_numeric", stats, F.col(OF), F.col("column")))
        if other:
            found = P.value_counts(_values(ranked, other, [OF]), "value", top, [OF, COLUMN])
            parts.append(_rows(found, "rank_categorical", {"count": F.col("count")}, F.col(OF), F.col(COLUMN), F.col("value")))
        links = rows.select(*[c for c in names if c != target])
        linked = [r["column"] for r in infer_categorical(links).where("categorical").collect()] if links.columns else []
        if linked:
            parts.append(_rows(_rank_links(rows, linked, top_links), "rank_link", {"share": F.col("share")}, F.col(OF), F.col(COLUMN), F.col("value")))
    return reduce(DataFrame.unionByName, parts)


def _eligible(rows: DataFrame, numeric: list[str]) -> list[str]:
    """Columns of three values or more that are not all equal."""
    row = rows.agg(*[((F.count(c) >= 3) & (F.min(c) != F.max(c))).alias(c) for c in numeric]).first()
    return [c for c in numeric if row[c]]
