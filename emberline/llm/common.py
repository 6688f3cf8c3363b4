"""Shared helpers of the training-data operators: tables, cut lineage, temporary column names, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table

__all__ = ["components", "fresh", "has_unique_ids", "is_learnable", "ranked", "read_table", "shared_path", "small_batches", "written"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the session names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut and ids are fixed.

    A ``path`` is overwritten; ``df`` must not read it.
    """
    path = path or shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until it clashes with no column (names compare without case, as in Spark)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows per Arrow batch: documents of 100 KB then stay near 100 MB a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def is_learnable(doc_id: Column, folds: int, held_out: int) -> Column:
    """Not of the held-out fold: crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != held_out


def has_unique_ids(rows: DataFrame, id_col: str) -> bool:
    """Whether no id is null or repeated."""
    return not rows.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count()


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str) -> DataFrame:
    """``df`` with the 0-based ``rank`` of each row in its group by ``order``, however large a group is.

    A range sort on groups and order is written once; the position inside a file
    partition comes from ``monotonically_increasing_id`` and only one count per
    (partition, group) is summed up over the partitions. Rows equal in all these columns rank in any order.
    """
    at, part, first, n = (fresh(c, df.columns) for c in ("at_", "part_", "first_", "n_"))
    keys = [F.col(c) for c in (*groups, *order)]
    sort = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "sorted")
    sort = sort.withColumn(part, F.shiftright(at, 33))
    own = {c: fresh(f"{c}_start", [*df.columns, at, part, first, n]) for c in (part, *groups)}
    counts = sort.groupBy(*[F.col(c).alias(o) for c, o in own.items()]).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*[own[c] for c in groups]).orderBy(own[part]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(first, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).drop(n)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()])
    return sort.join(starts, same).select(*df.columns, (F.col(at) + F.col(first)).alias(rank))


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links ``(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps, so the number of rounds grows with
    the logarithm of the longest chain. Each step is a grouped minimum and a join
    with it; the minimum is written first, so that both join inputs are plain
    exchanges and AQE can split the links of a hub. Nothing is collected but two
    sums that tell whether a round changed anything. Nodes without links are absent.
    """
    spark = edges.sparkSession
    # Two places for the links, used in turn, and one for the minima: old ones are overwritten.
    one, two, minima = (shared_path(spark, x) for x in ("links", "links", "minima"))
    e = written(_oriented(edges), "links", one)
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "minima", minima)
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(_oriented(large), "links", two)
        low = written(e.groupBy("a").agg(F.min("b").alias("m")), "minima", minima)
        small = (e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        e = written(_oriented(small), "links", one)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
                    .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
        seen = now
    raise RuntimeError("components did not settle")
