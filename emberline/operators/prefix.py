"""Prefix sums over an ordered table, however large a group is.

A window over one group puts the group into one task. Here the rows are range-sorted
on (groups, order) and written once to the shared folder, which fixes the range
bounds; running sums inside a file partition and one total per (partition, group)
then give every row its prefix. Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _free(name: str, taken: list[str]) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], weight: str | None, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` (rows, if None) over the rows of the group that come before.

    ``order`` should tell the rows of a group apart; rows equal in it come in any fixed order.
    """
    part, at, own, first = (_free(c, df.columns) for c in ("part_", "at_", "own_", "first_"))
    keys = [F.col(c) for c in (*groups, *order)]
    w = F.col(weight) if weight else F.lit(1)
    sort = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "sorted")
    sort = sort.withColumn(part, F.shiftright(at, 33))
    before = [part, *groups]
    running = sort.withColumn(own, F.coalesce(F.sum(w).over(Window.partitionBy(*before).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = {c: _free(f"{c}_start", [*df.columns, part, at, own, first]) for c in before}
    totals = sort.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.sum(w).alias(first))
    over = Window.partitionBy(*[names[c] for c in groups]).orderBy(names[part]).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn(first, F.coalesce(F.sum(first).over(over), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return running.join(starts, same).select(*df.columns, (F.col(own) + F.col(first)).alias(out))


def row_at(df: DataFrame, order: list[str], rank: int):
    """The row at the 0-based ``rank`` in ``order``, or None."""
    return prefix_sums(df, [], order, None, "rank_").where(F.col("rank_") == rank).drop("rank_").first()
