"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Every document of a source expects the same number of copies, the source's target
over its size. Documents are ordered by size inside their source, expected copies
are prefix-summed, one random offset per source is added, and a document is emitted
once for each integer boundary that its stretch of the prefix sum crosses. The
order by size spreads the extra copies over all sizes, so that the words taken stay
within about one document of the target.

Scale. Only (row, source, size) is sorted, by range, so a source that holds a third
of all rows spans many tasks (``common.ranked``). Targets come from one row per source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, has_unique_ids, ranked, read_table, written

WEIGHTS = (3, 1, 2)
SEED = 10
#: Largest number of copies of a document, and so of a source's words over its size.
MOST = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """A fixed number of [0, 1) for each source, from 20 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(source, F.lit("")), F.when(source.isNull(), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 5), 16, 10).cast("double") / float(1 << 20)


def targets(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source_size, target, offset.

    Targets share 150 % of all sizes by weight, none above twice its source's size:
    with sources by rising capacity per weight, those whose fair share of what is
    left exceeds their capacity are filled, the rest share by weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((place - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = total.select("source", "source_size", weight.cast("long").alias("w"), place.alias("place"))
    every = Window.partitionBy()
    before = Window.orderBy(MOST * F.col("source_size") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.select(
        "*", F.sum("source_size").over(every).alias("all_sizes"), F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    # All doubled, to stay in whole numbers: the budget is 3 x all sizes, a capacity 4 x a source's.
    full = (4.0 * F.col("source_size") * (F.col("all_w") - F.col("w_before"))
            < F.col("w") * (3.0 * F.col("all_sizes") - 4.0 * F.col("size_before")))
    marked = filled.withColumn("full", full)
    rest = marked.select("*", F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every).alias("full_sizes"),
                         F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every).alias("open_w"))
    share = F.col("w") * (3 * F.col("all_sizes") - 4 * F.col("full_sizes")) / (2.0 * F.col("open_w"))
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(share.cast("double"))
    return rest.select("source", "source_size", target.alias("target"), _offset(F.col("source"), seed).alias("offset"))


def copies(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows(..., doc_id, source, size)`` with source_size, target and the number of ``copies`` to emit."""
    placed = ranked(rows, ["source"], ["size", "doc_id"], "rank")
    goal = targets(placed.select("source", "size"), seed).withColumnRenamed("source", "goal_source")
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    crossed = F.floor(F.col("offset") + rate * (F.col("rank") + 1)) - F.floor(F.col("offset") + rate * F.col("rank"))
    return joined.withColumn("copies", F.least(crossed, F.lit(MOST).cast("long"))).drop("offset", "rank")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs``, each row as often as the mix emits it, with the same columns.

    Null texts have no words; null sources are one source, the last; sources without
    words take nothing; repeated rows are mixed like any other; extra columns pass.
    """
    out = fresh("copies_", docs.columns)
    sized = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")]
    rows, uid, lean = docs, "doc_id", written(docs.select(*sized), "sizes")
    if not has_unique_ids(lean, "doc_id"):
        uid = fresh("uid_", [*docs.columns, out])
        rows = written(docs.select("*", F.monotonically_increasing_id().alias(uid)), "numbered")
        lean = written(rows.select(*sized, F.col(uid).alias("uid")), "sizes")
    taken = copies(lean, seed).where(F.col("copies") > 0)
    taken = taken.select(F.col("doc_id" if uid == "doc_id" else "uid").alias("taken_"), F.col("copies").cast("int").alias(out))
    return (rows.join(taken, F.col(uid) == F.col("taken_")).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(out))))
            .select(*docs.columns))


def op10_systematic_mix(spark, sf_dir: str) -> DataFrame:
    """Words taken of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    found = copies(written(docs, "sizes"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
v AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS w FROM s),
b AS (SELECT *, sum(source_size) OVER () AS all_sizes, sum(w) OVER () AS all_w,
        coalesce(sum(source_size) OVER up, 0) AS size_before, coalesce(sum(w) OVER up, 0) AS w_before
      FROM v WINDOW up AS (ORDER BY 2 * source_size / CAST(w AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 4 * source_size * (all_w - w_before) < w * (3 * all_sizes - 4 * size_before) AS filled FROM b),
r AS (SELECT *, sum(CASE WHEN filled THEN source_size ELSE 0 END) OVER () AS full_sizes, sum(CASE WHEN filled THEN 0 ELSE w END) OVER () AS open_w FROM f),
t AS (SELECT source, source_size,
        CASE WHEN filled THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w * (3 * all_sizes - 4 * full_sizes) AS DOUBLE) / (2.0 * open_w)::DOUBLE END AS target,
        CAST(('0x' || substr(md5('{SEED}:' || coalesce(source, '') || CASE WHEN source IS NULL THEN ':null' ELSE '' END), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u
      FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS i FROM d),
c AS (SELECT p.doc_id, p.size, t.source_size, t.target, t.u, p.i, coalesce(t.target / nullif(t.source_size, 0), 0.0::DOUBLE) AS rate
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(u + rate * (i + 1)) - floor(u + rate * i), 2) AS BIGINT) * size AS taken
FROM c
"""
