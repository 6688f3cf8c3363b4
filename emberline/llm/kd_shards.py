"""Sharding by a k-d tree over document metadata.

A node that stands for n shards is split along the dimension whose range, against
the whole table's, is widest in it, at the weighted quantile that gives the left
floor(n/2) shards their share of the node's bytes; ties inside a dimension are
split by id, then by row. Leaves stand for one shard each, of about the target bytes.

Scale. Metadata is written once, without texts. The splits of a level are found
together: histograms of bytes over at most ``BINS`` ranges per node narrow each cut
until it falls on one row, so no rows are shuffled or sorted. Cuts and searches are
small tables of one row per node, at most as many as shards, that go to the rows by
broadcast; histograms are summed up in Spark and the driver sees one row per node a
pass. Slots come from one range sort (``common.ranked``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, read_table, written

SHARDS = 24
BINS = 1024
LEVELS = 5
LEAST = -(1 << 62)


def document_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def metadata(docs: DataFrame) -> dict[str, Column]:
    """The numeric dimensions of ``docs`` columns that are there: size, characters, source and language (as hash codes)."""
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("long")
    dims = {"size": document_size(F.col("text"))}
    if "n_chars" in docs.columns:
        dims["n_chars"] = F.coalesce(F.col("n_chars").cast("long"), F.lit(-1))
    return dims | {c: code(c) for c in ("source", "lang") if c in docs.columns}


@dataclass
class Node:
    first: int                      # first shard, which names the node
    shards: int
    dim: int = 0                    # place of the dimension among the keys
    cut: tuple[int, ...] = ()       # the last (dimension, id, row) of the left side


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of one row per node, at most as many as there are shards, to be sent to every task."""
    types = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return F.broadcast(spark.createDataFrame(pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, types, strict=True)], [n for n, _ in types])))


def _apply_cuts(rows: DataFrame, nodes: list[Node], keys: Column) -> DataFrame:
    """``rows`` with ``t_node`` moved to the side of its node's cut that it falls on."""
    cuts = _table(rows.sparkSession, [(n.first, n.shards // 2, n.dim + 1, *n.cut) for n in nodes], "c_node long, c_half long, c_dim long, c0 long, c1 long, c2 long")
    at = F.element_at(keys, F.col("c_dim").cast("int"))
    left = (at < F.col("c0")) | ((at == F.col("c0")) & ((F.col("t_id") < F.col("c1")) | ((F.col("t_id") == F.col("c1")) & (F.col("t_uid") <= F.col("c2")))))
    moved = F.col("t_node") + F.when(F.col("c_node").isNull() | left, 0).otherwise(F.col("c_half"))
    return rows.join(cuts, F.col("t_node") == F.col("c_node"), "left").select(*[c for c in rows.columns if c != "t_node"], moved.alias("t_node"))


def _find_cuts(rows: DataFrame, nodes: list[Node], dims: list[str], spread: dict[str, int]) -> None:
    """Set dimension and cut of every node, from ``rows`` with their ``t_node``."""
    spark, names = rows.sparkSession, [*dims, "t_id", "t_uid"]
    ends = [f(c).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]
    split = _table(spark, [(n.first,) for n in nodes], "s_node long")
    stats = {r["t_node"]: r for r in rows.join(split, F.col("t_node") == F.col("s_node"), "left_semi")
             .groupBy("t_node").agg(F.sum("t_size").alias("bytes"), *ends).collect()}
    search = []
    for node in nodes:
        r = stats.get(node.first)
        if r is None:  # no rows
            node.cut = (LEAST, LEAST, LEAST)
            continue
        node.dim = max(range(len(dims)), key=lambda d: (r[f"hi_{dims[d]}"] - r[f"lo_{dims[d]}"]) / max(1, spread[dims[d]]))
        search.append({"node": node, "fixed": (), "below": 0, "goal": r["bytes"] * (node.shards // 2) / node.shards,
                       "range": (r[f"lo_{dims[node.dim]}"], r[f"hi_{dims[node.dim]}"])})
    keys = F.array(*names)
    while search:
        # The rows in question of each node, by ranges of the key that is being narrowed.
        now = []
        for s in search:
            dim, n, (low, high) = s["node"].dim + 1, len(s["fixed"]), s["range"]
            now.append((s["node"].first, (dim, len(dims) + 1, len(dims) + 2)[n], dim, low, high, max(1, math.ceil((high - low + 1) / BINS)),
                        *(*s["fixed"], None, None)[:2], s["below"], s["goal"]))
        asked = _table(spark, now, "s_node long, s_key long, s_dim long, s_low long, s_high long, s_width long, s_f0 long, s_f1 long, s_below long, s_goal double")
        pick = lambda c: F.element_at(keys, F.col(c).cast("int"))
        inside = (F.col("t_key").between(F.col("s_low"), F.col("s_high")) & (F.col("s_f0").isNull() | (pick("s_dim") == F.col("s_f0")))
                  & (F.col("s_f1").isNull() | (F.col("t_id") == F.col("s_f1"))))
        bins = (rows.join(asked, F.col("t_node") == F.col("s_node")).withColumn("t_key", pick("s_key")).where(inside)
                .groupBy("t_node", F.floor((F.col("t_key") - F.col("s_low")) / F.col("s_width")).alias("t_bin"))
                .agg(F.sum("t_size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("t_key").alias("low"), F.max("t_key").alias("high"),
                     F.min("t_id").alias("id0"), F.max("t_id").alias("id1"), F.min("t_uid").alias("uid0"), F.max("t_uid").alias("uid1"),
                     F.max("s_below").alias("s_below"), F.max("s_goal").alias("s_goal")))
        # The first range that reaches the goal, else the last; a node has at most BINS ranges.
        order = Window.partitionBy("t_node").orderBy("t_bin")
        below = F.col("s_below") + F.sum("bytes").over(order) - F.col("bytes")
        reached = bins.select("*", below.alias("below"), F.lead("t_bin").over(order).isNull().alias("last"))
        reached = reached.where((F.col("below") + F.col("bytes") >= F.col("s_goal")) | F.col("last"))
        one = F.min(F.struct("t_bin", "below", "bytes", "n", "low", "high", "id0", "id1", "uid0", "uid1")).alias("r")
        found = {x["t_node"]: x["r"] for x in reached.groupBy("t_node").agg(one).collect()}
        ahead = []
        for s in search:
            r = found[s["node"].first]
            s["below"] = r["below"]
            if r["n"] == 1:  # the row at the cut goes to the nearer side
                row = (*s["fixed"], r["low"], *(r["id0"], r["uid0"])[len(s["fixed"]):])
                s["node"].cut = row if 2 * r["below"] + r["bytes"] < 2 * s["goal"] else (*row[:-1], row[-1] - 1)
                continue
            if r["low"] < r["high"]:
                s["range"] = (r["low"], r["high"])
            else:
                s["fixed"] += (r["low"],)
                s["range"] = (r["id0"], r["id1"]) if len(s["fixed"]) == 1 else (r["uid0"], r["uid1"])
            ahead.append(s)
        search = ahead


def kd_leaves(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``rows`` (dimensions, t_size, t_id, t_uid) with ``t_node``, the shard; one level of splits at a time."""
    ends = rows.agg(*[F.coalesce(F.max(c) - F.min(c), F.lit(0)).alias(c) for c in dims]).first().asDict()
    keys, placed, level, depth = F.array(*dims, "t_id", "t_uid"), rows.withColumn("t_node", F.lit(0).cast("long")), [Node(0, shards)], 0
    while level := [n for n in level if n.shards > 1]:
        _find_cuts(placed, level, dims, ends)
        placed = _apply_cuts(placed, level, keys)
        level = [side for n in level for side in (Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2))]
        depth += 1
        if depth % LEVELS == 0:  # no longer chains of joins than this
            placed = written(placed, "levels")
    return placed


def order_key(doc_id: Column) -> Column:
    """A whole number that ids are ordered by: the id itself, of other ids a hash; the least one for null."""
    number = doc_id.cast("string").try_cast("long")
    return F.when(doc_id.isNull(), LEAST).otherwise(F.coalesce(number, F.shiftright(F.xxhash64(doc_id.cast("string")), 2)))


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot (gapless from 0 inside a shard, by doc_id).

    Give ``shards`` or the ``target_bytes`` of a leaf. Null texts count 8 bytes and
    CRC 0; a null id sorts first; ids that are no whole numbers are ordered by a hash; repeated rows and ties are told apart by a row
    number; an empty table gives an empty result; other columns are not read.
    """
    dims = metadata(docs)
    lean = written(docs.select("doc_id", document_size(F.col("text")).alias("t_size"),
                               F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                               order_key(F.col("doc_id")).alias("t_id"),
                               F.monotonically_increasing_id().alias("t_uid"), *[e.alias(f"d_{c}") for c, e in dims.items()]), "metadata")
    if target_bytes:
        shards = max(1, math.ceil((lean.agg(F.sum("t_size")).first()[0] or 0) / target_bytes))
    dealt = kd_leaves(lean, [f"d_{c}" for c in dims], shards)
    dealt = dealt.select("doc_id", F.col("t_size").alias("size"), "text_crc32", "t_id", "t_uid", F.col("t_node").cast("int").alias("shard"))
    return ranked(dealt, ["shard"], ["t_id", "t_uid"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def contract(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_kd_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return contract(kd_shards(read_table(spark, sf_dir, "documents")))
