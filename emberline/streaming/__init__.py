"""Structured Streaming operators.

Every stream reads table files as they land and is written with ``foreachBatch``:
each micro-batch goes to ``<sink>/_batch_id=<n>`` in overwrite mode, so a batch that
is replayed after a failure rewrites its own output and the sink stays exactly-once.
Offsets live under the query's ``checkpointLocation`` inside the cluster's shared
``spark.checkpoint.dir``.

Import (X2) and latest stages (X3) keep what they know of each key in Spark's RocksDB
state store, so a batch reads its own rows and the states it touches, never earlier
batches. Window counts (X4) carry only the windows that are still open from batch to
batch; a window is emitted once, and what comes after that goes to a table of
corrections. Files may arrive in any order of time; no watermark drops a late row.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table_path

BATCH_ID = "_batch_id"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Streaming read of one table: all Parquet files of its folder, or its single file.

    The schema comes from the files already present; an empty or missing table raises.
    """
    path = table_path(sf_dir, name)
    table = spark.read.parquet(path)
    files = table.inputFiles()
    if not files:
        raise ValueError(f"no files to stream in {path}")
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 64)
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def stream_folder(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Streaming read of a folder of Parquet files written by an upstream job."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _drain(stream: DataFrame, name: str, base: str, mode: str, write_batch) -> list[dict]:
    """Run until nothing is left, in ``base``'s checkpoint; the progress of the batches. State is kept in RocksDB."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = (stream.writeStream.queryName(f"{name}_{uuid.uuid4().hex[:6]}").outputMode(mode)
                 .option("checkpointLocation", os.path.join(base, "checkpoint")).trigger(availableNow=True).foreachBatch(write_batch).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return [p.jsonValue if hasattr(p, "jsonValue") else p for p in query.recentProgress]


def run_available_now(stream: DataFrame, name: str, batch_result=None, base: str | None = None, mode: str = "append", before_write=None) -> DataFrame:
    """Drain the stream into a per-batch Parquet sink; return the sink as a batch DataFrame.

    ``batch_result(batch, earlier)`` turns a micro-batch into the rows to store;
    ``earlier`` holds the rows of all batches before it. It must not change the columns.
    A run that was killed goes on where it stopped when it is started again with the
    same ``base``. ``before_write(batch_id)`` is called ahead of each write.
    """
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    sink = os.path.join(base, "out")
    # A first, empty part: the sink can be read before and without any batch.
    schema = (batch_result(spark.createDataFrame([], stream.schema), None) if batch_result else stream).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(os.path.join(sink, f"{BATCH_ID}=-1"))
    full = schema.add(BATCH_ID, "long")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch
        if batch_result:
            earlier = session.read.schema(full).parquet(sink).where(F.col(BATCH_ID) < batch_id).drop(BATCH_ID)
            rows = batch_result(batch, earlier)
        if before_write:
            before_write(batch_id)
        rows.write.mode("overwrite").parquet(os.path.join(sink, f"{BATCH_ID}={batch_id}"))

    _drain(stream, name, base, mode, write_batch)
    return spark.read.schema(full).parquet(sink)


# ---------------------------------------------------------------------------
# Idempotent import
# ---------------------------------------------------------------------------

def dedup_import(batch: DataFrame, earlier: DataFrame | None, key: str) -> DataFrame:
    """Rows of a micro-batch whose ``key`` is new, one of each; nothing else is ever left out, however late it comes.

    Rows without a key cannot be told apart and are all imported.
    """
    keyless = batch.where(F.col(key).isNull())
    fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    if earlier is not None:
        fresh = fresh.join(earlier.select(F.col(key).alias("known_")), F.col(key) == F.col("known_"), "left_anti")
    return fresh.unionByName(keyless)


def import_once(stream: DataFrame, key: str, name: str = "import", base: str | None = None, before_write=None) -> DataFrame:
    """Each ``key`` of a stream once, however often and late it is delivered; known keys are kept in the state store.

    Rows without a key cannot be told apart and are all imported.
    """
    fresh = stream.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(stream.where(F.col(key).isNull()))
    return run_available_now(fresh, name, base=base, before_write=before_write)


# ---------------------------------------------------------------------------
# Latest stage per incident
# ---------------------------------------------------------------------------

def latest_stage(rows: DataFrame, key: str, time_col: str, stage_col: str, id_col: str) -> DataFrame:
    """Per ``key``: the newest stage of these rows (ties on time broken by the larger id) and their number."""
    latest = F.max(F.struct(F.col(time_col).alias("stage_time"), F.col(id_col).alias("stage_id"), F.col(stage_col).alias("stage")))
    return (rows.groupBy(key).agg(latest.alias("_l"), F.count(F.lit(1)).alias("n_updates"))
            .select(key, "_l.stage", "_l.stage_time", "_l.stage_id", "n_updates"))


def latest_stages(stream: DataFrame, key: str, time_col: str, stage_col: str, id_col: str, name: str = "latest", base: str | None = None,
                  before_write=None) -> DataFrame:
    """Per-batch rows of the keys that a batch touched, each with its newest stage and number of updates so far."""
    return run_available_now(latest_stage(stream, key, time_col, stage_col, id_col), name, base=base, mode="update", before_write=before_write)


def last_states(parts: DataFrame, key: str) -> DataFrame:
    """The last row that :func:`latest_stages` wrote for each key."""
    cols = [c for c in parts.columns if c not in (key, BATCH_ID)]
    return parts.groupBy(key).agg(F.max_by(F.struct(*cols), BATCH_ID).alias("s_")).select(key, *[F.col(f"s_.{c}").alias(c) for c in cols])


def fold_latest(parts: DataFrame, key: str) -> DataFrame:
    """One row per key from the per-batch rows of :func:`latest_stage`, in whatever order batches came."""
    latest = F.max(F.struct("stage_time", "stage_id", "stage"))
    return (parts.groupBy(key).agg(latest.alias("_l"), F.sum("n_updates").alias("n_updates"))
            .select(key, "_l.stage", "_l.stage_time", "_l.stage_id", "n_updates"))


# ---------------------------------------------------------------------------
# Tumbling-window counts
# ---------------------------------------------------------------------------

def tumbling_counts(rows: DataFrame, time_col: str, by: list[str], width: str = "1 day") -> DataFrame:
    """Counts of these rows per ``width`` window and ``by``; per-batch counts add up, so no row is ever too late."""
    ntz = dict(rows.dtypes)[time_col] == "timestamp_ntz"

    def bound(c):
        return c.cast("timestamp_ntz") if ntz else c

    return (rows.groupBy(F.window(F.col(time_col).cast("timestamp"), width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(bound(F.col("w.start")).alias("window_start"), bound(F.col("w.end")).alias("window_end"), *by, "n"))


def fold_counts(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))


def closing_counts(stream: DataFrame, time_col: str, by: list[str], width: str = "1 day", delay: str = "2 days", name: str = "windows",
                   base: str | None = None, before_write=None) -> dict[str, DataFrame]:
    """Counts per window and ``by`` of a stream, in three tables of per-batch rows: ``closed``, ``corrections`` and ``open``.

    A window closes when a time later than its end by ``delay`` has been seen, and is written to
    ``closed`` in that batch and never again; rows that come for a closed window are counted in
    ``corrections``. A batch reads the windows that the batch before it left open, whose
    number ``delay`` bounds, and writes the next ones. The time seen so far is the largest of
    all batches before, as it is with a watermark.
    """
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    keys = ["window_start", "window_end", *by]
    counted = tumbling_counts(spark.createDataFrame([], stream.schema), time_col, by, width)
    seen = spark.createDataFrame([], stream.schema).select(F.max(time_col).alias("seen"))
    schemas = {"closed": counted.schema, "corrections": counted.schema, "open": counted.schema, "seen": seen.schema}
    for table, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(os.path.join(base, table, f"{BATCH_ID}=-1"))

    def of(session: SparkSession, table: str, batch_id: int) -> DataFrame:
        return session.read.schema(schemas[table]).parquet(os.path.join(base, table, f"{BATCH_ID}={batch_id}"))

    def put(rows: DataFrame, table: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(base, table, f"{BATCH_ID}={batch_id}"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = of(session, "seen", batch_id - 1)
        put(batch.select(F.col(time_col).alias("seen")).unionByName(before).agg(F.max("seen").alias("seen")), "seen", batch_id)
        limits = [r["l"] for t in (batch_id - 1, batch_id) for r in of(session, "seen", t).select((F.col("seen") - F.expr(f"interval {delay}")).alias("l")).collect() or [{"l": None}]]
        was, now = (F.col("window_end") <= F.lit(x) if x is not None else F.lit(False) for x in limits)
        counts = tumbling_counts(batch, time_col, by, width).persist()
        try:
            put(counts.where(was), "corrections", batch_id)
            alive = fold_counts(counts.where(~was).unionByName(of(session, "open", batch_id - 1)), keys)
            if before_write:
                before_write(batch_id)
            put(alive.where(now), "closed", batch_id)
            put(alive.where(~now), "open", batch_id)
        finally:
            counts.unpersist()

    progress = _drain(stream, name, base, "append", write_batch)
    tables = {t: spark.read.schema(schemas[t].add(BATCH_ID, "long")).parquet(os.path.join(base, t)) for t in ("closed", "corrections", "open")}
    return tables | {"progress": progress}


def all_counts(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Counts of all rows so far: closed windows, corrections to them, and the windows that the last batch left open."""
    last = tables["open"].agg(F.max(BATCH_ID)).first()[0]
    still = tables["open"].where(F.col(BATCH_ID) == last) if last is not None else tables["open"]
    parts = [t.drop(BATCH_ID) for t in (tables["closed"], tables["corrections"], still)]
    return fold_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]), keys)
