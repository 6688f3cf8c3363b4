"""Registered queries: file sources and sinks.

Each query writes through the sink under a fresh folder in the shared
checkpoint folder and returns what the matching source reads back, so the
oracle compares the round trip with the table it started from.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import evaluation as E
from ..operators import learning as L
from ..session import read_table
from ..sources import files as IO
from ..streaming import scratch
from . import catalog_ml as CM
from . import incidents as V
from . import sqlblocks as B
from .registry import register

CUTOFF = "2024-01-15 00:00:00"
EVENT_KNOWN = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                            T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                            T.StructField("value", T.DoubleType())])


def _export_with_bad_rows(spark, sf, path: str) -> str:
    """Events as CSV; the value of every tenth event is not a number."""
    ev = read_table(spark, sf, "events")
    value = F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return IO.write_table(ev.withColumn("value", value), path, "csv")


@register("s5_csv_load", ids=("S5",), sql="SELECT event_id, ts, user_id, event_type, value, "
                                           "CAST(NULL AS VARCHAR) AS channel FROM events WHERE event_id % 10 <> 0")
def s5_csv_load(spark, sf):
    """CSV export of events loaded against known columns (props not known -> dropped; channel absent -> null; bad rows out)."""
    path = _export_with_bad_rows(spark, sf, os.path.join(scratch(spark, "s5"), "events_csv"))
    known = T.StructType([*EVENT_KNOWN.fields, T.StructField("channel", T.StringType())])
    rows, _ = IO.load_csv(spark, path, known)
    return rows


@register("s5_csv_load_stats", ids=("S5",), sql="SELECT count(*) AS rows_read, count_if(event_id % 10 = 0) AS rows_skipped, "
                                                 "count_if(event_id % 10 <> 0) AS rows_loaded, count_if(event_id % 10 <> 0) AS rows_with_key "
                                                 "FROM events")
def s5_csv_load_stats(spark, sf):
    """Rows read / skipped (unparseable under the known types) / loaded."""
    path = _export_with_bad_rows(spark, sf, os.path.join(scratch(spark, "s5s"), "events_csv"))
    return IO.load_csv(spark, path, EVENT_KNOWN)[1]


@register("s6_table_sinks", ids=("S6",), sql=lambda: B.with_(*V.sql_raw()) + "SELECT * FROM incidents")
def s6_table_sinks(spark, sf):
    """Harmonised incidents written as Parquet (code columns as text) and CSV; the CSV read back with the Parquet schema."""
    base = scratch(spark, "s6")
    raw = V.raw(spark, sf)
    pq = IO.write_table(raw, os.path.join(base, "parquet"), "parquet", string_columns=S.CODE_COLS)
    schema = spark.read.parquet(pq).schema
    csv = IO.write_table(spark.read.parquet(pq), os.path.join(base, "csv"), "csv")
    return spark.read.options(**IO.CSV_OPTIONS).schema(schema).csv(csv)


@register("s8_append_history", ids=("S8",), sql="SELECT event_id, ts, user_id, event_type, value FROM events")
def s8_append_history(spark, sf):
    """Two import batches appended to the historical table; columns it does not know are dropped."""
    path = os.path.join(scratch(spark, "s8"), "history")
    ev = read_table(spark, sf, "events")
    early = F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")
    IO.append_known_columns(ev.where(early), path, EVENT_KNOWN)
    IO.append_known_columns(ev.where(~early).withColumn("channel", F.lit("import")), path, EVENT_KNOWN)
    return spark.read.schema(EVENT_KNOWN).parquet(path)


@register("s10_prediction_sink", ids=("S10", "M15"))
def s10_prediction_sink(spark, sf):
    """Top-3 predictions written as CSV with run metadata; read back."""
    pred = CM.m15_batch_scoring(spark, sf)
    path = IO.write_predictions(pred, scratch(spark, "s10"), {"model": "random_forest", "feature_set": "managed",
                                                              "top_k": 3, "source": sf})
    rows, meta = IO.read_predictions(spark, path, pred.schema)
    return rows.withColumn("model", F.lit(meta["model"]))


@register("s13_model_store", ids=("S13", "M3"))
def s13_model_store(spark, sf):
    """Decision tree saved with metadata, loaded back, and evaluated on the test split."""
    fitted, test = CM.fitted(spark, sf, "decision_tree", {"max_depth": 10, "min_samples_leaf": 10})
    path = IO.save_model(fitted.model, scratch(spark, "s13"), {"model_type": "decision_tree", "feature_set": "managed",
                                                         "features": CM.FEATS, "fills": fitted.fills})
    loaded, meta = IO.load_model(spark, path)
    return E.metric_passport(L.predict(loaded, L.apply_fills(test, meta["fills"]), CM.K)) \
        .withColumn("model_type", F.lit(meta["model_type"]))
