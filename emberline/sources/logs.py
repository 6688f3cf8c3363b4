"""Operations log as JSON lines (S12): append, read back with a count of bad lines, export.

A log is a folder of JSON-lines files; every append adds files, so writers never wait
for each other, and a line that a writer left half-written is counted, not lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import CSV_OPTIONS, csv_ready

SCHEMA = "op_id long, time timestamp_ntz, level string, source string, message string, user string"
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "encoding": "UTF-8"}
_BAD = "_bad_line"


def append_log(entries: DataFrame, path: str) -> str:
    """Append entries ``SCHEMA``, one line each; columns the log does not know are left out, missing ones are null."""
    known = T.StructType.fromDDL(SCHEMA)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in entries.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known.fields]
    entries.select(*cols).write.mode("append").options(**JSON_OPTIONS).json(path)
    return path


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, one row with the number of entries and of lines that are none). A bad line is no valid JSON object or holds a value of another type."""
    raw = (spark.read.options(**JSON_OPTIONS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD)
           .schema(f"{SCHEMA}, {_BAD} string").json(path))
    # All columns are asked for, so that a value of the wrong type anywhere marks its line.
    every = F.to_json(F.struct(*[F.col(c) for c in raw.columns if c != _BAD])).isNotNull()
    marked = raw.withColumn("bad_", F.col(_BAD).isNotNull() & every)
    return marked.where(~F.col("bad_")).drop("bad_", _BAD), marked.agg(F.count_if(~F.col("bad_")).alias("entries"), F.count_if("bad_").alias("bad_lines"))


def export_log(entries: DataFrame, path: str, fmt: str = "json") -> str:
    """Write entries as JSON lines or as CSV with a header; another format raises."""
    if fmt == "json":
        entries.write.mode("overwrite").options(**JSON_OPTIONS).json(path)
    elif fmt == "csv":
        csv_ready(entries).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    else:
        raise ValueError(f"unknown export format {fmt}")
    return path
