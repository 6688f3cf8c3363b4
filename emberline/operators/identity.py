"""Event identity, canonical record choice and duplicate policy.

Design for skew: a duplicate group can be huge (one key may hold a third of all
rows), so no per-group sort or ``collect_set`` window is used. Instead one
``groupBy(duplicate_group_id)`` computes, with map-side partial aggregation,
the group size, the winning record (``min`` of an ordering struct) and whether
any conflict field has more than one distinct value (``min <> max``). The
one-row-per-group result is joined back on the group id; AQE's skew-join split
handles hot groups on the streamed side. Rows without a group id get a unique,
salted join key, so the null group never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import norm_free_text
from .cleaning import source_priority
from .resources import materialise


def _int_text(c: Column) -> Column:
    return F.coalesce(c.cast("double").cast("bigint").cast("string"), F.lit(""))


def _key_parts(df: DataFrame) -> list[Column]:
    def get(name):
        return F.col(name) if name in df.columns else F.lit(None)
    return [
        _int_text(get("row_id")),
        F.coalesce(F.date_format(get("fire_date").cast("date"), "yyyy-MM-dd"), F.lit("")),
        _int_text(get("year")),
        _int_text(get("region_code")),
        _int_text(get("settlement_type_code")),
        _int_text(get("enterprise_type_code")),
        _int_text(get("building_floors")),
        _int_text(get("fire_floor")),
        norm_free_text(get("object_name")),
        norm_free_text(get("address")),
    ]


def _non_blank(fp: Column) -> Column:
    return F.btrim(fp, F.lit("|")) != ""


def _stable_id(prefix: str, fp: Column) -> Column:
    return F.when(_non_blank(fp), F.concat(F.lit(prefix), F.substring(F.sha2(fp, 256), 1, 24)))


def identity_keys(df: DataFrame) -> DataFrame:
    """Map-only part: fingerprints, ids, low-confidence flag, priority, completeness.

    Key parts and fingerprints are emitted through a Generate each: merged into one
    projection, every use of a fingerprint would evaluate all its key parts anew.
    """
    parts = [F.element_at("_parts", i + 1) for i in range(len(S.IDENTITY_KEY_PARTS))]
    keyed = materialise(df.select("*", F.array(*_key_parts(df)).alias("_parts")), ["_parts"])
    low = F.size(F.filter("_parts", lambda p: p != "")) < S.LOW_CONFIDENCE_MIN_PARTS
    fallback = F.concat_ws("|", *parts[1:])
    fingerprint = F.when(low, fallback).otherwise(F.concat_ws("|", *parts))
    keyed = materialise(keyed.select("*", low.alias("event_id_low_confidence"), fallback.alias("_fallback"), fingerprint.alias("event_fingerprint")),
                        ["event_id_low_confidence", "_fallback", "event_fingerprint"])
    completeness = sum((F.col(c).isNotNull().cast("int") for c in S.COMPLETENESS_COLUMNS if c in df.columns), F.lit(0))
    src = F.col("source_sheet") if "source_sheet" in df.columns else F.lit(None).cast("string")
    return keyed.select(
        *df.columns, "event_fingerprint",
        _stable_id("evt_", F.col("event_fingerprint")).alias("event_id"),
        _stable_id("dup_", F.col("_fallback")).alias("duplicate_group_id"),
        "event_id_low_confidence",
        source_priority(src).alias("source_priority"),
        completeness.alias("_completeness"),
    )


def event_identity(df: DataFrame, order_cols: list[str] = ("sheet_ord", "row_id")) -> DataFrame:
    """Add identity and duplicate metadata; ``order_cols`` is the ingest order (tie-break)."""
    order_cols = list(order_cols)
    keyed = identity_keys(df)
    created = [F.col("created_at")] if "created_at" in df.columns else []
    rank_key = F.struct(
        (-F.col("_completeness")).alias("c"), (-F.col("source_priority")).alias("p"),
        *[c.alias(f"t{i}") for i, c in enumerate(created)],
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)])
    conflicts = [c for c in S.CONFLICT_FIELDS if c in df.columns]
    conflict = F.lit(False)
    for c in conflicts:
        conflict = conflict | F.coalesce(F.min(c) != F.max(c), F.lit(False))
    groups = (keyed.where(F.col("duplicate_group_id").isNotNull())
              .groupBy(F.col("duplicate_group_id").alias("_gid"))
              .agg(F.count(F.lit(1)).alias("_group_size"), F.min(rank_key).alias("_best"),
                   conflict.alias("_conflict")))
    # unique salt for rows without a group: they match nothing and spread evenly
    salt = F.concat(F.lit("\u0000"), F.to_json(F.struct(*[F.col(c) for c in order_cols])))
    joined = keyed.join(groups, F.coalesce(F.col("duplicate_group_id"), salt) == F.col("_gid"), "left")
    own = F.struct(*[F.col(c) for c in order_cols])
    best_order = F.struct(*[F.col("_best")[f"o{i}"] for i in range(len(order_cols))])
    canonical = F.coalesce(own == best_order, F.lit(False))
    policy = (F.when(F.col("_conflict"), F.lit("conflict_kept"))
              .when(F.col("_group_size") > 1, F.lit("canonical_event_only"))
              .otherwise(F.lit("unique")))
    keep = [c for c in keyed.columns if c != "_completeness"]
    return joined.select(*keep, canonical.alias("is_canonical_event_record"), policy.alias("duplicate_policy"))


def add_label_metadata(df: DataFrame) -> DataFrame:
    """Columns appended after identity by the import path."""
    has_rank = F.col("rank_tz").isNotNull() if "rank_tz" in df.columns else F.lit(False)
    return df.select(
        "*",
        F.when(has_rank, F.lit(S.LABEL_SOURCE_HISTORICAL_VECTOR)).alias("rank_label_source"),
        F.lit(False).alias("human_verified"),
        F.coalesce(F.col("is_canonical_event_record"), F.lit(False)).alias("usable_for_training"),
        F.lit(None).cast("string").alias("rank_normative_version"),
        F.lit(None).cast("string").alias("rank_quality_flags"),
        F.lit(None).cast("double").alias("predicted_rank_at_decision"),
    )


def full_row_duplicates(df: DataFrame, columns: list[str] | None = None,
                        order_cols: list[str] = ("sheet_ord", "row_id")) -> DataFrame:
    """``is_exact_duplicate``: same values in ``columns`` as an earlier row (first kept).

    The row content is reduced to a sha-256 of its JSON encoding (field names and
    escaped values, nulls omitted: an injective text) so the group key is one column.
    """
    columns = list(columns or [c for c in S.EN_COLS if c in df.columns])
    order_cols = list(order_cols)
    key = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)
    keyed = df.select("*", key.alias("_rowkey"))
    first = keyed.groupBy(F.col("_rowkey").alias("_k")).agg(F.min(F.struct(*[F.col(c) for c in order_cols])).alias("_first"))
    own = F.struct(*[F.col(c) for c in order_cols])
    return (keyed.join(first, F.col("_rowkey") == F.col("_k"), "left")
            .select(*df.columns, (own != F.col("_first")).alias("is_exact_duplicate")))


def skip_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Canonical incoming rows whose event id and fingerprint are both unknown."""
    known_ids = existing.select(F.col("event_id").alias("_eid")).where(F.col("_eid").isNotNull())
    known_fps = existing.select(F.col("event_fingerprint").alias("_efp")).where(F.col("_efp").isNotNull())
    fresh = incoming.where(F.col("is_canonical_event_record"))
    fresh = fresh.join(known_ids, F.col("event_id") == F.col("_eid"), "left_anti")
    return fresh.join(known_fps, F.col("event_fingerprint") == F.col("_efp"), "left_anti")
