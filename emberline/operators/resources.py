"""Resource parsing, rank labelling and rank reports (table level).

Parsing and ranking are map-only expression trees (see
:mod:`emberline.functions.resources`); reports are single small aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import resources as R
from ..functions.text import strip


DIAGNOSTIC_COLUMNS = ["resource_count_declared", "equipment_vector", "resource_vector", "resource_parse_confidence",
                      "resource_parse_flags", "resource_vector_sum", "resource_count_parsed", "resource_count_conflict",
                      "equipment_vector_norm", "_vtotal"]


def parse_diagnostics(df: DataFrame, text_col: str = "equipment", declared_col: str = "equipment_count") -> DataFrame:
    """Category map, dense + normalised vectors and parse quality columns.

    Three stacked projections (tokens -> categories -> derived columns) so every
    intermediate array is computed once and referenced by name afterwards.
    """
    declared = F.col(declared_col).cast("double") if declared_col in df.columns else F.lit(None).cast("double")
    s = strip(F.col(text_col))
    t1 = df.select("*", (s.isNull() | (s == "")).alias("_empty"), R.tokens(F.col(text_col)).alias("_toks"),
                   declared.alias("resource_count_declared"))
    t2 = t1.select("*", F.transform("_toks", R.token_category).alias("_cats"))
    n_parts = F.size("_toks")
    parsed = F.size(F.filter("_cats", lambda x: x.isNotNull()))
    t3 = t2.select("*", n_parts.alias("_nparts"), parsed.alias("_parsed"),
                   R.equipment_map_from_categories(F.col("_cats")).alias("equipment_vector"))
    empty, parsed = F.col("_empty"), F.col("_parsed")
    ratio = F.when(F.col("_nparts") > 0, parsed / F.col("_nparts")).otherwise(F.lit(0.0))
    delta = F.abs(parsed - F.col("resource_count_declared"))
    conflict = F.coalesce(delta > 0.01, F.lit(False))
    flags = F.array_compact(F.array(
        F.when(empty | (parsed == 0), F.lit(R.FLAG_MISSING)),
        F.when(~empty & (parsed > 0) & (ratio < 1.0), F.lit(R.FLAG_PARTIAL)),
        F.when(~empty & conflict, F.lit(R.FLAG_CONFLICT))))
    confidence = F.when(empty | (parsed == 0), F.lit(0.0)).otherwise(
        F.when(conflict, ratio * 0.5).otherwise(ratio))
    t4 = t3.select("*", R.resource_vector(F.col("equipment_vector")).alias("resource_vector"),
                   F.round(confidence, 4).alias("resource_parse_confidence"),
                   flags.alias("resource_parse_flags"),
                   F.when(empty, F.lit(0)).otherwise(parsed).alias("resource_vector_sum"),
                   F.when(empty, F.lit(0)).otherwise(parsed).alias("resource_count_parsed"),
                   F.when(~empty, delta.cast("double")).alias("resource_count_conflict"))
    out = t4.select("*", R.normalise(F.col("resource_vector")).alias("equipment_vector_norm"),
                    R.vector_total(F.col("resource_vector")).alias("_vtotal"))
    new = ["resource_count_declared", "equipment_vector", "resource_vector", "resource_parse_confidence",
           "resource_parse_flags", "resource_vector_sum", "resource_count_parsed", "resource_count_conflict",
           "equipment_vector_norm", "_vtotal"]
    return materialise(out.drop("_empty", "_toks", "_cats", "_nparts", "_parsed"), new)


def materialise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Emit ``cols`` through a one-row ``inline`` (a Generate).

    Catalyst pushes filters through projections by substituting every alias with
    its defining expression; a later filter on a parsed/ranked column would then
    re-run the whole parse inside the filter, once per reference. A filter cannot
    move below a Generate that produces the columns it reads, so the parse is
    evaluated exactly once per row.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))


def assign_rank(df: DataFrame, target: str = "vector", text_col: str = "equipment",
                count_col: str = "equipment_count") -> DataFrame:
    """Vector (canonical) or count-proxy rank with label source and training usability."""
    canonical = (F.coalesce(F.col("is_canonical_event_record"), F.lit(True))
                 if "is_canonical_event_record" in df.columns else F.lit(True))
    drop = {"rank_tz", "rank_tz_vector", "rank_tz_count_proxy", "rank_distance", "rank_label_source",
            "usable_for_training", "rank_normative_version", "rank_quality_flags", *DIAGNOSTIC_COLUMNS}
    if target == "vector":
        d = parse_diagnostics(df.select(*[c for c in df.columns if c not in drop]), text_col, count_col)
        d = d.select("*", R.nearest_from_norm(F.col("equipment_vector_norm"), F.col("_vtotal")).alias("_near"))
        flags = F.col("resource_parse_flags")
        blocked = F.array_contains(flags, R.FLAG_MISSING) | F.array_contains(flags, R.FLAG_PARTIAL)
        rank = F.when(~blocked, F.col("_near.rank"))
        dist = F.when(~blocked, F.col("_near.distance"))
        usable = ~blocked & ~F.array_contains(flags, R.FLAG_CONFLICT) & rank.isNotNull()
        out = d.select(*[c for c in d.columns if c not in ("resource_parse_flags", "_near", "_vtotal")],
                       rank.alias("rank_tz_vector"), dist.alias("rank_distance"),
                       R.json_string_list(flags).alias("resource_parse_flags"),
                       (canonical & usable).alias("usable_for_training"),
                       R.json_string_list(flags).alias("rank_quality_flags"))
        out = out.select("*", F.col("rank_tz_vector").alias("rank_tz"),
                         F.when(F.col("rank_tz_vector").isNotNull(), F.lit(S.LABEL_SOURCE_HISTORICAL_VECTOR))
                         .alias("rank_label_source"),
                         F.lit(R.NORMATIVE_VERSION).alias("rank_normative_version"))
        return materialise(out, ["rank_tz_vector", "rank_distance", "resource_parse_flags", "usable_for_training",
                                 "rank_quality_flags", "rank_tz", "rank_label_source"])
    if target == "count_proxy":
        base = df.select(*[c for c in df.columns if c not in drop])
        proxy = R.rank_by_count(F.col(count_col))
        n = F.col(count_col).cast("double")
        missing = n.isNull() | (n < 1)
        return base.select(
            "*",
            proxy["rank"].alias("rank_tz_count_proxy"), proxy["distance"].alias("rank_distance"),
            proxy["rank"].alias("rank_tz"),
            F.when(proxy["rank"].isNotNull(), F.lit(S.LABEL_SOURCE_PROXY_BOOTSTRAP)).alias("rank_label_source"),
            (canonical & proxy["rank"].isNotNull()).alias("usable_for_training"),
            F.lit(R.NORMATIVE_VERSION).alias("rank_normative_version"),
            F.when(missing, F.lit('["' + R.FLAG_MISSING_COUNT + '"]')).alias("rank_quality_flags"))
    raise ValueError(f"unknown target {target}")


def rank_distribution(df: DataFrame, rank_col: str = "rank_tz") -> DataFrame:
    """Count and share per rank value (null included), with total/min/max."""
    counts = df.groupBy(F.col(rank_col).alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    # the grouped table has at most a handful of rows: an unpartitioned window is fine
    w = Window.partitionBy()
    return counts.select(
        "rank", "n",
        F.sum("n").over(w).alias("total"),
        F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"),
        F.min("rank").over(w).alias("min_rank"),
        F.max("rank").over(w).alias("max_rank"))


def unparsed_report(df: DataFrame, text_col: str = "equipment", declared_col: str = "equipment_count",
                    top_n: int = 10) -> DataFrame:
    """Most frequent equipment strings that did not parse cleanly (ties by text)."""
    d = parse_diagnostics(df.select(text_col, declared_col), text_col, declared_col)
    bad = d.where(~((F.col("resource_parse_confidence") >= 1.0) & (F.size("resource_parse_flags") == 0)))
    return (bad.groupBy(F.col(text_col).alias("equipment"), "resource_parse_confidence",
                        F.array_join("resource_parse_flags", ",").alias("resource_parse_flags"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first("equipment"), "resource_parse_confidence",
                     "resource_parse_flags")
            .limit(top_n))


def mark_research_labels(df: DataFrame) -> DataFrame:
    """Research-only label source wherever a severity rank exists."""
    return df.withColumn("rank_label_source",
                         F.when(F.col("rank_ref").isNotNull(), F.lit(S.LABEL_SOURCE_RESEARCH_ONLY))
                         .otherwise(F.col("rank_label_source")))


def relabel(df: DataFrame, target: str = "vector", override_verified: bool = False,
            override_existing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Protected bulk relabel -> (new snapshot, one-row counters).

    Human-verified rows, decision-sourced rows and (unless overridden) rows that
    already carry a label keep their values; the rest are relabelled. The two
    flags are independent (a documented tightening of the source behaviour).
    """
    verified = F.coalesce(F.col("human_verified"), F.lit(False)) & F.lit(not override_verified)
    decision = F.coalesce(F.col("rank_label_source") == S.LABEL_SOURCE_DECISION, F.lit(False))
    existing = F.col("rank_tz").isNotNull() & F.lit(not override_existing)
    protected = verified | decision
    candidate = ~protected & ~existing
    fresh = assign_rank(df.where(candidate), target=target)
    # Both parts in the columns of the input and those the ranking adds; kept rows have none of the latter.
    added = [c for c in fresh.columns if c not in df.columns]
    kinds = dict(fresh.dtypes)
    kept = df.where(~candidate).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in added])
    missing = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c not in fresh.columns]
    snapshot = kept.unionByName(fresh.select("*", *missing))
    counters = df.agg(F.count_if(candidate).alias("candidates"), F.count_if(verified).alias("skipped_human_verified"),
                      F.count_if(decision).alias("skipped_decision"), F.count_if(existing & ~protected).alias("skipped_existing"))
    return snapshot, counters
