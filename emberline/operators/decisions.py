"""Analyst decisions, promotion to training data, and the operations log.

All update-style operations (promotion, correction, relabel) return a new
snapshot DataFrame instead of mutating rows: Parquet tables are immutable, and a
snapshot written to a new location is the Spark-native way to version them.
Keys are joined with shuffle/sort-merge joins (both sides grow with the data);
AQE handles skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import resources as R

COMMENT_PREVIEW = 77
COMMENT_LIMIT = 80


def decisions_from_events(events: DataFrame) -> DataFrame:
    """Fixture binding: every event is an analyst decision on incident ``fire_id = event_id``.

    ``purchase`` events are approved decisions (saved to the store), other
    types are proposals; the chosen rank comes from the event value.
    """
    ranks = [float(r[0]) for r in sorted(R.NORMATIVES, key=lambda r: r[4])]
    idx = F.least(F.floor(F.col("value") / 50), F.lit(len(ranks) - 1)).cast("int")
    rank = F.element_at(F.array(*[F.lit(r) for r in ranks]), idx + 1)
    return events.select(
        F.col("event_id").alias("decision_id"), F.col("event_id").alias("fire_id"), F.col("ts").alias("decided_at"),
        F.col("user_id").cast("string").alias("user_id"), rank.alias("decision_rank"),
        F.col("props").alias("comment"), (F.col("event_type") == "purchase").alias("save_to_db"),
        F.col("event_type").alias("decision_kind"))


def comment_preview(c: Column) -> Column:
    return F.when(F.length(c) > COMMENT_LIMIT, F.concat(F.substring(c, 1, COMMENT_PREVIEW), F.lit("..."))).otherwise(c)


def decision_summaries(decisions: DataFrame, fires: DataFrame) -> DataFrame:
    """Every decision with its incident's region/date and a comment preview (newest first)."""
    f = fires.select(F.col("row_id").alias("fire_id"), "region", "fire_date", F.col("rank_tz").alias("fire_rank"))
    return (decisions.join(f, "fire_id", "left")
            .select("decision_id", "fire_id", "decided_at", "decision_rank", "fire_rank", "region", "fire_date",
                    comment_preview(F.col("comment")).alias("comment_preview"))
            .orderBy(F.desc("decided_at"), F.desc("decision_id")))


def decision_cards(decisions: DataFrame, fires: DataFrame) -> DataFrame:
    """Decision card with a struct snapshot of the incident (left join on the key)."""
    f = fires.select(F.col("row_id").alias("fire_id"),
                     F.struct("region", "fire_date", "building_floors", "fire_floor", "equipment",
                              "rank_tz").alias("fire"))
    return decisions.join(f, "fire_id", "left").select("decision_id", "fire_id", "decision_rank", "fire")


def promote_decisions(decisions: DataFrame, fires: DataFrame, promoted: DataFrame | None = None,
                      promoted_by: str = "analyst") -> DataFrame:
    """Approved decisions joined to their incidents become training rows (idempotent).

    Rows already promoted (by decision id) are removed with an anti-join; the
    decision's rank overwrites the label columns.
    """
    approved = decisions.where(F.col("save_to_db") & F.col("decision_rank").isNotNull())
    if promoted is not None:
        approved = approved.join(promoted.select("decision_id"), "decision_id", "left_anti")
    f = fires.drop("rank_tz", "rank_label_source", "human_verified", "usable_for_training")
    j = approved.select("decision_id", "fire_id", "decision_rank", "decided_at").join(
        f, F.col("fire_id") == F.col("row_id"), "inner")
    return j.select(*[c for c in f.columns], "decision_id", F.col("decision_rank").alias("rank_tz"),
                    F.lit(S.LABEL_SOURCE_DECISION).alias("rank_label_source"), F.lit(True).alias("human_verified"),
                    F.lit(True).alias("usable_for_training"), F.lit(promoted_by).alias("promoted_by"),
                    F.col("decided_at").alias("promoted_at"))


def pending_decisions(decisions: DataFrame, promoted: DataFrame) -> DataFrame:
    """Approved decisions not yet promoted (left anti-join) and their count."""
    approved = decisions.where(F.col("save_to_db"))
    left = approved.join(promoted.select("decision_id"), "decision_id", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("pending"))


def assemble_training(historical: DataFrame, promoted: DataFrame, label: str = "rank_tz",
                      canonical_only: bool = True) -> DataFrame:
    """Usable (and canonical) labelled historical rows UNION promoted decisions."""
    cond = F.col("usable_for_training") & F.col(label).isNotNull()
    if canonical_only:
        cond = cond & F.coalesce(F.col("is_canonical_event_record"), F.lit(False))
    hist = historical.where(cond).withColumn("training_source", F.lit("historical"))
    prom = promoted.where(F.col(label).isNotNull()).withColumn("training_source", F.lit("lpr_decision"))
    return hist.unionByName(prom, allowMissingColumns=True)


def derive_decisions(cases: DataFrame) -> DataFrame:
    """Typed coercion and defaults of submitted decisions; label only when approved.

    ``decision_rank_text`` accepts "1", "1.5", "1-бис" or "Ранг 2"; the first
    number wins, "бис" means 1.5.
    """
    txt = F.lower(F.coalesce(F.col("decision_rank_text"), F.lit("")))
    num = F.regexp_extract(txt, r"([0-9]+(?:[.,][0-9]+)?)", 1)
    val = F.regexp_replace(num, ",", ".").try_cast("double")
    rank = F.when(txt.contains("бис"), F.lit(1.5)).otherwise(val)
    valid = rank.isin(*[float(r[0]) for r in R.NORMATIVES])
    return cases.select(
        "*",
        F.when(valid, rank).alias("decision_rank"),
        F.coalesce(F.col("comment"), F.lit("")).alias("decision_comment"),
        F.coalesce(F.col("user_id"), F.lit("LPR")).alias("decision_user"),
        F.coalesce(F.col("save_to_db"), F.lit(True)).alias("decision_saved"),
        F.when(F.coalesce(F.col("save_to_db"), F.lit(True)) & valid, rank).alias("label_rank"))


def apply_corrections(decisions: DataFrame, corrections: DataFrame) -> DataFrame:
    """New snapshot = decisions left-joined with corrections (rank/comment coalesced)."""
    c = corrections.select("decision_id", F.col("decision_rank").alias("_new_rank"),
                           F.col("comment").alias("_new_comment"))
    j = decisions.join(c, "decision_id", "left")
    return j.select(*[F.coalesce(F.col("_new_rank"), F.col("decision_rank")).alias(c_) if c_ == "decision_rank"
                      else F.coalesce(F.col("_new_comment"), F.col("comment")).alias(c_) if c_ == "comment"
                      else F.col(c_) for c_ in decisions.columns],
                    F.col("_new_rank").isNotNull().alias("corrected"))


def merge_decisions(decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """The next version of ``decisions`` after ``updates(decision_id, decision_rank, comment, updated_at, update_id)``, with ``changed`` and ``updated_at``.

    The last update of a decision by (updated_at, update_id) holds. Its rank and comment replace the old ones, so a null
    rank clears the rank and a null comment the comment. Updates of unknown decisions are left out. ``changed`` is true where either differs.
    """
    last = updates.groupBy(F.col("decision_id").alias("for_")).agg(F.max(F.struct("updated_at", "update_id", "decision_rank", "comment")).alias("u_"))
    joined = decisions.join(last, F.col("decision_id") == F.col("for_"), "left")
    given = F.col("for_").isNotNull()
    new = {"decision_rank": F.when(given, F.col("u_.decision_rank")).otherwise(F.col("decision_rank")), "comment": F.when(given, F.col("u_.comment")).otherwise(F.col("comment"))}
    changed = given & ~(F.col("decision_rank").eqNullSafe(new["decision_rank"]) & F.col("comment").eqNullSafe(new["comment"]))
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in decisions.columns], changed.alias("changed"), F.col("u_.updated_at").alias("updated_at"))


def propagate_decisions(incidents: DataFrame, merged: DataFrame, key: str = "row_id") -> DataFrame:
    """The next version of ``incidents``: those of updated, saved decisions take the decision's rank and count as verified and usable.

    The decision updated last holds where an incident has several; a cleared rank clears the incident's rank too.
    """
    saved = merged.where(F.col("updated_at").isNotNull() & F.col("save_to_db"))
    last = saved.groupBy(F.col("fire_id").alias("for_")).agg(F.max(F.struct("updated_at", "decision_id", "decision_rank")).alias("d_"))
    joined = incidents.join(last, F.col(key) == F.col("for_"), "left")
    hit = F.col("for_").isNotNull()
    new = {"rank_tz": F.col("d_.decision_rank"), "rank_tz_vector": F.col("d_.decision_rank"), "rank_label_source": F.lit(S.LABEL_SOURCE_DECISION),
           "human_verified": F.lit(True), "usable_for_training": F.lit(True)}
    old = {"human_verified": F.lit(False)} if "human_verified" not in incidents.columns else {}
    cols = [F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in incidents.columns]
    return joined.select(*cols, *[F.when(hit, new[c]).otherwise(v).alias(c) for c, v in old.items()])


def whole_number(c: Column) -> Column:
    """Text as a whole number: decimals are cut off, anything else is null."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", ".").try_cast("double").try_cast("bigint")


def submitted_incidents(cases: DataFrame, whole: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """Submitted cases as incidents of their own: fields coerced, source and dates of the submission, label where saved, event identity.

    ``cases`` has case_id, decided_at, decision_rank (parsed) and decision_saved beside incident fields as text.
    """
    from .identity import event_identity

    when = F.col("decided_at")
    new = {"row_id": F.lit(None).cast("bigint"), "source_sheet": F.lit("LPR_MANUAL_INPUT"), "fire_date": when.cast("date"), "year": F.year(when), "month": F.month(when)}
    new |= {c: whole_number(F.col(c)) for c in whole} | {c: F.regexp_replace(F.trim(F.col(c).cast("string")), ",", ".").try_cast("double") for c in numbers}
    saved = F.coalesce(F.col("decision_saved"), F.lit(True)) & F.col("decision_rank").isNotNull()
    rows = cases.withColumns(new | {"rank_tz": F.when(saved, F.col("decision_rank")), "rank_label_source": F.when(saved, F.lit(S.LABEL_SOURCE_DECISION)),
                                    "human_verified": saved})
    return event_identity(rows, ["case_id"]).withColumn("usable_for_training", F.col("human_verified"))


# ---- operations log (S12) ---------------------------------------------------------

def log_from_events(events: DataFrame) -> DataFrame:
    """Fixture binding: events as operation-log records (time, level, source, message)."""
    level = (F.when(F.col("event_type") == "error", F.lit("ERROR"))
             .when(F.col("event_type") == "signup", F.lit("WARNING")).otherwise(F.lit("INFO")))
    return events.select(F.col("event_id").alias("op_id"), F.col("ts").alias("time"), level.alias("level"),
                         F.col("event_type").alias("source"), F.col("props").alias("message"),
                         F.col("user_id").cast("string").alias("user"))


def query_log(log: DataFrame, level: str | None = None, source: str | None = None, start=None, end=None,
              limit: int | None = 100) -> DataFrame:
    """Filter by level/source/time window, newest first, optional limit (the feature is a "latest N" view)."""
    cond = F.lit(True)
    if level:
        cond = cond & (F.col("level") == level)
    if source:
        cond = cond & (F.col("source") == source)
    if start is not None:
        cond = cond & (F.col("time") >= F.lit(start))
    if end is not None:
        cond = cond & (F.col("time") <= F.lit(end))
    out = log.where(cond).orderBy(F.desc("time"), F.desc("op_id"))
    return out.limit(limit) if limit else out


def log_level_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
