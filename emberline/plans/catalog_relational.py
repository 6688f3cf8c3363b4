"""Registered queries: decisions, joins, log, training assembly, set operations (J*, S12, M35, M38, M39, R12, R13, U*, D6, D7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import resources as RF
from ..operators import decisions as DC
from ..operators import resources as RS
from ..session import read_table
from . import incidents as V
from . import sqlblocks as B
from .registry import register

K = ["sheet_ord", "row_id"]
KS = "sheet_ord, row_id"
CUTOFF = "2024-01-15 00:00:00"


def _w(chain, select: str) -> str:
    return B.with_(*chain) + select


def _decisions(spark, sf):
    return DC.decisions_from_events(read_table(spark, sf, "events"))


def _log(spark, sf):
    return DC.log_from_events(read_table(spark, sf, "events"))


_RANKS = [float(r[0]) for r in sorted(RF.NORMATIVES, key=lambda r: r[4])]
DEC_SQL = ("dec AS (SELECT event_id AS decision_id, event_id AS fire_id, ts AS decided_at, CAST(user_id AS varchar) AS user_id, "
           f"{_RANKS}[CAST(least(floor(value / 50), 5) AS INTEGER) + 1] AS decision_rank, props AS comment, "
           "event_type = 'purchase' AS save_to_db, event_type AS decision_kind FROM events)")
LOG_SQL = ("oplog AS (SELECT event_id AS op_id, ts AS time, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' "
           "THEN 'WARNING' ELSE 'INFO' END AS level, event_type AS source, props AS message, CAST(user_id AS varchar) AS user FROM events)")


@register("s12_log_query", sql=lambda: _w([LOG_SQL], "SELECT * FROM oplog WHERE level = 'ERROR' ORDER BY time DESC, op_id DESC LIMIT 100"),
          ids=("S12", "T1", "T2"))
def s12_log_query(spark, sf):
    """Latest 100 ERROR operations, newest first (the latest-N view is the feature)."""
    return DC.query_log(_log(spark, sf), level="ERROR", limit=100)


@register("s12_log_window", sql=lambda: _w([LOG_SQL], "SELECT * FROM oplog WHERE source = 'click' AND time >= TIMESTAMP "
          "'2024-01-10 00:00:00' AND time <= TIMESTAMP '2024-01-20 00:00:00'"), ids=("S12",))
def s12_log_window(spark, sf):
    """All operations of one source inside a time window (no limit)."""
    import datetime as dt
    return DC.query_log(_log(spark, sf), source="click", start=dt.datetime(2024, 1, 10), end=dt.datetime(2024, 1, 20),
                        limit=None)


@register("s12_log_level_counts", sql=lambda: _w([LOG_SQL], "SELECT level, count(*) AS n FROM oplog GROUP BY level"),
          ids=("S12",))
def s12_log_level_counts(spark, sf):
    """Error / warning / info counts of the operations log."""
    return DC.log_level_counts(_log(spark, sf))


def _fires_sql():
    return V.sql_labelled() + [DEC_SQL, "fires AS (SELECT * FROM labelled WHERE sheet_ord = 0)"]


def _fires(spark, sf):
    return V.labelled(spark, sf).where(F.col("sheet_ord") == 0)


@register("j1_promote_decisions", sql=lambda: _w(_fires_sql(),
          "SELECT d.decision_id, f.row_id, d.decision_rank AS rank_tz, 'lpr_decision' AS rank_label_source, true AS human_verified, "
          "f.region, f.fire_date FROM dec d JOIN fires f ON d.fire_id = f.row_id WHERE d.save_to_db AND d.decision_rank IS NOT NULL"),
          ids=("J1", "M38"))
def j1_promote_decisions(spark, sf):
    """Approved decisions joined to their incidents become training rows (decision rank as label)."""
    p = DC.promote_decisions(_decisions(spark, sf), _fires(spark, sf))
    return p.select("decision_id", "row_id", "rank_tz", "rank_label_source", "human_verified", "region", "fire_date")


@register("j2_decision_summaries", sql=lambda: _w(_fires_sql(),
          "SELECT d.decision_id, d.fire_id, d.decided_at, d.decision_rank, f.rank_tz AS fire_rank, f.region, f.fire_date, "
          "CASE WHEN length(d.comment) > 80 THEN substr(d.comment, 1, 77) || '...' ELSE d.comment END AS comment_preview "
          "FROM dec d LEFT JOIN fires f ON d.fire_id = f.row_id ORDER BY d.decided_at DESC, d.decision_id DESC"), ids=("J2",))
def j2_decision_summaries(spark, sf):
    """Decision summaries (left join to incidents), newest first, with comment preview."""
    return DC.decision_summaries(_decisions(spark, sf), _fires(spark, sf))


@register("j3_decision_cards", sql=lambda: _w(_fires_sql(),
          "SELECT d.decision_id, d.fire_id, d.decision_rank, f.region AS fire_region, f.building_floors AS fire_building_floors, "
          "f.equipment AS fire_equipment, f.rank_tz AS fire_rank FROM dec d LEFT JOIN fires f ON d.fire_id = f.row_id"),
          ids=("J3",))
def j3_decision_cards(spark, sf):
    """Decision card with an incident snapshot (struct from a left join), flattened for output."""
    c = DC.decision_cards(_decisions(spark, sf), _fires(spark, sf))
    return c.select("decision_id", "fire_id", "decision_rank", F.col("fire.region").alias("fire_region"),
                    F.col("fire.building_floors").alias("fire_building_floors"),
                    F.col("fire.equipment").alias("fire_equipment"), F.col("fire.rank_tz").alias("fire_rank"))


@register("j4_pending_decisions", sql=lambda: _w([DEC_SQL],
          f"SELECT count(*) AS pending FROM dec d WHERE d.save_to_db AND NOT EXISTS (SELECT 1 FROM dec p WHERE p.save_to_db AND "
          f"p.decided_at < TIMESTAMP '{CUTOFF}' AND p.decision_id = d.decision_id)"), ids=("J4",))
def j4_pending_decisions(spark, sf):
    """Approved decisions not yet promoted (promoted = approved before the cutoff), by anti-join."""
    import datetime as dt
    d = _decisions(spark, sf)
    promoted = d.where(F.col("save_to_db") & (F.col("decided_at") < F.lit(dt.datetime(2024, 1, 15))))
    return DC.pending_decisions(d, promoted)


@register("m35_training_assembly", sql=lambda: _w(_fires_sql() + [
          "prom AS (SELECT d.decision_id, d.decision_rank AS rank_tz FROM dec d JOIN fires f ON d.fire_id = f.row_id "
          "WHERE d.save_to_db AND d.decision_rank IS NOT NULL)",
          "hist AS (SELECT rank_tz FROM labelled WHERE usable_for_training AND rank_tz IS NOT NULL AND is_canonical_event_record)"],
          "SELECT 'historical' AS training_source, rank_tz, count(*) AS n FROM hist GROUP BY 2 UNION ALL "
          "SELECT 'lpr_decision', rank_tz, count(*) FROM prom GROUP BY 2"), ids=("M35", "U1"))
def m35_training_assembly(spark, sf):
    """Training set = usable canonical historical labels UNION promoted decisions; counts per source and rank."""
    lab = V.labelled(spark, sf)
    prom = DC.promote_decisions(_decisions(spark, sf), lab.where(F.col("sheet_ord") == 0))
    t = DC.assemble_training(lab, prom)
    return t.groupBy("training_source", "rank_tz").agg(F.count(F.lit(1)).alias("n"))


_M38_TEXT = ("CASE WHEN value < 40 THEN '1' WHEN value < 80 THEN '1-бис' WHEN value < 120 THEN 'Ранг 2' WHEN value < 160 THEN '3,0' "
             "WHEN value < 200 THEN ' 4 ' WHEN value < 300 THEN '5' ELSE 'n/a' END")


@register("m38_derive_decisions", sql=lambda: _w([
          f"cases AS (SELECT event_id AS decision_id, {_M38_TEXT} AS decision_rank_text, CASE WHEN event_type = 'view' THEN NULL "
          "ELSE props END AS comment, CASE WHEN event_type = 'click' THEN NULL ELSE CAST(user_id AS varchar) END AS user_id, "
          "CASE WHEN event_type = 'error' THEN false WHEN event_type = 'view' THEN NULL ELSE true END AS save_to_db FROM events)",
          "c1 AS (SELECT *, lower(coalesce(decision_rank_text, '')) AS t FROM cases)",
          "c2 AS (SELECT *, CASE WHEN contains(t, 'бис') THEN 1.5 ELSE TRY_CAST(replace(regexp_extract(t, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) END AS r FROM c1)"],
          "SELECT decision_id, CASE WHEN r IN (1.0, 1.5, 2.0, 3.0, 4.0, 5.0) THEN r END AS decision_rank, coalesce(comment, '') AS "
          "decision_comment, coalesce(user_id, 'LPR') AS decision_user, coalesce(save_to_db, true) AS decision_saved, "
          "CASE WHEN coalesce(save_to_db, true) AND r IN (1.0, 1.5, 2.0, 3.0, 4.0, 5.0) THEN r END AS label_rank FROM c2"),
          ids=("M38",))
def m38_derive_decisions(spark, sf):
    """Submitted decisions: rank text -> number, defaults, label only when saved."""
    ev = read_table(spark, sf, "events")
    v = F.col("value")
    text = (F.when(v < 40, "1").when(v < 80, "1-бис").when(v < 120, "Ранг 2").when(v < 160, "3,0")
            .when(v < 200, " 4 ").when(v < 300, "5").otherwise("n/a"))
    cases = ev.select(F.col("event_id").alias("decision_id"), text.alias("decision_rank_text"),
                      F.when(F.col("event_type") == "view", None).otherwise(F.col("props")).alias("comment"),
                      F.when(F.col("event_type") == "click", None).otherwise(F.col("user_id").cast("string")).alias("user_id"),
                      F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "view", None)
                      .otherwise(True).alias("save_to_db"))
    d = DC.derive_decisions(cases)
    return d.select("decision_id", "decision_rank", "decision_comment", "decision_user", "decision_saved", "label_rank")


@register("m39_apply_corrections", sql=lambda: _w([DEC_SQL,
          "corr AS (SELECT decision_id, 5.0 AS decision_rank, 'escalated: ' || comment AS comment FROM dec WHERE decision_kind = 'error')"],
          "SELECT d.decision_id, coalesce(c.decision_rank, d.decision_rank) AS decision_rank, coalesce(c.comment, d.comment) AS comment, "
          "c.decision_rank IS NOT NULL AS corrected FROM dec d LEFT JOIN corr c USING (decision_id)"), ids=("M39",))
def m39_apply_corrections(spark, sf):
    """New decision snapshot after corrections (error decisions escalated to rank 5)."""
    d = _decisions(spark, sf)
    corr = d.where(F.col("decision_kind") == "error").select(
        "decision_id", F.lit(5.0).alias("decision_rank"), F.concat(F.lit("escalated: "), F.col("comment")).alias("comment"))
    return DC.apply_corrections(d, corr).select("decision_id", "decision_rank", "comment", "corrected")


def _r12_sql():
    return _w(_fires_sql() + [
        "verified AS (SELECT DISTINCT fire_id FROM dec WHERE save_to_db)",
        "mk AS (SELECT l.*, coalesce(l.sheet_ord = 0 AND l.row_id IN (SELECT fire_id FROM verified), false) AS hv FROM labelled l)"],
        "SELECT count_if(NOT hv AND rank_tz IS NULL) AS candidates, count_if(hv) AS skipped_human_verified, "
        "0 AS skipped_decision, count_if(NOT hv AND rank_tz IS NOT NULL) AS skipped_existing FROM mk")


@register("r12_protected_relabel", sql=_r12_sql, ids=("R12",))
def r12_protected_relabel(spark, sf):
    """Bulk relabel counters: human-verified (approved decision) rows and labelled rows are protected."""
    lab = V.labelled(spark, sf)
    verified = _decisions(spark, sf).where("save_to_db").select(F.col("fire_id").alias("_fid")).distinct()
    marked = (lab.join(verified, (F.col("row_id") == F.col("_fid")) & (F.col("sheet_ord") == 0), "left")
              .withColumn("human_verified", F.col("_fid").isNotNull()).drop("_fid"))
    _snap, counters = RS.relabel(marked, target="vector")
    return counters.select(F.col("candidates"), "skipped_human_verified", "skipped_decision", "skipped_existing")


@register("r13_research_labels", sql=lambda: _w(V.sql_cleaned(),
          "SELECT CASE WHEN rank_ref IS NOT NULL THEN 'research_only' END AS rank_label_source, count(*) AS n FROM cleaned GROUP BY 1"),
          ids=("R13",))
def r13_research_labels(spark, sf):
    """Research-only label source wherever a severity rank exists (counts)."""
    c = V.cleaned(spark, sf).withColumn("rank_label_source", F.lit(None).cast("string"))
    m = RS.mark_research_labels(c)
    return m.groupBy("rank_label_source").agg(F.count(F.lit(1)).alias("n"))


_HASH_COLS = ["region_code", "building_floors", "fire_floor", "distance_to_station", "t_detect_min", "equipment_count"]


def _feat_hash_sql(cols):
    parts = [f"coalesce(CAST(round(CAST({c} AS DOUBLE), 6) AS varchar), '∅')" for c in cols]
    return "sha256(concat_ws('|', " + ", ".join(parts) + "))"


@register("d7_feature_overlap_rate", sql=lambda: _w(V.sql_stage1() + [
          f"real AS (SELECT DISTINCT {_feat_hash_sql(_HASH_COLS)} AS h FROM stage1 WHERE sheet_ord = 0 AND row_id % 10 <> 0)",
          f"syn AS (SELECT {_feat_hash_sql(_HASH_COLS)} AS h FROM stage1 WHERE sheet_ord = 1)"],
          "SELECT count(*) AS n_candidate, count_if(h IN (SELECT h FROM real)) AS n_overlap, "
          "round(count_if(h IN (SELECT h FROM real)) / count(*), 6) AS overlap_rate FROM syn"), ids=("D7", "J5"))
def d7_feature_overlap_rate(spark, sf):
    """Share of period-sheet rows whose feature hash (numerics rounded to 6) exists in nine tenths of the merged sheet (semi-join)."""
    st = V.stage1(spark, sf)
    real = st.where((F.col("sheet_ord") == 0) & (F.col("row_id") % 10 != 0)).select(_feat_hash_sql_spark().alias("h")).distinct()
    syn = st.where(F.col("sheet_ord") == 1).select(_feat_hash_sql_spark().alias("h"))
    hit = syn.join(real, "h", "left_semi")
    n = syn.agg(F.count(F.lit(1)).alias("n_candidate"))
    k = hit.agg(F.count(F.lit(1)).alias("n_overlap"))
    return n.crossJoin(k).select("n_candidate", "n_overlap", F.round(F.col("n_overlap") / F.col("n_candidate"), 6)
                                 .alias("overlap_rate"))


def _feat_hash_sql_spark():
    # same text as the SQL twin: round(x, 6) rendered as text, null as ∅
    parts = [F.coalesce(F.round(F.col(c).cast("double"), 6).cast("string"), F.lit("∅")) for c in _HASH_COLS]
    return F.sha2(F.concat_ws("|", *parts), 256)


@register("d6_real_test_dedup", sql=lambda: _w(V.sql_labelled() + [
          f"rt AS (SELECT {KS}, {_feat_hash_sql(_HASH_COLS + ['rank_tz'])} AS k FROM labelled WHERE source_sheet = "
          f"{B.q(S.CANONICAL_SOURCE_SHEET)} AND rank_tz IS NOT NULL)",
          f"rn AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {KS}) AS r FROM rt)"],
          "SELECT count(*) AS n_before, count_if(r = 1) AS n_kept, count_if(r > 1) AS n_removed FROM rn"), ids=("D6",))
def d6_real_test_dedup(spark, sf):
    """Real canonical test rows: stable feature+label key, duplicates dropped (keep first in ingest order)."""
    from ..operators.identity import full_row_duplicates
    lab = V.labelled(spark, sf).where((F.col("source_sheet") == S.CANONICAL_SOURCE_SHEET) & F.col("rank_tz").isNotNull())
    parts = [F.coalesce(F.round(F.col(c).cast("double"), 6).cast("string"), F.lit("∅")) for c in _HASH_COLS + ["rank_tz"]]
    keyed = lab.select(*K, F.sha2(F.concat_ws("|", *parts), 256).alias("k"))
    d = full_row_duplicates(keyed, ["k"], K)
    return d.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(~F.col("is_exact_duplicate")).alias("n_kept"),
                 F.count_if("is_exact_duplicate").alias("n_removed"))
