"""Registered queries: sources, cleaning, identity, resources and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import resources as R
from ..operators import cleaning as C
from ..operators import identity as I
from ..operators import resources as RS
from . import incidents as V
from . import sqlblocks as B
from .registry import register

K = ["sheet_ord", "row_id"]
KS = "sheet_ord, row_id"


def _w(chain, select: str) -> str:
    return B.with_(*chain) + select


# --- sources ---------------------------------------------------------------

@register("s2_incident_union", sql=lambda: _w(V.sql_raw(), "SELECT * FROM incidents"), ids=("S1", "S2"))
def s2_incident_union(spark, sf):
    """Harmonised two-sheet incident table (union by name)."""
    return V.raw(spark, sf)


@register("s3_bounded_preview", sql=lambda: _w(V.sql_raw(),
          "SELECT source_sheet, sheet_ord, row_id, region, equipment FROM incidents ORDER BY sheet_ord, row_id LIMIT 50"),
          ids=("S3",))
def s3_bounded_preview(spark, sf):
    """First 50 rows across sheets in ingest order (a preview is the feature)."""
    return (V.raw(spark, sf).select("source_sheet", "sheet_ord", "row_id", "region", "equipment")
            .orderBy(*K).limit(50))


@register("s4_code_dictionary", sql=lambda: _w(V.sql_stage1(),
          "SELECT DISTINCT cast(region_code AS BIGINT) AS code, region_text AS name FROM stage1 "
          "WHERE region_code IS NOT NULL"), ids=("S4", "J6"))
def s4_code_dictionary(spark, sf):
    """Code -> name dictionary extracted from the coded text column (null keys dropped)."""
    return (V.stage1(spark, sf).where(F.col("region_code").isNotNull())
            .select(F.col("region_code").cast("bigint").alias("code"), F.col("region_text").alias("name"))
            .distinct())


# --- cleaning --------------------------------------------------------------

@register("p1_canonical_columns", sql=lambda: _w(V.sql_stage1(),
          "SELECT " + ", ".join(["source_sheet", "sheet_ord"] + S.EN_COLS) + " FROM stage1"), ids=("P1", "F20"))
def p1_canonical_columns(spark, sf):
    """Raw table projected to the 37 canonical English columns (missing ones as typed nulls)."""
    return V.stage1(spark, sf).select("source_sheet", "sheet_ord", *S.EN_COLS)


@register("p2_canonical_source", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, row_id AS rid FROM stage1 WHERE source_sheet = {B.q(S.CANONICAL_SOURCE_SHEET)}"),
          ids=("P2",))
def p2_canonical_source(spark, sf):
    """Rows of the canonical (merged) source sheet."""
    return (V.stage1(spark, sf).where(F.col("source_sheet") == S.CANONICAL_SOURCE_SHEET)
            .select(*K, F.col("row_id").alias("rid")))


@register("p3_date_window", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, fire_date, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, flag_date_outlier FROM stage1"),
          ids=("P3",))
def p3_date_window(spark, sf):
    """Date window 2000-2020: outliers flagged and their date/year/month nulled."""
    return V.stage1(spark, sf).select(*K, "fire_date", "year", "month", "flag_date_outlier")


_CODE_OUT = [f"{c}_code" for c in S.CODE_COLS] + ["equipment_count", "nozzle_count"]


@register("p4_leading_codes", sql=lambda: _w(V.sql_stage1(), f"SELECT {KS}, {', '.join(_CODE_OUT)} FROM stage1"),
          ids=("P4",))
def p4_leading_codes(spark, sf):
    """First integer of every coded text column (15 codes + 2 counts)."""
    return V.stage1(spark, sf).select(*K, *_CODE_OUT)


_TEXT_OUT = [f"{c}_text" for c in S.CODE_COLS]


@register("p5_text_normalisation", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, {', '.join(_TEXT_OUT)}, {B.norm_free_text('object_name')} AS object_name_norm, "
          f"{B.norm_free_text('address')} AS address_norm FROM stage1"), ids=("P5",))
def p5_text_normalisation(spark, sf):
    """strip+lower text columns; free-text variant also collapses whitespace and maps null to ''."""
    from ..functions.text import norm_free_text
    return V.stage1(spark, sf).select(*K, *_TEXT_OUT, norm_free_text("object_name").alias("object_name_norm"),
                                      norm_free_text("address").alias("address_norm"))


@register("p6_numeric_coercion", sql=lambda: _w(V.sql_stage1(), f"SELECT {KS}, {', '.join(S.NUM_COLS)} FROM stage1"),
          ids=("P6",))
def p6_numeric_coercion(spark, sf):
    """The 11 numeric columns coerced to double (bad values -> null)."""
    return V.stage1(spark, sf).select(*K, *S.NUM_COLS)


_TIME_OUT = [x for c in S.TIME_COLS for x in (f"{c}_min", f"{c}_invalid")]


@register("p7_time_of_day", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, " + ", ".join(f"CAST({c}_min AS INTEGER) AS {c}_min, {c}_invalid" for c in S.TIME_COLS)
          + " FROM stage1"), ids=("P7",))
def p7_time_of_day(spark, sf):
    """Seven time columns -> minutes since midnight + invalid flag."""
    return V.stage1(spark, sf).select(*K, *_TIME_OUT)


@register("p8_severity_score", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, round(direct_damage_log, 6) AS direct_damage_log, round(severity_score, 6) AS severity_score FROM stage1"),
          ids=("P8",))
def p8_severity_score(spark, sf):
    """5*fatalities + 2*injuries + log1p(damage); null when damage is null."""
    return V.stage1(spark, sf).select(*K, F.round("direct_damage_log", 6).alias("direct_damage_log"),
                                      F.round("severity_score", 6).alias("severity_score"))


@register("p9_severity_rank", sql=lambda: _w(V.sql_cleaned(), f"SELECT {KS}, rank_ref FROM cleaned"), ids=("P9",))
def p9_severity_rank(spark, sf):
    """Quartile severity rank (0 -> 1, positive scores -> 2..5 by their own quartiles)."""
    return V.cleaned(spark, sf).select(*K, "rank_ref")


@register("p9_severity_quartiles", sql=lambda: _w(V.sql_stage1(),
          "SELECT round(quantile_cont(severity_score, 0.25), 6) AS q25, round(quantile_cont(severity_score, 0.5), 6) AS q50, "
          "round(quantile_cont(severity_score, 0.75), 6) AS q75 FROM stage1 WHERE severity_score > 0"), ids=("P9", "A3"))
def p9_severity_quartiles(spark, sf):
    """The three quartiles of the positive severity scores (exact, distributed)."""
    q = C.severity_quantiles(V.stage1(spark, sf))
    return spark.range(1).select(*[F.round(F.lit(q[p]), 6).alias(n) for p, n in
                                   ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])


_FLAGS = ["flag_date_outlier", "flag_floor_outlier", "flag_distance_outlier", "flag_floor_inconsistent",
          "flag_negative_values", "flag_damage_outlier", "flag_time_invalid", "flag_missing_outputs"]


@register("p10_quality_flags", sql=lambda: _w(V.sql_cleaned(), f"SELECT {KS}, {', '.join(_FLAGS)} FROM cleaned"),
          ids=("P10",))
def p10_quality_flags(spark, sf):
    """Eight boolean quality flags per row (missing operands compare false)."""
    return V.cleaned(spark, sf).select(*K, *_FLAGS)


@register("p11_p13_source_attributes", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, source_sheet, {B.sheet_period('source_sheet')} AS sheet_period, "
          f"{B.source_priority('source_sheet')} AS source_priority, "
          "CASE WHEN year IS NULL THEN NULL WHEN year <= 2008 THEN '<=2008' ELSE '>2008' END AS period_group FROM stage1"),
          ids=("P11", "P12", "P13"))
def p11_p13_source_attributes(spark, sf):
    """Sheet period by prefix, source priority by ordered substring, period group by year."""
    return V.stage1(spark, sf).select(*K, "source_sheet", C.sheet_period("source_sheet").alias("sheet_period"),
                                      C.source_priority("source_sheet").alias("source_priority"),
                                      C.period_group("year").alias("period_group"))


@register("a1_quality_report", ids=("A1",), sql=lambda: _w(V.sql_cleaned() + [B.identity("cleaned")], "SELECT "
          + ", ".join([f"count_if({c}_invalid) AS invalid_{c}" for c in S.TIME_COLS]
                      + [f"count_if({f}) AS {f.replace('flag_', 'n_')}" for f in
                         ["flag_floor_outlier", "flag_distance_outlier", "flag_floor_inconsistent",
                          "flag_negative_values", "flag_damage_outlier", "flag_missing_outputs", "flag_date_outlier",
                          "flag_time_invalid"]]
                      + ["count_if(is_canonical_event_record) AS canonical_rows",
                         "count_if(NOT is_canonical_event_record) AS duplicate_rows",
                         "round(avg(CASE WHEN event_id IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS event_id_coverage_pct",
                         "count(*) AS n_rows"]) + " FROM ident"))
def a1_quality_report(spark, sf):
    """One-row quality report: invalid times, flag counts, canonical/duplicate rows, id coverage."""
    return C.quality_report(I.event_identity(V.cleaned(spark, sf), K))


# --- identity ----------------------------------------------------------------

@register("d1_exact_duplicates", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, row_number() OVER (PARTITION BY {', '.join(S.EN_COLS)} ORDER BY {KS}) > 1 AS is_exact_duplicate "
          "FROM stage1"), ids=("D1",))
def d1_exact_duplicates(spark, sf):
    """Full-row duplicate flag over the 37 canonical columns; first occurrence kept."""
    return I.full_row_duplicates(V.stage1(spark, sf), S.EN_COLS, K).select(*K, "is_exact_duplicate")


@register("d2_event_identity", sql=lambda: _w(V.sql_identified(),
          f"SELECT {KS}, event_fingerprint, event_id, duplicate_group_id, event_id_low_confidence FROM ident"),
          ids=("D2", "P5"))
def d2_event_identity(spark, sf):
    """Fingerprint, sha-256 event id and duplicate-group id per row."""
    return V.identified(spark, sf).select(*K, "event_fingerprint", "event_id", "duplicate_group_id",
                                          "event_id_low_confidence")


@register("d3_canonical_record", sql=lambda: _w(V.sql_identified(),
          f"SELECT {KS}, source_priority, is_canonical_event_record FROM ident"), ids=("D3", "W2"))
def d3_canonical_record(spark, sf):
    """Canonical record per duplicate group: completeness, then priority, then ingest order."""
    return V.identified(spark, sf).select(*K, "source_priority", "is_canonical_event_record")


@register("d4_duplicate_policy", sql=lambda: _w(V.sql_identified(), f"SELECT {KS}, duplicate_policy FROM ident"),
          ids=("D4", "W1"))
def d4_duplicate_policy(spark, sf):
    """unique / canonical_event_only / conflict_kept per row."""
    return V.identified(spark, sf).select(*K, "duplicate_policy")


def _d5_sql():
    return _w(V.sql_cleaned() + [B.identity("cleaned", prefix="x_", where="sheet_ord = 0 AND row_id % 10 <> 0"),
                                 B.identity("cleaned", prefix="n_", where="sheet_ord = 1")],
              "SELECT count_if(is_canonical_event_record) AS n_incoming_canonical,\n"
              "  count_if(is_canonical_event_record AND event_id NOT IN (SELECT event_id FROM x_ident WHERE event_id IS NOT NULL)\n"
              "    AND event_fingerprint NOT IN (SELECT event_fingerprint FROM x_ident)) AS n_added\n"
              "FROM n_ident")


@register("d5_import_dedup", sql=_d5_sql, ids=("D5", "J5"))
def d5_import_dedup(spark, sf):
    """Import of the period sheets against a merged sheet that lacks half of their incidents: canonical rows, then two anti-joins."""
    cl = V.cleaned(spark, sf)
    existing = I.event_identity(cl.where((F.col("sheet_ord") == 0) & (F.col("row_id") % 10 != 0)), K)
    incoming = I.event_identity(cl.where(F.col("sheet_ord") == 1), K)
    added = I.skip_existing(incoming, existing)
    n_in = incoming.agg(F.count_if("is_canonical_event_record").alias("n_incoming_canonical"))
    n_add = added.agg(F.count(F.lit(1)).alias("n_added"))
    return n_in.crossJoin(n_add)


# --- resources and ranks -------------------------------------------------------

def _cats_text_spark():
    m = R.equipment_map(F.col("equipment"))
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)),
                                    lambda k: F.concat(k, F.lit("="), m[k].cast("string"))), ";")


def _cats_text_sql():
    return ("array_to_string(list_transform(list_sort(list_distinct(list_filter(_cats, lambda x: x IS NOT NULL))),\n"
            "  lambda k: k || '=' || cast(len(list_filter(_cats, lambda x: x = k)) AS varchar)), ';')")


_CATS = R.normative_categories()


@register("r1_equipment_categories", sql=lambda: _w(V.sql_stage1() + [B.parsed("stage1")],
          f"SELECT {KS}, {_cats_text_sql()} AS equipment_categories FROM parsed"), ids=("R1",))
def r1_equipment_categories(spark, sf):
    """Equipment text -> category counts (code table first, then ordered abbreviations)."""
    return V.stage1(spark, sf).select(*K, _cats_text_spark().alias("equipment_categories"))


@register("r2_parse_diagnostics", sql=lambda: _w(V.sql_stage1() + [B.parsed("stage1")],
          f"SELECT {KS}, resource_parse_confidence, {B.flags_json()} AS resource_parse_flags, "
          "CAST(resource_count_parsed AS INTEGER) AS resource_vector_sum, resource_count_declared, "
          "CAST(resource_count_parsed AS INTEGER) AS resource_count_parsed, resource_count_conflict FROM parsed"),
          ids=("R2",))
def r2_parse_diagnostics(spark, sf):
    """Recognised ratio, flags, declared/parsed counts, conflict delta and confidence."""
    d = RS.parse_diagnostics(V.stage1(spark, sf))
    return d.select(*K, "resource_parse_confidence", R.json_string_list(F.col("resource_parse_flags"))
                    .alias("resource_parse_flags"), "resource_vector_sum", "resource_count_declared",
                    "resource_count_parsed", "resource_count_conflict")


@register("r3_r4_resource_vectors", sql=lambda: _w(V.sql_stage1() + [B.parsed("stage1")],
          f"SELECT {KS}, " + ", ".join(f"_n_{k} AS n_{k}" for k in _CATS) + ", "
          + ", ".join(f"round(_v_{k}, 6) AS v_{k}" for k in _CATS) + " FROM parsed"), ids=("R3", "R4", "R5"))
def r3_r4_resource_vectors(spark, sf):
    """Dense counts over the normative categories and their capped normalisation."""
    d = RS.parse_diagnostics(V.stage1(spark, sf))
    return d.select(*K, *[F.col("resource_vector")[i].alias(f"n_{k}") for i, k in enumerate(_CATS)],
                    *[F.round(F.col("equipment_vector_norm")[i], 6).alias(f"v_{k}") for i, k in enumerate(_CATS)])


@register("r6_unparsed_report", sql=lambda: _w(V.sql_stage1() + [B.parsed("stage1")],
          "SELECT equipment, resource_parse_confidence, resource_parse_flags, count FROM ("
          "SELECT equipment, resource_parse_confidence, coalesce(array_to_string(list_filter([CASE WHEN _f_missing THEN "
          f"{B.q(R.FLAG_MISSING)} END, CASE WHEN _f_partial THEN {B.q(R.FLAG_PARTIAL)} END, CASE WHEN _f_conflict THEN "
          f"{B.q(R.FLAG_CONFLICT)} END], lambda x: x IS NOT NULL), ','), '') AS resource_parse_flags, count(*) AS count "
          "FROM parsed WHERE NOT (resource_parse_confidence >= 1.0 AND NOT (_f_missing OR _f_partial OR _f_conflict)) "
          "GROUP BY ALL) ORDER BY count DESC, equipment ASC NULLS FIRST, resource_parse_confidence, resource_parse_flags LIMIT 10"),
          ids=("R6", "T2"))
def r6_unparsed_report(spark, sf):
    """Top-10 equipment strings that did not parse cleanly (a top-N report)."""
    return RS.unparsed_report(V.stage1(spark, sf), top_n=10)


@register("r7_nearest_rank", sql=lambda: _w(V.sql_stage1() + [B.parsed("stage1")] +
          [B.ranked("parsed").replace("coalesce(is_canonical_event_record, true)", "true")],
          f"SELECT {KS}, _near_rank AS rank, round(_near_dist, 6) AS distance FROM ranked"), ids=("R7", "J7"))
def r7_nearest_rank(spark, sf):
    """Nearest normative prototype in normalised space (no parse-quality gating)."""
    d = RS.parse_diagnostics(V.stage1(spark, sf))
    d = d.select(*K, R.nearest_from_norm(F.col("equipment_vector_norm"), F.col("_vtotal")).alias("near"))
    return d.select(*K, F.col("near.rank").alias("rank"), F.round("near.distance", 6).alias("distance"))


@register("r8_count_proxy_rank", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, CASE WHEN equipment_count IS NULL OR equipment_count < 1 THEN NULL WHEN equipment_count = 1 THEN 1.0 "
          "WHEN equipment_count = 2 THEN 1.5 WHEN equipment_count = 3 THEN 2.0 WHEN equipment_count = 4 THEN 3.0 "
          "WHEN equipment_count = 5 THEN 4.0 ELSE 5.0 END AS rank, CASE WHEN equipment_count IS NULL OR equipment_count < 1 "
          "THEN NULL WHEN equipment_count IN (1, 2, 3, 4, 5) THEN 0.0 ELSE round((equipment_count - 5) * 0.1, 6) END AS distance "
          "FROM stage1"), ids=("R8",))
def r8_count_proxy_rank(spark, sf):
    """Count proxy: 1->1, 2->1.5, 3->2, 4->3, 5->4, else 5 with 0.1 per extra unit."""
    p = R.rank_by_count("equipment_count")
    return V.stage1(spark, sf).select(*K, p["rank"].alias("rank"), F.round(p["distance"], 6).alias("distance"))


@register("r9_assign_rank", sql=lambda: _w(V.sql_labelled(),
          f"SELECT {KS}, rank_tz, round(rank_distance, 6) AS rank_distance, rank_label_source, usable_for_training, "
          "resource_parse_flags_json AS rank_quality_flags FROM labelled"), ids=("R9", "R5"))
def r9_assign_rank(spark, sf):
    """Vector rank with parse gating, label source, JSON flags and training usability."""
    return V.labelled(spark, sf).select(*K, "rank_tz", F.round("rank_distance", 6).alias("rank_distance"),
                                        "rank_label_source", "usable_for_training", "rank_quality_flags")


@register("r9_count_proxy_labels", sql=lambda: _w(V.sql_identified(),
          f"SELECT {KS}, CASE WHEN equipment_count IS NULL OR equipment_count < 1 THEN NULL WHEN equipment_count = 1 THEN 1.0 "
          "WHEN equipment_count = 2 THEN 1.5 WHEN equipment_count = 3 THEN 2.0 WHEN equipment_count = 4 THEN 3.0 "
          "WHEN equipment_count = 5 THEN 4.0 ELSE 5.0 END AS rank_tz, "
          "CASE WHEN equipment_count >= 1 THEN 'proxy_bootstrap' END AS rank_label_source, "
          "coalesce(is_canonical_event_record, true) AND coalesce(equipment_count >= 1, false) AS usable_for_training, "
          "CASE WHEN equipment_count IS NULL OR equipment_count < 1 THEN '[\"missing_resources\"]' END AS rank_quality_flags "
          "FROM ident"), ids=("R9", "R8"))
def r9_count_proxy_labels(spark, sf):
    """Count-proxy labelling mode of the rank assignment."""
    return RS.assign_rank(V.identified(spark, sf), target="count_proxy").select(
        *K, "rank_tz", "rank_label_source", "usable_for_training", "rank_quality_flags")


def _r10_sql():
    return _w(V.sql_labelled(),
              "SELECT rank_tz AS rank, count(*) AS n, count_if(usable_for_training) AS n_trainable, "
              "sum(count(*)) OVER () AS total, round(count(*) / sum(count(*)) OVER (), 6) AS share, "
              "min(rank_tz) OVER () AS min_rank, max(rank_tz) OVER () AS max_rank FROM labelled GROUP BY rank_tz")


def rank_distribution_with_trainable(df):
    from pyspark.sql import Window
    g = df.groupBy(F.col("rank_tz").alias("rank")).agg(F.count(F.lit(1)).alias("n"),
                                                       F.count_if("usable_for_training").alias("n_trainable"))
    w = Window.partitionBy()  # over <= 7 grouped rows
    return g.select("rank", "n", "n_trainable", F.sum("n").over(w).alias("total"),
                    F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"),
                    F.min("rank").over(w).alias("min_rank"), F.max("rank").over(w).alias("max_rank"))


@register("r10_rank_distribution", sql=_r10_sql, ids=("R10",))
def r10_rank_distribution(spark, sf):
    """Flagship: incidents per vector rank (nulls included), trainable count, shares, min/max."""
    return rank_distribution_with_trainable(V.labelled(spark, sf))


@register("r11_rank_from_resources", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, CASE WHEN equipment_count IS NULL THEN 1.0 ELSE "
          "CASE " + " ".join(
              f"WHEN " + " AND ".join(f"abs(equipment_count - {float(r[5])}) <= abs(equipment_count - {float(o[5])})"
                                     for o in R.NORMATIVES if o[4] > r[4]) + f" THEN {float(r[0])}"
              if r[4] < 6 else f"ELSE {float(r[0])}" for r in R.NORMATIVES) + " END END AS rank FROM stage1"),
          ids=("R11",))
def r11_rank_from_resources(spark, sf):
    """Rank whose minimum equipment count is nearest the count (ties -> lower; null -> 1)."""
    return V.stage1(spark, sf).select(*K, R.rank_from_resources("equipment_count").alias("rank"))


@register("r14_rank_descriptions", sql=lambda: _w(V.sql_labelled(),
          "SELECT rank_tz AS rank, count(*) AS n, CASE " + " ".join(
              f"WHEN rank_tz = {r[0]} THEN {B.q(r[1])}" for r in R.NORMATIVES) + " END AS label, "
          "CASE " + " ".join(f"WHEN rank_tz = {r} THEN {B.q(t)}" for r, t in R.RANK_DESCRIPTIONS)
          + " WHEN rank_tz IS NOT NULL THEN 'Ранг ' || cast(rank_tz AS varchar) END AS description "
          "FROM labelled GROUP BY rank_tz"), ids=("R14", "J6"))
def r14_rank_descriptions(spark, sf):
    """Rank label and description lookup on the rank distribution."""
    g = V.labelled(spark, sf).groupBy(F.col("rank_tz").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("rank", "n", R.rank_label("rank").alias("label"), R.rank_description("rank").alias("description"))


# --- contract checks (P14, P17) ------------------------------------------------

_P14_RULES = ["dup_flag", "flag_date_outlier", "flag_negative_values", "flag_floor_inconsistent"]


def _p14_sql():
    dup = (f"row_number() OVER (PARTITION BY {', '.join(S.EN_COLS)} ORDER BY {KS}) > 1")
    case = " ".join(f"WHEN coalesce({c}, false) THEN '{c}'" for c in ["dup_flag"] + _P14_RULES[1:])
    steps = ", ".join(f"({i + 1}, '{r}')" for i, r in enumerate(_P14_RULES))
    return _w(V.sql_stage1(),
              f", d AS (SELECT *, {dup} AS dup_flag FROM stage1),\n"
              f"f AS (SELECT CASE {case} END AS rule FROM d),\n"
              f"r AS (SELECT * FROM (VALUES {steps}) t(step, rule))\n"
              "SELECT r.step, r.rule, count(f.rule) AS removed, "
              "(SELECT count(*) FROM d) - sum(count(f.rule)) OVER (ORDER BY r.step) AS remaining "
              "FROM r LEFT JOIN f ON f.rule = r.rule GROUP BY r.step, r.rule")


@register("p14_rejection_log", sql=_p14_sql, ids=("P14", "D1"))
def p14_rejection_log(spark, sf):
    """Removal log of the four ordered rejection rules (each counted on the survivors of the earlier ones)."""
    from ..operators import contract as CT
    flagged = I.full_row_duplicates(V.stage1(spark, sf), S.EN_COLS, K)
    return CT.apply_rejection_rules(flagged, CT.default_rejection_rules())[1]


def _missing_sql(fields):
    parts = ", ".join(f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN '{c}' END" for c in fields)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


@register("p17_stage_requirements", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, {_missing_sql(['t_arrival_min'])} AS missing_arrival, "
          f"{_missing_sql(['t_arrival_min', 't_first_hose_min'])} AS missing_first_hose FROM stage1"),
          ids=("P17",))
def p17_stage_requirements(spark, sf):
    """Required times missing per row for the arrival and first-hose stages."""
    from ..operators import contract as CT
    return V.stage1(spark, sf).select(*K, CT.missing_for_stage(S.STAGE_ARRIVAL).alias("missing_arrival"),
                                      CT.missing_for_stage(S.STAGE_FIRST_HOSE).alias("missing_first_hose"))
