"""Registered queries: profiles and distribution statistics (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import feature_sets as FS
from .. import schema as S
from ..operators import profiling as P
from ..operators.cleaning import period_group
from ..session import written
from . import incidents as V
from . import sqlblocks as B
from .registry import register

K = ["sheet_ord", "row_id"]
KS = "sheet_ord, row_id"
NUM = ["building_floors", "fire_floor", "distance_to_station", "fatalities", "injuries", "direct_damage"]


def _w(chain, select: str) -> str:
    return B.with_(*chain) + select


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register("a2_missing_report", sql=lambda: _w(V.sql_cleaned(), "SELECT \"column\", missing_pct FROM (" + " UNION ALL ".join(
          f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 1) AS missing_pct FROM cleaned"
          for c in ["region", "fire_date", "settlement_type", "building_floors", "fire_floor", "distance_to_station",
                    "fatalities", "injuries", "direct_damage", "t_detect_min", "t_arrival_min", "t_first_hose_min",
                    "equipment", "equipment_count", "source_item_code", "risk_category_code", "severity_score"])
          + ") ORDER BY missing_pct DESC, \"column\" LIMIT 20"), ids=("A2", "T2"))
def a2_missing_report(spark, sf):
    """Missing % per column, highest first (a top-20 report)."""
    cols = ["region", "fire_date", "settlement_type", "building_floors", "fire_floor", "distance_to_station",
            "fatalities", "injuries", "direct_damage", "t_detect_min", "t_arrival_min", "t_first_hose_min",
            "equipment", "equipment_count", "source_item_code", "risk_category_code", "severity_score"]
    return P.missing_report(V.cleaned(spark, sf), cols, 20)


def _a3_sql():
    parts = [f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
             f"min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
             f"round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM stage1" for c in NUM]
    return _w(V.sql_stage1(), " UNION ALL ".join(parts))


@register("a3_numeric_summary", sql=_a3_sql, ids=("A3",))
def a3_numeric_summary(spark, sf):
    """count, mean, sample std, min, exact quartiles, max per numeric column."""
    d = P.describe(V.stage1(spark, sf), NUM)
    return d.select("column", "count", *_r6(["mean", "std"]), "min", *_r6(["q25", "q50", "q75"]), "max")


def _a4_sql(by: str | None):
    cols = ["building_floors", "distance_to_station", "direct_damage", "t_detect_min"]
    g = f", {by}" if by else ""
    gsel = f"{by}, " if by else ""
    where = f"WHERE {by} IS NOT NULL" if by else ""
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column, {gsel}count({c}) AS count, count_if({c} IS NULL) AS missing, round(avg({c}), 6) AS mean, "
            f"round(stddev_pop({c}), 6) AS std, round(quantile_cont({c}, 0.5), 6) AS median, "
            f"round(quantile_cont({c}, 0.05), 6) AS q05, round(quantile_cont({c}, 0.25), 6) AS q25, "
            f"round(quantile_cont({c}, 0.75), 6) AS q75, round(quantile_cont({c}, 0.95), 6) AS q95, "
            f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, "
            f"round((SELECT quantile_cont(abs(x.{c} - m.med), 0.5) FROM src x, (SELECT quantile_cont({c}, 0.5) AS med "
            f"FROM src y WHERE {('y.' + by + ' = s.' + by) if by else 'true'}) m WHERE {('x.' + by + ' = s.' + by) if by else 'true'}), 6) AS mad, "
            f"min({c}) AS min, max({c}) AS max FROM src s {where} GROUP BY ALL")
    return parts


def _robust_cols():
    return ["building_floors", "distance_to_station", "direct_damage", "t_detect_min"]


def _robust_out(d, by):
    return d.select("column", *by, "count", "missing", *_r6(["mean", "std", "median", "q05", "q25", "q75", "q95", "iqr",
                                                             "mad"]), "min", "max")


@register("a4_robust_summary", sql=lambda: _w(V.sql_stage1() + ["src AS (SELECT * FROM stage1)"],
          " UNION ALL ".join(_a4_sql(None))), ids=("A4",))
def a4_robust_summary(spark, sf):
    """count, missing, mean, population std, median, q05/25/75/95, IQR, MAD, min, max."""
    return _robust_out(P.robust_summary(V.stage1(spark, sf), _robust_cols()), [])


@register("a11_rank_conditional_profile", sql=lambda: _w(V.sql_labelled() + ["src AS (SELECT * FROM labelled)"],
          " UNION ALL ".join(_a4_sql("rank_tz"))), ids=("A11",))
def a11_rank_conditional_profile(spark, sf):
    """Robust summary per vector rank (labelled rows only)."""
    lab = V.labelled(spark, sf).where(F.col("rank_tz").isNotNull())
    return _robust_out(P.robust_summary(lab, _robust_cols(), ["rank_tz"]), ["rank_tz"])


@register("a5_value_counts", sql=lambda: _w(V.sql_stage1(),
          "SELECT value, count, share, pos FROM (SELECT value, count, round(count / sum(count) OVER (), 6) AS share, "
          "row_number() OVER (ORDER BY count DESC, value) AS pos FROM (SELECT coalesce(cast(region_code AS varchar), "
          "'__missing__') AS value, count(*) AS count FROM stage1 GROUP BY 1)) WHERE pos <= 10"), ids=("A5", "T2"))
def a5_value_counts(spark, sf):
    """Top-10 region codes with ``__missing__`` and shares (ties by value)."""
    return P.value_counts(V.stage1(spark, sf), "region_code", 10)


@register("a5_value_counts_by_rank", sql=lambda: _w(V.sql_labelled(),
          "SELECT rank_tz, value, count, share, pos FROM (SELECT rank_tz, value, count, round(count / sum(count) OVER "
          "(PARTITION BY rank_tz), 6) AS share, row_number() OVER (PARTITION BY rank_tz ORDER BY count DESC, value) AS pos "
          "FROM (SELECT rank_tz, coalesce(cast(fire_protection_code AS varchar), '__missing__') AS value, count(*) AS count "
          "FROM labelled GROUP BY 1, 2)) WHERE pos <= 3"), ids=("A5", "A11", "W4"))
def a5_value_counts_by_rank(spark, sf):
    """Top-3 fire-protection codes per rank (first N per group)."""
    return P.value_counts(V.labelled(spark, sf), "fire_protection_code", 3, by=["rank_tz"])


@register("a6_max_row", sql=lambda: _w(V.sql_stage1(),
          "SELECT 'direct_damage' AS column, direct_damage AS max_value, region, fire_date, object_name, source_sheet, "
          f"sheet_ord, row_id FROM stage1 WHERE direct_damage IS NOT NULL ORDER BY direct_damage DESC, {KS} LIMIT 1"),
          ids=("A6",))
def a6_max_row(spark, sf):
    """The record holding the maximum damage (one aggregate with min_by)."""
    return P.max_row(V.stage1(spark, sf), "direct_damage",
                     ["region", "fire_date", "object_name", "source_sheet", "sheet_ord", "row_id"], K)


_FLAGS = ["flag_date_outlier", "flag_floor_outlier", "flag_distance_outlier", "flag_floor_inconsistent",
          "flag_negative_values", "flag_damage_outlier", "flag_time_invalid", "flag_missing_outputs"]


@register("a7_flag_rates", sql=lambda: _w(V.sql_cleaned(), " UNION ALL ".join(
          f"SELECT '{f}' AS flag, count_if({f}) AS count, round(avg(CAST({f} AS DOUBLE)), 6) AS rate, "
          f"round(avg(CAST(({' OR '.join(_FLAGS)}) AS DOUBLE)), 6) AS any_flag_share FROM cleaned" for f in _FLAGS)),
          ids=("A7",))
def a7_flag_rates(spark, sf):
    """Count and rate of each quality flag and the share of rows with any flag."""
    return P.flag_rates(V.cleaned(spark, sf), _FLAGS)


_CORR = ["building_floors", "fire_floor", "distance_to_station", "direct_damage", "t_detect_min", "t_report_min",
         "equipment_count", "nozzle_count"]


@register("a8_pearson_matrix", sql=lambda: _w(V.sql_stage1(), " UNION ALL ".join(
          f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0.0), 4) AS r FROM stage1"
          for a in _CORR for b in _CORR)), ids=("A8",))
def a8_pearson_matrix(spark, sf):
    """Pairwise-complete Pearson matrix in one aggregate (null -> 0, round 4)."""
    return P.pearson_matrix(V.stage1(spark, sf), _CORR)


@register("a9_spearman", sql=lambda: _w(V.sql_labelled() + [
          "sp AS (SELECT equipment_count AS a, rank_tz AS b FROM labelled WHERE equipment_count IS NOT NULL AND rank_tz IS NOT NULL)",
          "spr AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, "
          "rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM sp)"],
          "SELECT round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM spr"), ids=("A9",))
def a9_spearman(spark, sf):
    """Spearman rho between declared equipment count and vector rank (exact average ranks)."""
    r = P.spearman(V.labelled(spark, sf), "equipment_count", "rank_tz")
    return r.select(F.round("spearman", 6).alias("spearman"), "n")


@register("a10_crosstab", sql=lambda: _w(V.sql_labelled() + [
          "cv AS (SELECT coalesce(cast(region_code AS varchar), '__missing__') AS value, rank_tz FROM labelled)",
          "tops AS (SELECT value FROM cv GROUP BY value ORDER BY count(*) DESC, value LIMIT 20)",
          "cells AS (SELECT value, rank_tz AS target, count(*) AS n FROM cv WHERE rank_tz IS NOT NULL AND value IN "
          "(SELECT value FROM tops) GROUP BY 1, 2)"],
          "SELECT value, target, round(n / sum(n) OVER (PARTITION BY value), 4) AS share FROM cells"), ids=("A10",))
def a10_crosstab(spark, sf):
    """Row-normalised crosstab: top-20 region codes x vector rank."""
    return P.crosstab_share(V.labelled(spark, sf), "region_code", "rank_tz", 20)


def _a14_sql():
    return _w(V.sql_stage1() + ["mm AS (SELECT min(direct_damage_log) AS lo, max(direct_damage_log) AS hi FROM stage1)"],
              "SELECT bin, round(lo + bin * ((hi - lo) / 50), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / 50), 6) AS upper, "
              "count(*) AS count FROM (SELECT CAST(least(floor((direct_damage_log - lo) / ((hi - lo) / 50)), 49) AS INTEGER) "
              "AS bin, lo, hi FROM stage1, mm WHERE direct_damage_log IS NOT NULL) GROUP BY bin, lo, hi")


@register("a14_histogram", sql=_a14_sql, ids=("A14",))
def a14_histogram(spark, sf):
    """50 equal-width bins of log1p(damage) between its min and max."""
    return P.histogram(V.stage1(spark, sf), "direct_damage_log", 50)


@register("a14_box_by_period", sql=lambda: _w(V.sql_stage1() + [
          "bx AS (SELECT CASE WHEN year IS NULL THEN NULL WHEN year <= 2008 THEN '<=2008' ELSE '>2008' END AS period_group, "
          "direct_damage_log AS v FROM stage1)"],
          "SELECT period_group, count(*) AS count, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, "
          "round(quantile_cont(v, 0.75), 6) AS q3, round(greatest(min(v), quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - "
          "quantile_cont(v, 0.25))), 6) AS whisker_low, round(least(max(v), quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - "
          "quantile_cont(v, 0.25))), 6) AS whisker_high FROM bx WHERE period_group IS NOT NULL AND v IS NOT NULL GROUP BY period_group"),
          ids=("A14", "P13"))
def a14_box_by_period(spark, sf):
    """Box statistics of log1p(damage) by period group (exact quartiles per group)."""
    df = V.stage1(spark, sf).select(period_group("year").alias("period_group"), "direct_damage_log")
    b = P.box_stats(df, "direct_damage_log", "period_group")
    return b.select("period_group", "count", *_r6(["q1", "median", "q3", "whisker_low", "whisker_high"]))


@register("a15_counts_by_period", sql=lambda: _w(V.sql_stage1(),
          "SELECT 'year' AS dim, cast(year AS varchar) AS value, count(*) AS n FROM stage1 GROUP BY 2 UNION ALL "
          "SELECT 'month', cast(month AS varchar), count(*) FROM stage1 GROUP BY 2 UNION ALL "
          "SELECT 'sheet', source_sheet, count(*) FROM stage1 GROUP BY 2 UNION ALL "
          f"SELECT 'period', {B.sheet_period('source_sheet')}, count(*) FROM stage1 GROUP BY 2"), ids=("A15",))
def a15_counts_by_period(spark, sf):
    """Row counts by year, month, source sheet and sheet period (one grouping-sets aggregate)."""
    from ..operators.cleaning import sheet_period
    df = V.stage1(spark, sf).select(F.col("year").cast("string").alias("year"), F.col("month").cast("string").alias("month"),
                                    "source_sheet", sheet_period("source_sheet").alias("period"))
    dims = ["year", "month", "source_sheet", "period"]
    names = {"year": "year", "month": "month", "source_sheet": "sheet", "period": "period"}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(names[d]).alias("dim"), F.col(d).alias("value"))
                                         for d in dims])).alias("s")).select("s.dim", "s.value")
    return long.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


@register("a17_robust_scale", sql=lambda: _w(V.sql_stage1() + ["src AS (SELECT * FROM stage1)", "rs AS (" +
          " UNION ALL ".join(_a4_sql(None)) + ")"],
          "SELECT \"column\", round(CASE WHEN q75 <> q25 AND (q75 - q25) / 1.349 > 0 THEN (q75 - q25) / 1.349 "
          "WHEN mad * 1.4826 > 0 THEN mad * 1.4826 WHEN std > 0 THEN std ELSE 1.0 END, 6) AS scale FROM rs"), ids=("A17",))
def a17_robust_scale(spark, sf):
    """Robust scale per column: IQR/1.349, else 1.4826*MAD, else std, else 1."""
    s = P.robust_summary(V.stage1(spark, sf), _robust_cols())
    s = s.select("column", *_r6(["std", "q25", "q75", "mad"]), "count", "missing", "mean", "median", "q05", "q95", "iqr",
                 "min", "max")
    return P.robust_scale(s).select("column", F.round("scale", 6).alias("scale"))


_INT = ["building_floors", "distance_to_station", "direct_damage", "equipment_count", "t_detect_min", "severity_score"]


@register("a18_integer_like", sql=lambda: _w(V.sql_stage1(), " UNION ALL ".join(
          f"SELECT '{c}' AS column, coalesce(bool_and(abs({c} - round({c})) <= 1e-8), false) AND count({c}) > 0 AS integer_like FROM stage1"
          for c in _INT)), ids=("A18",))
def a18_integer_like(spark, sf):
    """Integer-like test per numeric column (one aggregate)."""
    return P.integer_like(V.stage1(spark, sf), _INT)


# --- splits (M1, M2) and evaluation over a deterministic prediction table -------

from ..operators import evaluation as E  # noqa: E402
from ..operators import splits as SP  # noqa: E402
from ..functions import resources as RF  # noqa: E402


def _hash_u(key: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(md5({key} || '|{seed}'), 1, 13)) AS BIGINT) / {float(16 ** 13)})"


def _split_sql(protocol: str) -> str:
    lab = V.sql_labelled()
    if protocol == "group_shuffle":
        return _w(lab + ["g AS (SELECT DISTINCT coalesce(event_id, '__missing__') AS g FROM labelled)",
                         f"gu AS (SELECT g, {_hash_u('g')} AS u FROM g)",
                         "cutk AS (SELECT ceil(count(*) * 0.25) AS k FROM gu)",
                         "tg AS (SELECT g FROM (SELECT g, row_number() OVER (ORDER BY u, g) AS r FROM gu), cutk WHERE r <= k)"],
                  f"SELECT {KS}, coalesce(event_id, '__missing__') IN (SELECT g FROM tg) AS is_test FROM labelled")
    if protocol == "temporal_holdout":
        return _w(lab + ["n AS (SELECT greatest(1, CAST(floor(count(*) * 0.75) AS BIGINT)) AS split_at FROM labelled)"],
                  f"SELECT {KS}, r > split_at AS is_test FROM (SELECT {KS}, row_number() OVER (ORDER BY fire_date ASC NULLS LAST, "
                  f"{KS}) AS r FROM labelled), n")
    if protocol == "source_holdout":
        return _w(lab, f"SELECT {KS}, coalesce(source_sheet = (SELECT max(source_sheet) FROM labelled), false) AS is_test FROM labelled")
    if protocol == "row_random_legacy":
        key = "coalesce(CAST(rank_tz AS varchar), '') || '#' || concat_ws('|', CAST(sheet_ord AS varchar), CAST(row_id AS varchar))"
        return _w(lab, f"SELECT {KS}, {_hash_u(key)} < 0.25 AS is_test FROM labelled")
    if protocol == "group_kfold":
        return _w(lab + ["nf AS (SELECT greatest(2, least(5, count(DISTINCT coalesce(event_id, '__missing__')))) AS f FROM labelled)"],
                  f"SELECT {KS}, floor({_hash_u(chr(99) + 'oalesce(event_id, ' + chr(39) + '__missing__' + chr(39) + ')')} * f) = 0 AS is_test "
                  "FROM labelled, nf")
    raise ValueError(protocol)


def _split_rows(spark, sf):
    """What splits read, written once: a protocol reads its rows for the cut and again for the sides."""
    return written(V.labelled(spark, sf).select(*K, "event_id", "fire_date", "source_sheet", "rank_tz"), "labelled")


def _split_build(protocol: str):
    def build(spark, sf):
        lab = _split_rows(spark, sf) if protocol != SP.ROW_RANDOM else V.labelled(spark, sf)
        return SP.split(lab, protocol, 0.25, 42, label_col="rank_tz").select(*K, "is_test")
    build.__doc__ = f"{protocol} split (hash of key and seed; exact test-group count via order statistic)."
    return build


for _p in ("group_shuffle", "group_kfold", "temporal_holdout", "source_holdout", "row_random_legacy"):
    register(f"m1_split_{_p}", sql=(lambda p=_p: _split_sql(p)), ids=("M1", "W5"))(_split_build(_p))


def _m2_sql():
    base = _split_sql("group_shuffle")
    marker = "SELECT sheet_ord, row_id, coalesce(event_id, '__missing__') IN"
    head, tail = base.split(marker, 1)
    return (head.rstrip() + ",\nsp AS (" + marker + tail + "),\n"
            "j AS (SELECT l.*, sp.is_test FROM labelled l JOIN sp USING (sheet_ord, row_id)),\n"
            "ps AS (SELECT DISTINCT event_id AS g, is_test FROM j WHERE event_id IS NOT NULL AND event_id <> ''),\n"
            "ov AS (SELECT g, count(DISTINCT is_test) AS sides, max(CAST(is_test AS INTEGER)) AS in_test FROM ps GROUP BY g)\n"
            "SELECT 'group_shuffle' AS split_protocol, CASE WHEN count_if(in_test = 1) > 0 THEN round(count_if(sides = 2) / "
            "count_if(in_test = 1), 6) ELSE 0.0 END AS event_overlap_rate, count_if(sides = 2 OR in_test = 0) AS train_event_count, "
            "count_if(in_test = 1) AS test_event_count, (SELECT min(fire_date) FILTER (WHERE NOT is_test) FROM j) AS train_date_min, "
            "(SELECT max(fire_date) FILTER (WHERE NOT is_test) FROM j) AS train_date_max, (SELECT min(fire_date) FILTER (WHERE is_test) "
            "FROM j) AS test_date_min, (SELECT max(fire_date) FILTER (WHERE is_test) FROM j) AS test_date_max, "
            "(SELECT count_if(NOT is_test) FROM j) AS train_rows, (SELECT count_if(is_test) FROM j) AS test_rows, "
            "true AS production_safe FROM ov")


@register("m2_split_passport", sql=_m2_sql, ids=("M2", "U2"))
def m2_split_passport(spark, sf):
    """Split passport of the group split: event overlap (must be 0), event counts, date ranges."""
    s = written(SP.split(_split_rows(spark, sf), "group_shuffle", 0.25, 42), "split")
    return SP.passport(s, "group_shuffle")


# prediction table ---------------------------------------------------------------

def _pred_sql_ctes():
    mins = [float(r[5]) for r in sorted(RF.NORMATIVES, key=lambda r: r[4])]
    s = "[" + ", ".join(f"coalesce(-abs(CAST(equipment_count AS DOUBLE) - {m}), 0.0)" for m in mins) + "]"
    return V.sql_labelled() + [
        f"bp0 AS (SELECT {KS}, CASE rank_tz WHEN 1.0 THEN 1 WHEN 1.5 THEN 2 WHEN 2.0 THEN 3 WHEN 3.0 THEN 4 WHEN 4.0 THEN 5 "
        f"WHEN 5.0 THEN 6 END AS y, {s} AS _s FROM labelled)",
        "bp1 AS (SELECT *, list_transform(_s, lambda v: exp(v - list_max(_s))) AS _e FROM bp0)",
        "pred AS (SELECT sheet_ord, row_id, y, list_position(_s, list_max(_s)) AS yhat, "
        "list_transform(_e, lambda v: v / list_reduce(_e, lambda a, b: a + b)) AS probability FROM bp1 WHERE y IS NOT NULL)",
        "cm AS (SELECT y, yhat, count(*) AS n FROM pred GROUP BY y, yhat)",
        "lbl AS (SELECT y AS cls FROM cm UNION SELECT yhat FROM cm)",
        "pc AS (SELECT cls, coalesce((SELECT sum(n) FROM cm WHERE y = cls), 0) AS support, "
        "coalesce((SELECT sum(n) FROM cm WHERE yhat = cls), 0) AS predicted, "
        "coalesce((SELECT sum(n) FROM cm WHERE y = cls AND yhat = cls), 0) AS tp FROM lbl)",
        "pc2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
        "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc)",
        "pc3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc2)"]


_RANK_CASE = "CASE {c} WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 WHEN 3 THEN 2.0 WHEN 4 THEN 3.0 WHEN 5 THEN 4.0 WHEN 6 THEN 5.0 END"


def _pred(spark, sf):
    return E.baseline_predictions(V.labelled(spark, sf), K)


@register("m12_prediction_table", sql=lambda: _w(_pred_sql_ctes(),
          "SELECT sheet_ord, row_id, y, yhat, list_transform(probability, lambda p: round(p, 6)) AS probability FROM pred"),
          ids=("M12",))
def m12_prediction_table(spark, sf):
    """Deterministic count-proxy predictions (class, softmax probabilities) joined on the row key."""
    p = _pred(spark, sf)
    return p.select(*K, "y", "yhat", F.transform("probability", lambda x: F.round(x, 6)).alias("probability"))


def _m12_sql():
    pos = ("1 + len(list_filter(range(1, 7), lambda j: probability[j] > probability[y] OR "
           "(probability[j] = probability[y] AND j < y)))")
    yr, pr = _RANK_CASE.format(c="y"), _RANK_CASE.format(c="yhat")
    return _w(_pred_sql_ctes() + [
        f"rw AS (SELECT y, yhat, list_max(probability) AS conf, {yr} AS yr, {pr} AS pr, {pos} AS pos FROM pred)",
        "ece AS (SELECT sum(k * abs(a - c)) / sum(k) AS calibration_error FROM (SELECT least(floor(conf * 10), 9) AS b, "
        "count(*) AS k, avg(conf) AS c, avg(CAST(y = yhat AS DOUBLE)) AS a FROM rw GROUP BY 1))",
        "rs AS (SELECT avg(CAST(y = yhat AS DOUBLE)) AS accuracy, avg(CAST(pos <= 2 AS DOUBLE)) AS top_2_accuracy, "
        "avg(CAST(pos <= 3 AS DOUBLE)) AS top_3_accuracy, avg(abs(yr - pr)) AS ordinal_mae, "
        "avg(CAST(pr < yr AS DOUBLE)) AS under_dispatch_rate, count(*) AS test_size FROM rw)",
        "cs AS (SELECT avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted, "
        "sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, "
        "count(*) AS n_classes FROM pc3)",
        "one AS (SELECT * FROM rs, cs, ece)"],
        "SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (UNPIVOT one ON accuracy, f1_macro, f1_weighted, "
        "precision, recall, top_2_accuracy, top_3_accuracy, ordinal_mae, under_dispatch_rate, calibration_error, "
        "CAST(test_size AS DOUBLE) AS test_size, CAST(n_classes AS DOUBLE) AS n_classes INTO NAME metric VALUE value)")


@register("m12_metric_passport", sql=_m12_sql, ids=("M12",))
def m12_metric_passport(spark, sf):
    """Accuracy, F1 macro/weighted, weighted P/R, top-2/3, ordinal MAE, under-dispatch, 10-bin ECE."""
    return E.metric_passport(_pred(spark, sf))


@register("m12_per_class", sql=lambda: _w(_pred_sql_ctes(),
          f"SELECT cls, {_RANK_CASE.format(c='cls')} AS rank, support, predicted, tp, round(precision, 6) AS precision, "
          "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc3"), ids=("M12",))
def m12_per_class(spark, sf):
    """Per-class support, precision, recall and F1 (from the confusion matrix)."""
    p = E.per_class(_pred(spark, sf))
    return p.select("cls", "rank", "support", "predicted", "tp", *_r6(["precision", "recall", "f1"]))


@register("m12_confusion_matrix", sql=lambda: _w(_pred_sql_ctes(), "SELECT y, yhat, n FROM cm"), ids=("M12",))
def m12_confusion_matrix(spark, sf):
    """Confusion matrix as (actual class, predicted class, count)."""
    return E.confusion(_pred(spark, sf))


@register("m13_confusion_summary", sql=lambda: _w(_pred_sql_ctes() + [
          "tp3 AS (SELECT y, yhat, n, row_number() OVER (PARTITION BY y ORDER BY n DESC, yhat DESC) AS r FROM cm WHERE n > 0)",
          f"per AS (SELECT y, string_agg(CAST({_RANK_CASE.format(c='yhat')} AS varchar) || ':' || CAST(n AS varchar), ', ' ORDER BY r) "
          "AS cells FROM tp3 WHERE r <= 3 GROUP BY y)"],
          f"SELECT string_agg(CAST({_RANK_CASE.format(c='y')} AS varchar) || ' -> ' || cells, '; ' ORDER BY y) AS "
          "confusion_matrix_summary FROM per"), ids=("M13",))
def m13_confusion_summary(spark, sf):
    """Top-3 predicted ranks per actual rank as one text line."""
    return E.confusion_summary(_pred(spark, sf))


@register("t3_top_k", sql=lambda: _w(_pred_sql_ctes() + [
          "ex AS (SELECT sheet_ord, row_id, j AS cls, probability[j] AS p, row_number() OVER (PARTITION BY sheet_ord, row_id "
          "ORDER BY probability[j] DESC, j) AS position FROM pred, range(1, 7) r(j))"],
          f"SELECT sheet_ord, row_id, position, cls, {_RANK_CASE.format(c='cls')} AS rank, CASE cls "
          + " ".join(f"WHEN {i + 1} THEN {B.q(r[1])}" for i, r in enumerate(sorted(RF.NORMATIVES, key=lambda r: r[4])))
          + " END AS label, round(p, 6) AS probability FROM ex WHERE position <= 3"), ids=("T3",))
def t3_top_k(spark, sf):
    """Per-row top-3 ranks with probability and label."""
    return E.top_k(_pred(spark, sf), K, 3)


@register("m9_class_weights", sql=lambda: _w(V.sql_labelled(),
          "SELECT rank_tz AS cls, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight "
          "FROM labelled WHERE rank_tz IS NOT NULL GROUP BY rank_tz"), ids=("M9",))
def m9_class_weights(spark, sf):
    """Balanced class weights n / (k * n_c)."""
    w = E.class_weights(V.labelled(spark, sf), "rank_tz")
    return w.select("cls", "n_c", F.round("weight", 6).alias("weight"))


@register("m29_oversampling_plan", sql=lambda: _w(V.sql_labelled() + [
          "cc AS (SELECT CAST(CASE rank_tz WHEN 1.0 THEN 1 WHEN 1.5 THEN 2 WHEN 2.0 THEN 3 WHEN 3.0 THEN 4 WHEN 4.0 THEN 5 "
          "WHEN 5.0 THEN 6 END AS INTEGER) AS cls, count(*) AS n FROM labelled WHERE rank_tz IS NOT NULL GROUP BY 1)"],
          "SELECT cls, n, max(n) OVER () AS target FROM cc"), ids=("M29",))
def m29_oversampling_plan(spark, sf):
    """"not majority" plan: every class resampled up to the majority count."""
    lab = V.labelled(spark, sf).select(rank_to_class_col().alias("cls"))
    return E.oversampling_plan(lab, "cls")


def rank_to_class_col():
    from ..operators.features import rank_to_class
    return rank_to_class("rank_tz")


_SEG = ["building_floors", "distance_to_station"]


def _seg_cluster_spark():
    from ..operators.features import RESEARCH, cut
    return cut(F.col("building_floors").cast("double"), RESEARCH.floor_edges).cast("int")


def _seg_sql_ctes():
    from ..operators.features import RESEARCH
    from .sqlfeatures import cut as scut
    return V.sql_labelled() + [
        f"seg AS (SELECT building_floors, distance_to_station, rank_tz, CAST({scut('CAST(building_floors AS DOUBLE)', RESEARCH.floor_edges)} "
        "AS INTEGER) AS cluster FROM labelled WHERE building_floors IS NOT NULL AND distance_to_station IS NOT NULL)"]


def _m22_sql():
    return _w(_seg_sql_ctes() + [
        "cent AS (SELECT cluster, count(*) AS n, avg(building_floors) AS m1, avg(distance_to_station) AS m2 FROM seg GROUP BY cluster)",
        "gm AS (SELECT avg(building_floors) AS g1, avg(distance_to_station) AS g2 FROM seg)",
        "wi AS (SELECT s.cluster, sum(power(s.building_floors - c.m1, 2) + power(s.distance_to_station - c.m2, 2)) AS ss, "
        "avg(sqrt(power(s.building_floors - c.m1, 2) + power(s.distance_to_station - c.m2, 2))) AS sd FROM seg s JOIN cent c USING (cluster) GROUP BY s.cluster)",
        "cs AS (SELECT * FROM cent JOIN wi USING (cluster))",
        "dbr AS (SELECT a.cluster, max((a.sd + b.sd) / sqrt(power(a.m1 - b.m1, 2) + power(a.m2 - b.m2, 2))) AS r FROM cs a, cs b "
        "WHERE a.cluster <> b.cluster GROUP BY a.cluster)"],
        "SELECT (SELECT count(*) FROM cs) AS k, sum(n) AS n, round(sum(ss), 4) AS inertia, round((SELECT avg(r) FROM dbr), 6) AS davies_bouldin, "
        "round((sum(n * (power(m1 - g1, 2) + power(m2 - g2, 2))) / sum(ss)) * ((sum(n) - count(*)) / (count(*) - 1)), 4) AS calinski_harabasz "
        "FROM cs, gm")


@register("m22_cluster_validity", sql=_m22_sql, ids=("M22",))
def m22_cluster_validity(spark, sf):
    """Davies-Bouldin, Calinski-Harabasz and inertia of a floor-bin segmentation (two grouped passes)."""
    lab = V.labelled(spark, sf).where(F.col("building_floors").isNotNull() & F.col("distance_to_station").isNotNull())
    seg = lab.select(*_SEG, "rank_tz", _seg_cluster_spark().alias("cluster"))
    v = E.cluster_validity(seg, _SEG, "cluster")
    return v.select("k", "n", F.round("inertia", 4).alias("inertia"), F.round("davies_bouldin", 6).alias("davies_bouldin"),
                    F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


def _m23_sql():
    from .catalog_explore import _run_ctes
    return _w(_run_ctes(), "SELECT round(spearman, 6) AS spearman, round(purity, 6) AS purity, round(nmi, 6) AS nmi FROM rn WHERE run_id = 0")


@register("m23_rank_alignment", sql=_m23_sql, ids=("M23",))
def m23_rank_alignment(spark, sf):
    """Spearman, unweighted mean purity and NMI of the floor-bin segmentation against the severity rank."""
    from .catalog_explore import _labelled_segments
    seg = _labelled_segments(spark, sf).select("rank_ref", _seg_cluster_spark().alias("cluster"))
    a = E.rank_alignment(seg, "cluster", "rank_ref")
    return a.select(*[F.round(c, 6).alias(c) for c in ("spearman", "purity", "nmi")])


# production-safety gate (M36) ------------------------------------------------------

def _m36_candidates():
    """Passport metadata of three candidate models (the data-derived split fields are added per query)."""
    from ..functions.resources import NORMATIVE_VERSION
    ct = FS.CONTRACT_SETS
    return [
        ("dispatch_candidate", "rank_tz", False, "rank_tz_lpr_dispatch_production", S.STAGE_DISPATCH, "rank_tz_vector",
         "dispatch_initial_safe", None, "preprocessor", "training_schema_v1", NORMATIVE_VERSION,
         "dispatch_initial_safe", list(ct["dispatch_initial_safe"][0])),
        ("research_forest", "rank_tz", True, "research", S.STAGE_RETROSPECTIVE, "rank_tz_vector", "managed", None,
         None, "training_schema_v1", NORMATIVE_VERSION, None, list(FS.TRAINING_SETS["managed"])),
        ("legacy_tactical", "rank_tz", False, "rank_tz_lpr_dispatch_production", S.STAGE_DISPATCH, "rank_tz_count_proxy",
         "online_tactical", "first_hose_update_safe", "preprocessor", None, NORMATIVE_VERSION, "online_tactical",
         list(ct["online_tactical"][0])),
    ]


_M36_FIELDS = ["model", "target", "offline_only", "deployment_role", "availability_stage", "semantic_target",
               "feature_set", "legacy_alias", "preprocessor_path", "training_schema_version", "normative_version",
               "input_schema", "features"]


def _sql_lit(v):
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return "[" + ", ".join(_sql_lit(x) for x in v) + "]::VARCHAR[]"
    return "'" + str(v).replace("'", "''") + "'"


def _m36_sql():
    from ..operators import contract as CT
    vals = ",\n".join("(" + ", ".join(_sql_lit(v) for v in row) + ")" for row in _m36_candidates())

    def blank(c):
        return f"({c} IS NULL OR {c} = '')"

    def inlist(xs):
        return ", ".join(_sql_lit(x) for x in xs)

    disp = f"coalesce(availability_stage = '{S.STAGE_DISPATCH}', false)"
    conds = [
        "NOT coalesce(target = 'rank_tz', false)", "coalesce(offline_only, false)",
        f"NOT coalesce(deployment_role IN ({inlist(CT.PRODUCTION_ROLE_WHITELIST)}), false)", f"NOT {disp}",
        "NOT coalesce(semantic_target = 'rank_tz_vector', false)",
        f"NOT coalesce(feature_set = '{CT.DEFAULT_LPR_FEATURE_SET}', false)",
        f"(coalesce(feature_set = '{CT.LEGACY_FEATURE_SET}', false) OR NOT {blank('legacy_alias')})",
        f"NOT coalesce(split_protocol IN ({inlist(CT.PRODUCTION_SAFE_SPLITS)}), false)",
        "coalesce(CAST(event_overlap_rate AS DOUBLE), 1.0) <> 0.0",
        blank("preprocessor_path"), blank("training_schema_version"), blank("normative_version"),
        blank("input_schema"),
        f"({disp} AND len(list_intersect(coalesce(features, []::VARCHAR[]), "
        f"{_sql_lit(S.DISPATCH_FORBIDDEN_FIELDS)})) > 0)",
    ]
    cases = ", ".join(f"CASE WHEN {c} THEN {_sql_lit(r)} END" for c, r in zip(conds, CT.UNSAFE_REASONS))
    return (f"WITH p AS ({_m2_sql()}),\nc AS (SELECT * FROM (VALUES {vals}) t({', '.join(_M36_FIELDS)})),\n"
            f"r AS (SELECT c.model, p.split_protocol, p.event_overlap_rate, list_filter([{cases}], lambda x: x IS NOT NULL) "
            "AS unsafe_reasons FROM p, c)\n"
            "SELECT model, split_protocol, event_overlap_rate, unsafe_reasons, len(unsafe_reasons) = 0 AS production_safe FROM r")


@register("m36_production_gate", sql=_m36_sql, ids=("M36", "P18", "M2"))
def m36_production_gate(spark, sf):
    """Failed production rules for three candidate models over the data's group-split passport."""
    from ..operators import contract as CT
    sp = m2_split_passport(spark, sf).select("split_protocol", "event_overlap_rate")
    struct_of = [F.struct(*[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v).cast(
        "boolean" if isinstance(v, bool) else "string")).alias(n) for n, v in zip(_M36_FIELDS, row)])
        for row in _m36_candidates()]
    passports = sp.select("*", F.inline(F.array(*struct_of)))
    return CT.unsafe_reasons(passports).select("model", "split_protocol", "event_overlap_rate", "unsafe_reasons",
                                               "production_safe")


def _a20_sql():
    return ("WITH t AS (" + all_t3_sql() + ")\n"
            "SELECT label, rank, count(*) AS n, round(avg(probability), 6) AS mean_probability, "
            "min(probability) AS min_probability, max(probability) AS max_probability, "
            "round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t WHERE position = 1 GROUP BY label, rank")


def all_t3_sql():
    from .registry import all_queries
    return all_queries()["t3_top_k"].sql


@register("a20_prediction_summary", sql=_a20_sql, ids=("A20", "T3"))
def a20_prediction_summary(spark, sf):
    """Top-1 label distribution of the prediction table with its probability spread."""
    return E.prediction_summary(t3_top_k(spark, sf))
