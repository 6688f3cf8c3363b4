"""Registered queries: slices, searches, samples, generated features, comparisons, preprocessor, segmentation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import feature_sets as FS
from ..functions import resources as RF
from ..operators import evaluation as E
from ..operators import exploration as X
from ..operators import features as FE
from ..operators import preprocessing as PP
from ..operators import profiling as P
from . import catalog_eval as CE
from . import catalog_relational as CR
from . import incidents as V
from . import sqlblocks as B
from .registry import register
from .sqlfeatures import cut as sql_cut

K, KS = ["sheet_ord", "row_id"], "sheet_ord, row_id"
_FLAGS = ["flag_date_outlier", "flag_floor_outlier", "flag_distance_outlier", "flag_floor_inconsistent", "flag_negative_values",
          "flag_time_invalid", "flag_missing_outputs"]


def _w(chain, select: str) -> str:
    return B.with_(*chain) + select


# --- slices, searches, samples ---------------------------------------------------

@register("p15_interactive_slice", ids=("P15",), sql=lambda: _w(V.sql_stage1() + [
          "sl AS (SELECT * FROM stage1 WHERE year BETWEEN 2001 AND 2004 AND region_code = 105)"],
          "SELECT 'rows' AS item, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM sl UNION ALL SELECT 'missing_pct', 'building_floors', "
          "round(avg(CASE WHEN building_floors IS NULL THEN 1.0 ELSE 0.0 END) * 100, 1) FROM sl UNION ALL "
          + " UNION ALL ".join(f"SELECT 'flag_rate', '{f}', round(avg(CAST({f} AS DOUBLE)), 6) FROM sl" for f in _FLAGS)))
def p15_interactive_slice(spark, sf):
    """Rows, missing share of one column and flag rates of one region's incidents of 2001-2004."""
    return X.interactive_slice(V.stage1(spark, sf), "building_floors", (2001, 2004), 105)


@register("p16_decision_search", ids=("P16",), sql=lambda: _w([CR.DEC_SQL],
          "SELECT decision_id, decided_at, decision_rank, comment FROM dec WHERE contains(CAST(decision_id AS VARCHAR), '7') AND "
          "contains(strftime(decided_at, '%d.%m.%Y %H:%M'), '.01.2024') AND decision_rank = 2.0 AND contains(lower(coalesce(comment, '')), '1')"))
def p16_decision_search(spark, sf):
    """Decisions found by parts of id, shown time and comment and by rank."""
    found = X.search_decisions(CR._decisions(spark, sf), "7", ".01.2024", 2.0, "1")
    return found.select("decision_id", "decided_at", "decision_rank", "comment")


@register("t5_seeded_sample", ids=("T5",), sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, region_code, direct_damage FROM stage1 ORDER BY "
          f"{CE._hash_u(chr(99) + 'oncat_ws(' + repr('|') + ', CAST(sheet_ord AS varchar), CAST(row_id AS varchar))')}, {KS} LIMIT 500"))
def t5_seeded_sample(spark, sf):
    """500 incidents in the order of a seeded hash (the sample size is the feature)."""
    return X.seeded_sample(V.stage1(spark, sf).select(*K, "region_code", "direct_damage"), K, 500, 42)


@register("w3_dense_rank", ids=("W3",), sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, direct_damage, dense_rank() OVER (ORDER BY direct_damage) AS damage_rank FROM stage1 WHERE direct_damage IS NOT NULL"))
def w3_dense_rank(spark, sf):
    """Dense rank of every known damage among all distinct damages."""
    rows = V.stage1(spark, sf).where(F.col("direct_damage").isNotNull()).select(*K, "direct_damage")
    ranks = P.dense_ranks(rows, "direct_damage")
    return rows.join(ranks, F.col("direct_damage") == F.col("value")).select(*K, "direct_damage", F.col("dense_rank").alias("damage_rank"))


@register("a9_spearman_damage", ids=("A9",), sql=lambda: _w(V.sql_stage1() + [
          "sp AS (SELECT direct_damage AS a, distance_to_station AS b FROM stage1 WHERE direct_damage IS NOT NULL AND distance_to_station IS NOT NULL)",
          "spr AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, "
          "rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM sp)"],
          "SELECT round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM spr"))
def a9_spearman_damage(spark, sf):
    """Spearman rho between damage (almost all values distinct) and distance."""
    r = P.spearman(V.stage1(spark, sf), "direct_damage", "distance_to_station")
    return r.select(F.round("spearman", 6).alias("spearman"), "n")


# --- generated features and row repairs ---------------------------------------------

_DFS = ["building_floors", "fire_floor", "distance_to_station"]


_RECIPES = X.feature_recipes(_DFS)


def _sql_of(name: str) -> str:
    """SQL of a generated feature from its recipe."""
    op, *args = _RECIPES[name]
    if op == "column":
        return f"CAST({name} AS DOUBLE)"
    x = [_sql_of(a) for a in args]
    return {"absolute": "abs({0})", "negate": "(-{0})", "multiply": "({0} * {1})", "divide": "({0} / nullif({1}, 0.0))",
            "modulo": "((({0} % nullif({1}, 0.0)) + {1}) % nullif({1}, 0.0))"}[op].format(*x)


@register("f12_generated_features", ids=("F12",), sql=lambda: _w(V.sql_stage1(), f"SELECT {KS}, " + ", ".join(
          f"round({_sql_of(n)}, 6) + 0.0 AS \"{n}\"" for n in _RECIPES) + " FROM stage1"))
def f12_generated_features(spark, sf):
    """Fifty named compositions of three numeric columns (the number is the operator's own limit)."""
    return V.stage1(spark, sf).select(*K, *[(F.round(e, 6) + 0.0).alias(n) for n, e in X.generated_features(_DFS).items()])


@register("f13_top_variances", ids=("F13",), sql=lambda: _w(V.sql_stage1(), "SELECT feature, round(variance, 4) AS variance FROM (" + " UNION ALL ".join(
          f"SELECT '{n}' AS feature, var_samp({_sql_of(n)}) AS variance FROM stage1" for n in _RECIPES)
          + ") WHERE variance IS NOT NULL ORDER BY variance DESC, feature LIMIT 20"))
def f13_top_variances(spark, sf):
    """The twenty generated features of largest variance."""
    return X.top_variances(V.stage1(spark, sf), X.generated_features(_DFS)).select("feature", F.round("variance", 4).alias("variance"))


def _w6_sql():
    chain, last = [], "CAST(NULL AS DOUBLE)"
    for i, c in enumerate(X.TIME_ORDER_COLUMNS):
        src = "stage1" if not i else f"mt{i - 1}"
        now = f"CASE WHEN {c} IS NOT NULL THEN round(greatest(CAST({c} AS DOUBLE), 0.0, {last})) END"
        chain.append(f"mt{i} AS (SELECT * EXCLUDE ({c}{', last_t' if i else ''}), {now} AS {c}, greatest({now}, {last}) AS last_t FROM {src})")
        last = "last_t"
    return _w(V.sql_stage1() + chain, f"SELECT {KS}, {', '.join(X.TIME_ORDER_COLUMNS)} FROM mt{len(X.TIME_ORDER_COLUMNS) - 1}")


@register("w6_monotone_times", sql=_w6_sql, ids=("W6",))
def w6_monotone_times(spark, sf):
    """Stage times raised to the running maximum of the stages before."""
    return X.monotone_times(V.stage1(spark, sf)).select(*K, *X.TIME_ORDER_COLUMNS)


# --- comparisons and counts -------------------------------------------------------------

def _a13_sql():
    cols = X.COMPARED_COLUMNS
    both = lambda e: f"max(CASE WHEN o = 0 THEN {e} END) AS first, max(CASE WHEN o = 1 THEN {e} END) AS second"
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    miss = " + ".join(f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END" for c in ["rank_tz", *cols])
    diffs = " + ".join(f"CASE WHEN va_{a} AND va_{b} THEN abs(coalesce(x.r_{a}_{b}, 0.0) - coalesce(y.r_{a}_{b}, 0.0)) ELSE 0.0 END" for a, b in pairs)
    used = "(" + " + ".join(f"CAST(va_{c} AS INTEGER)" for c in cols) + ")"
    cr = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in pairs)
    vary = ", ".join(f"min({c}) <> max({c}) AS va_{c}" for c in cols)
    parts = [f"SELECT 'share' AS item, CAST(rank_tz AS VARCHAR) AS name, {both('round(n / t, 4)')} FROM (SELECT o, rank_tz, count(*) AS n, "
             "sum(count(*)) OVER (PARTITION BY o) AS t FROM dd WHERE rank_tz IS NOT NULL GROUP BY o, rank_tz) GROUP BY rank_tz",
             f"SELECT 'missingness', '', {both('m')} FROM (SELECT o, round(avg(({miss}) / {len(cols) + 1}), 6) AS m FROM dd GROUP BY o)"]
    for c in cols:
        parts.append(f"SELECT 'mean', '{c}', {both('m')} FROM (SELECT o, round(avg({c}), 6) AS m FROM dd GROUP BY o)")
        parts.append(f"SELECT 'median', '{c}', {both('m')} FROM (SELECT o, round(quantile_cont({c}, 0.5), 6) AS m FROM dd GROUP BY o)")
    parts.append(f"SELECT 'correlation_difference', '', CASE WHEN {used} >= 2 THEN round(2 * ({diffs}) / ({used} * {used}), 6) END, NULL "
                 f"FROM (SELECT {cr}, {vary} FROM dd WHERE o = 0) x, (SELECT {cr} FROM dd WHERE o = 1) y")
    return _w(V.sql_labelled() + ["dd AS (SELECT CAST(sheet_ord = 1 AS INTEGER) AS o, * FROM labelled)"], " UNION ALL ".join(parts))


@register("a13_compare_distributions", sql=_a13_sql, ids=("A13",))
def a13_compare_distributions(spark, sf):
    """Rank shares, missingness, means, medians and correlations of the merged sheet against the period sheets."""
    return X.compare_distributions(V.labelled(spark, sf), F.col("sheet_ord") == 1, "rank_tz")


@register("a16_source_counts", ids=("A16",), sql=lambda: _w(CR._fires_sql() + [
          "pr AS (SELECT d.decision_id, d.decision_rank AS rank_tz FROM dec d JOIN fires f ON d.fire_id = f.row_id WHERE d.save_to_db AND d.decision_rank IS NOT NULL)"],
          "SELECT 'historical_total' AS name, count(*) AS n FROM labelled UNION ALL SELECT 'historical_ready', count_if(rank_tz IS NOT NULL AND "
          "usable_for_training AND is_canonical_event_record) FROM labelled UNION ALL SELECT 'lpr_total', count(*) FROM pr UNION ALL "
          "SELECT 'lpr_ready', count_if(rank_tz IS NOT NULL) FROM pr UNION ALL SELECT 'new_lpr_candidates', count(*) FROM dec WHERE "
          "coalesce(save_to_db, true) AND decision_id NOT IN (SELECT decision_id FROM pr)"))
def a16_source_counts(spark, sf):
    """Training rows by source, how many are ready, and saved decisions still to promote."""
    from ..operators import decisions as DC

    lab, dec = V.labelled(spark, sf), CR._decisions(spark, sf)
    promoted = DC.promote_decisions(dec, lab.where(F.col("sheet_ord") == 0))
    return X.source_counts(lab, promoted, dec)


@register("a18_categorical", ids=("A18",), sql=lambda: _w(V.sql_stage1(),
          "SELECT * FROM (VALUES ('region', true), ('region_code', true), ('flag_time_invalid', true), ('direct_damage', false), ('building_floors', false)) "
          "v(\"column\", categorical) UNION ALL SELECT 'month', count(DISTINCT month) <= 50 FROM stage1 UNION ALL SELECT 'row_id', count(DISTINCT row_id) <= 50 FROM stage1"))
def a18_categorical(spark, sf):
    """Which columns are sampled as categories: text, codes, flags, whole numbers of few values."""
    cols = ["region", "region_code", "flag_time_invalid", "direct_damage", "building_floors", "month", "row_id"]
    return X.infer_categorical(V.stage1(spark, sf).select(*cols))


# --- preprocessor (F17, F18) ---------------------------------------------------------------

_PRE = FS.CONTRACT_SETS["dispatch_initial_safe"][0]
_TRAIN = "sheet_ord = 0 AND enterprise_type_code IS DISTINCT FROM 13"


def _preprocessor(spark, sf):
    """Fitted on the merged sheet without enterprise type 13, so that the other rows hold an unseen category."""
    st = V.stage1(spark, sf)
    train = st.where((F.col("sheet_ord") == 0) & ~F.coalesce(F.col("enterprise_type_code") == 13, F.lit(False)))
    return PP.fit(train, _PRE), st


def _pre_columns():
    num = [c for c in _PRE if FS.field_kind(c) != "categorical"]
    return num, [c for c in _PRE if c not in num]


def _f17_ctes():
    num, cat = _pre_columns()
    tok = lambda c: f"coalesce(CAST({c} AS VARCHAR), '{FS.MISSING_TOKEN}')"
    return V.sql_stage1() + [
        f"tr AS (SELECT * FROM stage1 WHERE {_TRAIN})", "nt AS (SELECT count(*) AS nt FROM tr)",
        "fq AS (" + " UNION ALL ".join(f"SELECT '{c}' AS source, {tok(c)} AS token, count(*) / (SELECT nt FROM nt) AS share FROM tr GROUP BY 2" for c in cat) + ")",
        f"few AS (SELECT source FROM fq GROUP BY source HAVING count(*) <= {FS.ONE_HOT_MAX_DISTINCT})",
        "md AS (" + " UNION ALL ".join(f"SELECT '{c}' AS source, coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0.0) AS fill FROM tr" for c in num) + ")"]


def _f17_sql():
    num, cat = _pre_columns()
    parts = []
    for i, c in enumerate(_PRE):
        always = "true" if c in FS.ALWAYS_INDICATOR_FIELDS else f"(SELECT count(*) > count({c}) FROM tr)"
        parts.append(f"SELECT {i} AS f, 0 AS g, '{c}__missing' AS output, '{c}' AS source, 'missing' AS role, NULL AS token, NULL AS value WHERE {always}")
        if c in num:
            parts.append(f"SELECT {i}, 1, '{c}', '{c}', '{FS.field_kind(c)}', NULL, (SELECT fill FROM md WHERE source = '{c}')")
        else:
            few = f"'{c}' IN (SELECT source FROM few)"
            parts.append(f"SELECT {i}, 1, '{c}__' || token, '{c}', 'one_hot', token, NULL FROM fq WHERE source = '{c}' AND {few}")
            parts.append(f"SELECT {i}, 2, '{c}__unknown', '{c}', 'unknown', NULL, NULL WHERE {few}")
            parts.append(f"SELECT {i}, 1, '{c}', '{c}', 'frequency', token, share FROM fq WHERE source = '{c}' AND NOT {few}")
    return _w(_f17_ctes(), "SELECT CAST(dense_rank() OVER (ORDER BY f, g, CASE WHEN role = 'one_hot' THEN token ELSE '' END) - 1 AS INTEGER) AS position, "
              "output, source, role, token, round(value, 6) AS value FROM (" + " UNION ALL ".join(parts) + ")")


@register("f17_preprocessor_fit", sql=_f17_sql, ids=("F17",))
def f17_preprocessor_fit(spark, sf):
    """The fitted preprocessor of the dispatch features as rows, from the training part alone."""
    return _preprocessor(spark, sf)[0].table().withColumn("value", F.round("value", 6))


def _f18_sql():
    # The columns are fixed by the fixture: regions exceed the one-hot limit, the other codes do not.
    num, cat = _pre_columns()
    tok = lambda c: f"coalesce(CAST({c} AS VARCHAR), '{FS.MISSING_TOKEN}')"
    cols = [f"CAST({c} IS NULL AS DOUBLE) AS \"{c}__missing\"" for c in _PRE]
    cols += [f"coalesce(CAST({c} AS DOUBLE), (SELECT fill FROM md WHERE source = '{c}')) AS {c}" for c in num]
    cols += [f"CAST({tok(c)} NOT IN (SELECT token FROM fq WHERE source = '{c}') AS DOUBLE) AS \"{c}__unknown\"" for c in cat if c not in _WIDE]
    cols += [f"round(coalesce((SELECT share FROM fq WHERE source = '{c}' AND fq.token = {tok(c)}), 0.0), 6) AS {c}" for c in _WIDE]
    return _w(_f17_ctes(), f"SELECT {KS}, {', '.join(cols)} FROM stage1")


_WIDE = ["region_code", "enterprise_type_code"]


@register("f18_preprocessor_apply", sql=_f18_sql, ids=("F18",))
def f18_preprocessor_apply(spark, sf):
    """Indicators, fills, unknown marks and frequencies of every row, unseen categories included."""
    model, rows = _preprocessor(spark, sf)
    out = model.transform(rows, K)
    num, cat = _pre_columns()
    want = [f"{c}__missing" for c in _PRE] + num + [f"{c}__unknown" for c in cat if c not in _WIDE]
    # A column without missing values in the training part has no indicator; the rows show what it would be.
    have = [F.col(f"`{c}`") if c in out.columns else F.lit(0.0).alias(c) for c in want]
    return out.select(*K, *have, *[F.round(c, 6).alias(c) for c in _WIDE])


# --- segmentation runs over fixed labels (M22-M24, M26, T4) -----------------------------------

_SEG = ["building_floors", "distance_to_station"]
_LABELS = [("floors", "building_floors", FE.RESEARCH.floor_edges), ("distance", "distance_to_station", FE.RESEARCH.distance_edges),
           ("low_high", "building_floors", (9,))]


def _labelled_segments(spark, sf):
    return V.cleaned(spark, sf).where(F.col("building_floors").isNotNull() & F.col("distance_to_station").isNotNull() & F.col("rank_ref").isNotNull())


def _runs(spark, sf):
    """All labellings of the same rows, evaluated together."""
    rows = _labelled_segments(spark, sf).select(*_SEG, "rank_ref")
    labels = [F.struct(F.lit(i).alias("run_id"), F.lit(name).alias("name"), FE.cut(F.col(col).cast("double"), edges).cast("int").alias("cluster"))
              for i, (name, col, edges) in enumerate(_LABELS)]
    long = rows.select(*_SEG, "rank_ref", F.inline(F.array(*labels)))
    by = ["run_id", "name"]
    runs = E.cluster_validity(long, _SEG, "cluster", by).join(E.rank_alignment(long, "cluster", "rank_ref", by), by)
    return runs.withColumnRenamed("n", "rows_used").withColumn("silhouette", F.lit(None).cast("double")).withColumn(
        "cluster_smallest_share", F.col("cluster_min") / F.col("rows_used"))


def _run_ctes():
    chain, picks = V.sql_cleaned(), []
    for i, (name, col, edges) in enumerate(_LABELS):
        s = f"g{i}"
        chain += [
            f"{s} AS (SELECT building_floors AS f1, distance_to_station AS f2, rank_ref AS r, CAST({sql_cut(f'CAST({col} AS DOUBLE)', edges)} AS INTEGER) AS c "
            "FROM cleaned WHERE building_floors IS NOT NULL AND distance_to_station IS NOT NULL AND rank_ref IS NOT NULL)",
            f"{s}c AS (SELECT c, count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, avg(r) AS mr FROM {s} GROUP BY c)",
            f"{s}w AS (SELECT s.c, sum(power(f1 - m1, 2) + power(f2 - m2, 2)) AS ss, avg(sqrt(power(f1 - m1, 2) + power(f2 - m2, 2))) AS sd FROM {s} s JOIN {s}c USING (c) GROUP BY s.c)",
            f"{s}k AS (SELECT * FROM {s}c JOIN {s}w USING (c))",
            f"{s}d AS (SELECT avg(q) AS db FROM (SELECT a.c, max((a.sd + b.sd) / sqrt(power(a.m1 - b.m1, 2) + power(a.m2 - b.m2, 2))) AS q FROM {s}k a JOIN {s}k b ON a.c <> b.c GROUP BY a.c))",
            f"{s}o AS (SELECT s.r, dense_rank() OVER (ORDER BY mr, c) AS o FROM {s} s JOIN {s}c USING (c))",
            f"{s}p AS (SELECT rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS b FROM {s}o)",
            f"{s}t AS (SELECT c, CAST(r AS INTEGER) AS r, count(*) AS n FROM {s} GROUP BY 1, 2)",
            f"{s}m AS (SELECT sum(n / t * ln(t * n / (nc * nr))) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER (PARTITION BY r) AS nr FROM {s}t))",
            f"{s}e AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n, sum(sum(n)) OVER () AS t FROM {s}t GROUP BY c)) AS hc, "
            f"(SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n, sum(sum(n)) OVER () AS t FROM {s}t GROUP BY r)) AS hr)"]
        picks.append(
            f"SELECT {i} AS run_id, '{name}' AS name, (SELECT min(n) FROM {s}c) AS cluster_min, (SELECT max(n) FROM {s}c) AS cluster_max, (SELECT sum(n) FROM {s}c) AS rows_used, "
            f"(SELECT sum(ss) FROM {s}w) AS inertia, (SELECT db FROM {s}d) AS davies_bouldin, (SELECT (sum(n * (power(m1 - g1, 2) + power(m2 - g2, 2))) / sum(ss)) * "
            f"((sum(n) - count(*)) / (count(*) - 1)) FROM {s}k, (SELECT avg(f1) AS g1, avg(f2) AS g2 FROM {s})) AS calinski_harabasz, "
            f"(SELECT corr(a, b) FROM {s}p) AS spearman, (SELECT avg(x) FROM (SELECT max(n) / sum(n) AS x FROM {s}t GROUP BY c)) AS purity, "
            f"(SELECT greatest(CASE WHEN hc + hr > 0 THEN mi / ((hc + hr) / 2) ELSE 1.0 END, 0.0) FROM {s}m, {s}e) AS nmi, CAST(NULL AS DOUBLE) AS silhouette")
    chain.append("rn AS (SELECT *, cluster_min / rows_used AS cluster_smallest_share FROM (" + " UNION ALL ".join(picks) + "))")
    chain.append("sc AS (SELECT *, 0.3 * coalesce(greatest(silhouette, 0.0), 0.0) + 0.2 / (1 + davies_bouldin) + 0.2 * (coalesce(spearman, 0.0) + 1) / 2 "
                 "+ 0.15 * purity + 0.15 * nmi AS final_score FROM rn WHERE cluster_smallest_share >= 0.01 AND cluster_min >= 30)")
    return chain


_RUN_COLUMNS = ["inertia", "davies_bouldin", "calinski_harabasz", "spearman", "purity", "nmi", "cluster_smallest_share"]


@register("m24_segmentation_runs", ids=("M22", "M23", "M24"), sql=lambda: _w(_run_ctes(),
          "SELECT run_id, name, rows_used, cluster_min, cluster_max, " + ", ".join(f"round({c}, 5) AS {c}" for c in [*_RUN_COLUMNS, "final_score"]) + " FROM sc"))
def m24_segmentation_runs(spark, sf):
    """Validity, alignment with the severity rank and composite score of three fixed segmentations."""
    s = E.composite_score(_runs(spark, sf))
    return s.select("run_id", "name", "rows_used", "cluster_min", "cluster_max", *[F.round(c, 5).alias(c) for c in [*_RUN_COLUMNS, "final_score"]])


@register("m26_run_comparison", ids=("M26",), sql=lambda: _w(_run_ctes() + [
          "lg AS (" + " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM sc WHERE run_id IN (0, 1)" for m in X.RUN_METRICS) + ")"],
          "SELECT metric, round(max(CASE WHEN run_id = 0 THEN v END), 5) AS a, round(max(CASE WHEN run_id = 1 THEN v END), 5) AS b, "
          "round(max(CASE WHEN run_id = 0 THEN v END) - max(CASE WHEN run_id = 1 THEN v END), 5) AS delta FROM lg GROUP BY metric"))
def m26_run_comparison(spark, sf):
    """Eleven metrics of two segmentation runs and their differences."""
    c = X.compare_runs(E.composite_score(_runs(spark, sf)), 0, 1)
    return c.select("metric", *[F.round(x, 5).alias(x) for x in ("a", "b", "delta")])


@register("t4_leaderboard", ids=("T4",), sql=lambda: _w(_run_ctes(),
          "SELECT name, round(final_score, 5) AS final_score, round((final_score - b) / b * 100, 4) AS improvement_pct FROM sc, "
          "(SELECT max(final_score) AS b FROM sc WHERE name = 'low_high') ORDER BY sc.final_score DESC, name LIMIT 3"))
def t4_leaderboard(spark, sf):
    """Best segmentation runs with the improvement over the baseline run (a top-3 report)."""
    b = X.leaderboard(E.composite_score(_runs(spark, sf)), "final_score", "name", "low_high")
    return b.select("name", F.round("final_score", 5).alias("final_score"), "improvement_pct")


# --- decision payload and oversampling -----------------------------------------------------------

_PASSPORT = {"semantic_target": "rank_tz_vector", "availability_stage": "dispatch_initial", "feature_set": "online_tactical", "legacy_alias": None,
             "event_overlap_rate": 0.0, "split_protocol": "group_shuffle", "calibration_status": "not_calibrated"}


def _m19_sql():
    names = {i + 1: r[1] for i, r in enumerate(sorted(RF.NORMATIVES, key=lambda r: r[4]))}
    label = "CASE j " + " ".join(f"WHEN {k} THEN {B.q(v)}" for k, v in names.items()) + " END"
    w = [B.q(x) for x in X.MODEL_WARNINGS]
    return _w(CE._pred_sql_ctes() + [
        "en AS (SELECT *, -list_sum(list_transform(probability, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END)) AS entropy, list_max(probability) AS confidence FROM pred)",
        f"tk AS (SELECT sheet_ord, row_id, list(concat({label}, ':', printf('%.4f', probability[j])) ORDER BY pos) AS top FROM (SELECT *, row_number() OVER "
        "(PARTITION BY sheet_ord, row_id ORDER BY probability[j] DESC, j) AS pos FROM pred, range(1, 7) r(j)) WHERE pos <= 3 GROUP BY 1, 2)"],
        f"SELECT e.sheet_ord, e.row_id, tk.top, round(confidence, 6) AS confidence, round(entropy, 6) AS entropy, list_filter([{w[2]}, CASE WHEN confidence < 0.5 THEN {w[5]} END, "
        f"CASE WHEN entropy > 1.2 THEN {w[6]} END, {w[7]}], lambda x: x IS NOT NULL) AS warnings FROM en e JOIN tk USING (sheet_ord, row_id)")


@register("m19_decision_payload", sql=_m19_sql, ids=("M19",))
def m19_decision_payload(spark, sf):
    """Top-3 ranks, confidence, entropy and warnings of every scored row."""
    passport = F.struct(*[F.lit(v).cast("double" if isinstance(v, float) else "string").alias(k) for k, v in _PASSPORT.items()])
    p = X.decision_payload(CE._pred(spark, sf), K, passport)
    top = F.transform("top_k_ranks", lambda r: F.concat(r["rank_name"], F.lit(":"), F.format_string("%.4f", r["probability"])))
    return p.select(*K, top.alias("top"), F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"), "warnings")


@register("m29_requested_total", ids=("M29",), sql=lambda: _w(V.sql_labelled() + [
          "cc AS (SELECT CASE rank_tz WHEN 1.0 THEN 1 WHEN 1.5 THEN 2 WHEN 2.0 THEN 3 WHEN 3.0 THEN 4 WHEN 4.0 THEN 5 WHEN 5.0 THEN 6 END AS cls, count(*) AS n "
          "FROM labelled WHERE rank_tz IS NOT NULL GROUP BY 1)",
          "ld AS (SELECT *, max(n) OVER () - n AS lack, least(30001, max(n) OVER () * count(*) OVER ()) - sum(n) OVER () AS extra FROM cc)",
          "sh AS (SELECT *, CAST(CASE WHEN extra > 0 THEN (extra * lack) // sum(lack) OVER () ELSE 0 END AS BIGINT) AS share FROM ld)",
          "rk AS (SELECT *, greatest(extra, 0) - sum(share) OVER () AS rest, row_number() OVER (ORDER BY lack DESC, cls) AS pos FROM sh)"],
          "SELECT cls, n, CAST(n + share + CASE WHEN pos <= rest AND share < lack THEN 1 ELSE 0 END AS BIGINT) AS target FROM rk"))
def m29_requested_total(spark, sf):
    """Class targets for a requested total: whole shares of what classes lack, then one row each."""
    return E.oversampling_plan(V.labelled(spark, sf).select(FE.rank_to_class("rank_tz").alias("cls")), "cls", 30_001)
