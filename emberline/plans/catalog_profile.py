"""Registered queries: full statistical profile and schema-level feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import feature_sets as FS
from .. import schema as S
from ..operators import features as FE
from ..operators.full_profile import STATS, statistical_profile
from . import incidents as V
from . import sqlblocks as B
from .registry import register

_NUM = ["fire_protection_code", "rank_tz", "building_floors", "distance_to_station", "direct_damage"]
_CAT = ["source_sheet", "region"]
_LINKED = ["source_sheet", "region", "fire_protection_code"]


def _cells(section: str, source: str, metrics: dict[str, str], rank="NULL", column="NULL", key="NULL") -> str:
    cells = ", ".join(f"{{'m': '{m}', 'v': CAST({v} AS DOUBLE)}}" for m, v in metrics.items())
    return (f"SELECT '{section}' AS section, rank, \"column\", key, u.m AS metric, u.v AS value FROM (SELECT CAST({rank} AS DOUBLE) AS rank, "
            f"CAST({column} AS VARCHAR) AS \"column\", CAST({key} AS VARCHAR) AS key, unnest([{cells}]) AS u FROM {source})")


def _stats_sql(groups: str, where: str) -> str:
    r6 = lambda x: f"round({x}, 6)"
    q = lambda p: f"quantile_cont(v, {p})"
    return (f"(SELECT {groups}, count(v) AS count, count_if(v IS NULL) AS missing, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std, {r6(q(0.5))} AS median, "
            f"{r6(q(0.05))} AS q05, {r6(q(0.25))} AS q25, {r6(q(0.75))} AS q75, {r6(q(0.95))} AS q95, {r6(q(0.75) + ' - ' + q(0.25))} AS iqr, "
            f"{r6('quantile_cont(abs(v - med), 0.5)')} AS mad, min(v) AS min, max(v) AS max "
            f"FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY {groups}) AS med FROM lng {where}) GROUP BY {groups})")


def _top_sql(groups: str, where: str) -> str:
    return (f"(SELECT * FROM (SELECT {groups}, val, count(*) AS count, row_number() OVER (PARTITION BY {groups} ORDER BY count(*) DESC, val) AS pos "
            f"FROM txt WHERE c IN ({', '.join(map(B.q, _CAT))}) {where} GROUP BY {groups}, val) WHERE pos <= 30)")


def _a12_sql():
    cols = _NUM + _CAT
    chain = V.sql_labelled() + [
        f"src AS (SELECT {', '.join(cols)} FROM labelled)",
        "lng AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, rank_tz AS r, CAST({c} AS DOUBLE) AS v FROM src" for c in _NUM) + ")",
        "txt AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, rank_tz AS r, coalesce(CAST({c} AS VARCHAR), '__missing__') AS val FROM src" for c in _LINKED) + ")",
        "cnt AS (SELECT c, val, r, count(*) AS n FROM txt GROUP BY ALL)",
        "tops AS (SELECT c, val, n_ranked FROM (SELECT c, val, sum(CASE WHEN r IS NOT NULL THEN n END) AS n_ranked, "
        "row_number() OVER (PARTITION BY c ORDER BY sum(n) DESC, val) AS pos FROM cnt GROUP BY c, val) WHERE pos <= 20)"]
    stats = {m: m for m in STATS}
    varied = lambda c: f"(SELECT count({c}) >= 3 AND min({c}) <> max({c}) FROM src)"
    parts = [
        _cells("table", f"(SELECT count(*) AS n, count_if(source_sheet = {B.q(S.CANONICAL_SOURCE_SHEET)}) AS k FROM src)",
               {"row_count": "n", "column_count": str(len(cols)), "canonical_rows": "k"}),
        *[_cells("missingness", f"(SELECT avg(CAST({c} IS NULL AS INTEGER)) AS p FROM src)", {"missing_pct": "round(p * 100, 4)"}, column=B.q(c)) for c in cols],
        _cells("numeric", _stats_sql("c", ""), stats, column="c"),
        _cells("rank_numeric", _stats_sql("r, c", "WHERE r IS NOT NULL"), stats, "r", "c"),
        *[_cells("correlation", f"(SELECT round(coalesce({'1.0' if a == b else f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))'}, 0.0), 4) AS r "
                 f"FROM src HAVING {varied(a)} AND {varied(b)})", {"r": "r"}, column=B.q(a), key=B.q(b)) for a in _NUM for b in _NUM],
        _cells("categorical", _top_sql("c", ""), {"count": "count"}, column="c", key="val"),
        _cells("rank_categorical", _top_sql("r, c", "AND r IS NOT NULL"), {"count": "count"}, "r", "c", "val"),
        _cells("rank", "(SELECT rank_tz, count(*) AS n, count(*) / sum(count(*)) OVER () AS s FROM src WHERE rank_tz IS NOT NULL GROUP BY rank_tz)",
               {"count": "n", "share": "round(s, 6)"}, "rank_tz"),
        _cells("rank_link", "(SELECT cnt.c, cnt.val, r, n / n_ranked AS s FROM cnt JOIN tops USING (c, val) WHERE r IS NOT NULL)", {"share": "round(s, 4)"}, "r", "c", "val")]
    return B.with_(*chain) + " UNION ALL ".join(parts)


@register("a12_statistical_profile", sql=_a12_sql, ids=("A12", "A11"))
def a12_statistical_profile(spark, sf):
    """Shape, summaries, counts, missing shares, ranks, correlations and links with the rank of the labelled table, as one long table."""
    return statistical_profile(V.labelled(spark, sf).select(*_NUM, *_CAT))


# --- schema-level feature helpers, with what the rows hold ------------------------

_COLS = ["row_id", "region", "region_code", "building_floors", "fire_floor", "distance_to_station", "severity_score", "fatalities", "injuries", "direct_damage",
         "equipment_count", "nozzle_count", "flag_time_invalid", "t_detect_min", "t_report_min", "t_arrival_min", "source_item_code", "fire_protection_code", "source_sheet"]


def _present(df, columns):
    """(feature, n_present, n_distinct) of ``columns``, in one aggregate."""
    row = df.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[F.count_distinct(F.col(c)).alias(f"d_{c}") for c in columns])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n_present"), F.col(f"d_{c}").alias("n_distinct")) for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


_TYPED = "CASE WHEN max(typeof({c})) IN ('VARCHAR', 'DATE', 'TIMESTAMP') THEN 'categorical' ELSE 'numeric' END"


@register("f14_feature_types", ids=("F14",), sql=lambda: B.with_(*V.sql_stage1()) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_TYPED.format(c=c)} AS kind, count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct FROM stage1" for c in _COLS))
def f14_feature_types(spark, sf):
    """Numeric or categorical, values and distinct values of each feature."""
    df = V.stage1(spark, sf).select(*_COLS)
    return FE.feature_types(df).join(_present(df, _COLS), "feature").select("feature", "kind", "n_present", "n_distinct")


def _f22_sql():
    rules = (f"kind = 'n' AND name <> 'rank_tz' AND name NOT IN ({', '.join(map(B.q, FE.PROXY_COLUMNS + FE.META_COLUMNS))}) "
             f"AND NOT regexp_matches(name, '{'|'.join(FE.PROXY_PATTERNS)}|^synthetic_|^_|^flag_|_invalid$')")
    kinds = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, CASE WHEN max(typeof({c})) IN ('VARCHAR', 'DATE', 'TIMESTAMP', 'BOOLEAN') THEN 't' ELSE 'n' END "
                               f"AS kind, count({c}) AS n FROM stage1" for i, c in enumerate(_COLS))
    stages = {"features_10_dispatch": ("dispatch_initial_safe", []), "features_13_arrival": ("arrival_update_safe", []),
              "features_15_first_hose": ("first_hose_update_safe", []), "features_19_retrospective_time": ("first_hose_update_safe", FE.LATE_TIMES),
              "features_35_enhanced_retrospective": ("enhanced_tactical", FE.LATE_ENHANCED)}
    fixed = " UNION ALL ".join(f"SELECT '{name}' AS feature_set, unnest(range(1, {len(x) + 1})) AS position, unnest([{', '.join(map(B.q, x))}]) AS name"
                               for name, (stage, more) in stages.items() for x in [list(dict.fromkeys([*FS.CONTRACT_SETS[stage][0], *more]))])
    return B.with_(*V.sql_stage1(), f"kinds AS ({kinds})", f"wide AS (SELECT row_number() OVER (ORDER BY place) AS position, name FROM kinds WHERE {rules})",
                   f"sets AS ({fixed} UNION ALL SELECT 'features_50_wide_no_target', position, name FROM wide WHERE position <= {FE.WIDE_SET_SIZE} "
                   "UNION ALL SELECT 'features_all_known_numeric', position, name FROM wide)") + (
        "SELECT feature_set, CAST(position AS INTEGER) AS position, name AS feature, n AS n_present FROM sets LEFT JOIN kinds USING (name)")


@register("f22_experiment_sets", sql=_f22_sql, ids=("F22", "U3"))
def f22_experiment_sets(spark, sf):
    """The seven feature sets of an experiment in order, with the values that the table holds of each feature."""
    df = V.stage1(spark, sf).select(*_COLS)
    return FE.experiment_sets(df).join(_present(df, _COLS).drop("n_distinct"), "feature", "left").select("feature_set", "position", "feature", "n_present")
