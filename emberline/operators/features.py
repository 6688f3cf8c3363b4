"""Feature engineering (F1-F11, F14-F16, F19-F22) as one projection per call.

Each feature family is a list of named Column expressions applied with a single
``select`` (never a chain of ``withColumn``), so wide feature tables stay one
codegen stage. Three threshold profiles exist because the source application
uses three (research trainer, deployment contract, synthetic twin):

========== ============ ============ ========== ============ ==================== ===============
profile    high-rise    super        far/very   distance cut floors cut           equipment cut
========== ============ ============ ========== ============ ==================== ===============
research   > 9          > 25         > 5 / > 10 2, 5, 10     2, 5, 9, 16          0, 2, 5, 10
contract   > 9          > 25         > 5 / > 10 2, 5, 10     2, 5, 9, 16          –
twin       >= 10        >= 25        >=10/>=25  3, 10, 25    1, 5, 9, 16          1, 2, 4, 8
========== ============ ============ ========== ============ ==================== ===============

Cuts are right-closed (``x <= edge``). Comparisons with a missing operand give
0 like the source's pandas code, not null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import feature_sets as FS
from .. import schema as S
from ..session import written
from .quantiles import long_values, percentile_values


@dataclass(frozen=True)
class Profile:
    name: str
    high_rise: tuple  # (op, value)
    super_high: tuple
    far: tuple
    very_far: tuple
    distance_edges: tuple
    floor_edges: tuple
    equipment_edges: tuple
    ratio_clip: bool
    top_floor_needs_floors: bool
    out_type: str  # int or double for 0/1 indicators


# FIXED VALUES (threshold profiles of the source application)
RESEARCH = Profile("research", (">", 9), (">", 25), (">", 5), (">", 10), (2, 5, 10), (2, 5, 9, 16), (0, 2, 5, 10),
                   True, False, "int")
CONTRACT = Profile("contract", (">", 9), (">", 25), (">", 5), (">", 10), (2, 5, 10), (2, 5, 9, 16), (0, 2, 5, 10),
                   True, False, "double")
TWIN = Profile("twin", (">=", 10), (">=", 25), (">=", 10), (">=", 25), (3, 10, 25), (1, 5, 9, 16), (1, 2, 4, 8),
               False, True, "double")
SEASON_BY_MONTH = {12: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3, 9: 4, 10: 4, 11: 4}
RESPONSE_PAIRS = [("t_detect_min", "t_report_min", "delta_detect_to_report"),
                  ("t_report_min", "t_arrival_min", "delta_report_to_arrival"),
                  ("t_arrival_min", "t_first_hose_min", "delta_arrival_to_hose"),
                  ("t_first_hose_min", "t_contained_min", "delta_hose_to_contained"),
                  ("t_contained_min", "t_extinguished_min", "delta_contained_to_extinguished")]
GROUPS = {
    "temporal": ["day_of_week", "month", "quarter", "season", "is_weekend"],
    "response_time": ["delta_detect_to_report", "delta_report_to_arrival", "delta_arrival_to_hose",
                      "delta_hose_to_contained", "delta_contained_to_extinguished", "total_response_time"],
    "building_risk": ["fire_floor_ratio", "is_high_rise", "is_super_high_rise", "basement_fire", "top_floor_fire"],
    "distance": ["is_far", "is_very_far", "distance_category"],
    "missing_indicators": ["risk_category_code_missing", "fpo_class_code_missing"],
    "binned": ["building_floors_bin", "equipment_count_bin"],
    "interaction": ["floors_x_distance", "weekend_x_detect", "high_rise_x_floors"],
}
# end of fixed values


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _cmp(c: Column, op_val: tuple) -> Column:
    op, v = op_val
    return (c > v) if op == ">" else (c >= v)


def flag(cond: Column, out_type: str = "int") -> Column:
    return F.coalesce(cond, F.lit(False)).cast(out_type)


def cut(c: Column, edges: tuple) -> Column:
    """Right-closed binning: x <= e0 -> 0, ..., x > e_last -> len(edges); null stays null."""
    expr = F.lit(float(len(edges)))
    for i in reversed(range(len(edges))):
        expr = F.when(c <= edges[i], F.lit(float(i))).otherwise(expr)
    return F.when(c.isNotNull(), expr)


def season(month: Column) -> Column:
    expr = F.lit(None).cast("int")
    for m, s in sorted(SEASON_BY_MONTH.items(), reverse=True):
        expr = F.when(month == m, F.lit(s)).otherwise(expr)
    return expr


def temporal(date_col: str = "fire_date", p: Profile = RESEARCH) -> dict[str, Column]:
    d = F.to_date(_c(date_col))
    dow = F.weekday(d)
    return {"day_of_week": dow, "month": F.month(d), "quarter": F.quarter(d), "season": season(F.month(d)),
            "is_weekend": flag(dow >= 5, p.out_type)}


def response_deltas(df_cols: list[str], pairs=RESPONSE_PAIRS) -> dict[str, Column]:
    out = {n: F.col(b) - F.col(a) for a, b, n in pairs if a in df_cols and b in df_cols}
    if "t_detect_min" in df_cols and "t_extinguished_min" in df_cols:
        out["total_response_time"] = F.col("t_extinguished_min") - F.col("t_detect_min")
    return out


def building_risk(p: Profile = RESEARCH) -> dict[str, Column]:
    bf, ff = F.col("building_floors").cast("double"), F.col("fire_floor").cast("double")
    if p.ratio_clip:
        ratio = F.least(F.greatest(ff / F.nullif(bf, F.lit(0.0)), F.lit(-1.0)), F.lit(2.0))
    else:
        ratio = F.when(bf > 0, ff / bf)
    top = (bf > 0) & (ff == bf) if p.top_floor_needs_floors else (ff == bf)
    return {"fire_floor_ratio": ratio, "is_high_rise": flag(_cmp(bf, p.high_rise), p.out_type),
            "is_super_high_rise": flag(_cmp(bf, p.super_high), p.out_type),
            "basement_fire": flag(ff < 0, p.out_type), "top_floor_fire": flag(top, p.out_type)}


def distance(p: Profile = RESEARCH) -> dict[str, Column]:
    d = F.col("distance_to_station").cast("double")
    return {"is_far": flag(_cmp(d, p.far), p.out_type), "is_very_far": flag(_cmp(d, p.very_far), p.out_type),
            "distance_category": cut(d, p.distance_edges)}


def severity_indicators() -> dict[str, Column]:
    hf = flag(F.col("fatalities") > 0)
    hi = flag(F.col("injuries") > 0)
    hd = flag(F.col("direct_damage") > 0)
    return {"has_fatalities": hf, "has_injuries": hi, "has_damage": hd, "severity_level": hf + hi + hd}


def indicator_name(c: str, suffix_style: str = "append") -> str:
    return f"{c[:-5]}_missing" if suffix_style == "strip_code" and c.endswith("_code") else f"{c}_missing"


def missing_indicators(columns: list[str], suffix_style: str = "append", out_type: str = "int") -> dict[str, Column]:
    """``append``: <c>_missing; ``strip_code``: <c minus _code>_missing."""
    return {indicator_name(c, suffix_style): F.col(c).isNull().cast(out_type) for c in columns}


def bins(p: Profile = RESEARCH, with_equipment: bool = True) -> dict[str, Column]:
    out = {"building_floors_bin": cut(F.col("building_floors").cast("double"), p.floor_edges)}
    if with_equipment:
        out["equipment_count_bin"] = cut(F.col("equipment_count").cast("double"), p.equipment_edges)
    return out


def add_all(df: DataFrame, add_severity: bool = False) -> DataFrame:
    """temporal, response, building, distance, missing, bins (+severity); interactions last."""
    cols = df.columns
    stage = df.withColumns({**temporal(), **response_deltas(cols), **building_risk(), **distance(),
                            **missing_indicators(FS.DEFAULT_INDICATOR_COLUMNS), **bins(),
                            **(severity_indicators() if add_severity else {})})
    return stage.withColumns({
        "floors_x_distance": F.col("building_floors") * F.col("distance_to_station"),
        "weekend_x_detect": F.col("is_weekend") * F.col("t_detect_min"),
        "high_rise_x_floors": F.col("is_high_rise") * F.col("building_floors")})


def stage_features(df: DataFrame, feature_set: str, stage: str | None = None) -> DataFrame:
    """stage-aware payload; deltas only when the availability stage allows them."""
    spec = FS.CONTRACT_SETS[feature_set]
    resolved = FS.LEGACY_SET_ALIASES.get(feature_set, feature_set)
    stage = stage or spec[1]
    if resolved not in FS.STAGE_FEATURE_SETS:
        return df
    p = CONTRACT
    cols = df.columns
    new: dict[str, Column] = {}
    if "fire_date" in cols:
        new.update({k: v for k, v in temporal("fire_date", p).items() if k != "quarter"})
    new.update({**building_risk(p), **bins(p, with_equipment=False), **distance(p)})
    for src, name in (("risk_category_code", "risk_category_missing"), ("fpo_class_code", "fpo_class_missing")):
        new[name] = F.col(src).isNull().cast("double") if src in cols else F.lit(1.0)
    if resolved == "enhanced_tactical":
        new["delta_detect_to_report"] = (F.col("t_report_min") - F.col("t_detect_min")).cast("double")
    late = {S.STAGE_ARRIVAL, S.STAGE_FIRST_HOSE, S.STAGE_RETROSPECTIVE}
    new["delta_report_to_arrival"] = ((F.col("t_arrival_min") - F.col("t_report_min")).cast("double")
                                      if stage in late else F.lit(None).cast("double"))
    new["delta_arrival_to_hose"] = ((F.col("t_first_hose_min") - F.col("t_arrival_min")).cast("double")
                                    if stage in {S.STAGE_FIRST_HOSE, S.STAGE_RETROSPECTIVE}
                                    else F.lit(None).cast("double"))
    return df.withColumns(new)


def recompute_derived(df: DataFrame) -> DataFrame:
    """derived columns with the twin threshold profile (after synthesis/distortion)."""
    p = TWIN
    cols = df.columns
    new: dict[str, Column] = {}
    if "fire_date" in cols:
        new.update(temporal("fire_date", p))
    new.update({**response_deltas(cols), **building_risk(p), **bins(p, with_equipment=False), **distance(p)})
    new["floors_x_distance"] = F.col("building_floors") * F.col("distance_to_station")
    stage = df.withColumns(new)
    inter = {"high_rise_x_floors": F.col("is_high_rise") * F.col("building_floors")}
    if "is_weekend" in stage.columns:
        inter["weekend_x_detect"] = F.col("is_weekend") * F.col("t_detect_min")
    for src, name in (("risk_category_code", "risk_category_missing"), ("fpo_class_code", "fpo_class_missing"),
                      ("risk_category_code", "risk_category_code_missing"), ("fpo_class_code", "fpo_class_code_missing")):
        if src in cols:
            inter[name] = F.col(src).isNull().cast("double")
    if "equipment_count" in cols:
        inter["equipment_count_bin"] = cut(F.col("equipment_count").cast("double"), p.equipment_edges)
    return stage.withColumns(inter)


def rank_to_class(c: Column | str, unsupported_as_class1: bool = False) -> Column:
    """rank 1/1.5/2/3/4/5 -> class 1..6; unsupported -> null (or 1 in research mode).

    A literal-map lookup references the input once (a CASE chain would copy it
    into every branch).
    """
    m = F.create_map(*[x for rank, cls in S.RANK_TO_CLASS for x in (F.lit(rank), F.lit(cls))])
    hit = F.element_at(m, _c(c).cast("double"))
    return F.coalesce(hit, F.lit(1)) if unsupported_as_class1 else hit


def class_to_rank(c: Column | str) -> Column:
    """Class id -> rank value; unknown ids pass through as doubles."""
    m = F.create_map(*[x for rank, cls in S.RANK_TO_CLASS for x in (F.lit(cls), F.lit(rank))])
    k = _c(c).cast("int")
    return F.coalesce(F.element_at(m, k), k.cast("double"))


def ensure_columns(df: DataFrame, names: list[str], dtype: str = "double") -> DataFrame:
    """add every missing feature as a typed null."""
    missing = [n for n in names if n not in df.columns]
    return df.select("*", *[F.lit(None).cast(dtype).alias(n) for n in missing]) if missing else df


def missing_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def keep_by_missing(df: DataFrame, features: list[str], thr: float = 0.9) -> list[str]:
    """features with at most ``thr`` missing (one aggregate)."""
    shares = missing_shares(df, features)
    return [f for f in features if shares[f] is not None and shares[f] <= thr]


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")
            or t.startswith("decimal")]


def fill_values(df: DataFrame, columns: list[str], strategy: str, constant: float = 0.0) -> dict[str, float | None]:
    """Per-column fill value: constant, exact median (distributed) or mode (ties -> smallest)."""
    if strategy == "constant":
        return {c: constant for c in columns}
    if strategy == "median":
        found = percentile_values(df, columns, [0.5])
        return {c: found.get((c, 0.5)) for c in columns}
    if strategy == "mode":
        # One job for all columns: the most frequent value, the smallest on ties.
        counts = long_values(df, columns, []).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("column").agg(F.max_by("value", F.struct("n", (-F.col("value")).alias("low"))).alias("mode"))
        found = {r["column"]: r["mode"] for r in top.collect()}
        return {c: found.get(c, constant) for c in columns}
    raise ValueError(strategy)


def training_matrix(df: DataFrame, feature_set: str = "managed", target: str = "rank_tz",
                    fill_strategy: str = "constant", fill_value: float = 0.0, add_indicators: bool = False,
                    indicator_columns: list[str] | None = None, keep: list[str] = (),
                    fill_empty_columns: bool = False) -> DataFrame:
    """F16: named feature set, non-null target, ±inf -> null, indicators, fill.

    An all-missing column has no median/mode and stays null (as a pandas
    median fill leaves it); ``fill_empty_columns`` puts the constant there
    instead, which Spark ML estimators need (they reject NaN features).
    """
    feats = FS.TRAINING_SETS[feature_set]
    if feature_set in FS.ONLINE_TRAINING_SETS and fill_strategy == "constant" and fill_value == 0:
        fill_value = -1.0
    x = df.where(F.col(target).isNotNull()).select(
        *keep, *[F.when(F.abs(F.col(c).cast("double")) == float("inf"), None)
                 .otherwise(F.col(c).cast("double")).alias(c) for c in feats], F.col(target))
    ind = []
    if add_indicators:
        ind = [c for c in (indicator_columns or FS.DEFAULT_INDICATOR_COLUMNS) if c in feats]
        x = x.withColumns(missing_indicators(ind, "strip_code"))
    if fill_strategy == "drop":
        return x.na.drop(subset=feats)
    if fill_strategy != "constant":
        x = written(x, "matrix")
    fills = fill_values(x, feats, fill_strategy, fill_value)
    if fill_empty_columns:
        fills = {c: (v if v is not None else fill_value) for c, v in fills.items()}
    return x.select(*keep, *[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if fills.get(c) is not None
                             else F.col(c) for c in feats],
                    *[c for c in x.columns if c.endswith("_missing")], F.col(target))


# FIXED VALUES (columns, patterns and sets of the source application's experiment builder)
PROXY_PATTERNS = ["rank", "equipment", "nozzle"]
PROXY_COLUMNS = ["row_id", "severity_score", "fatalities", "injuries", "direct_damage", "direct_damage_log", "people_saved",
                 "people_evacuated", "assets_saved", "flag_missing_outputs", "equipment_count_types", "equipment_count_bin"]
META_COLUMNS = ["source_sheet", "source_period", "dup_flag", "synthetic_seed", "synthetic_base_rank"]
LATE_TIMES = ["t_contained_min", "t_extinguished_min", "delta_hose_to_contained", "delta_contained_to_extinguished"]
LATE_ENHANCED = ["quarter", "delta_hose_to_contained", "delta_contained_to_extinguished", "total_response_time"]
WIDE_SET_SIZE = 50
# end of fixed values


def experiment_sets(df: DataFrame, target: str = "rank_tz") -> DataFrame:
    """(feature_set, position, feature), position from 1: the seven feature sets of an experiment.

    A query over schema rows: five sets are unions of stage sets and late columns in
    order, two are the numeric columns that no rule takes for the target, its proxies,
    bookkeeping or marks.
    """
    spark = df.sparkSession
    fields = spark.createDataFrame([(i, c, c in numeric_columns(df)) for i, c in enumerate(df.columns)], "place int, feature string, is_number boolean")
    barred = "|".join(PROXY_PATTERNS) + "|^synthetic_|^_|^flag_|_invalid$"
    wide = fields.where(F.col("is_number") & ~F.col("feature").isin(target, *PROXY_COLUMNS, *META_COLUMNS) & ~F.lower("feature").rlike(barred))
    stages = [("features_10_dispatch", "dispatch_initial_safe", []), ("features_13_arrival", "arrival_update_safe", []),
              ("features_15_first_hose", "first_hose_update_safe", []), ("features_19_retrospective_time", "first_hose_update_safe", LATE_TIMES),
              ("features_35_enhanced_retrospective", "enhanced_tactical", LATE_ENHANCED)]
    named = spark.createDataFrame([(name, i, c) for name, stage, late in stages for i, c in enumerate([*FS.CONTRACT_SETS[stage][0], *late])],
                                  "feature_set string, place int, feature string")
    every = wide.select(F.explode(F.array(F.lit("features_50_wide_no_target"), F.lit("features_all_known_numeric"))).alias("feature_set"), "place", "feature")
    # U3 on rows: each name once, where it comes first.
    firsts = named.unionByName(every).groupBy("feature_set", "feature").agg(F.min("place").alias("place"))
    placed = firsts.select("feature_set", F.row_number().over(Window.partitionBy("feature_set").orderBy("place")).alias("position"), "feature")
    return placed.where((F.col("feature_set") != "features_50_wide_no_target") | (F.col("position") <= WIDE_SET_SIZE))


def experiment_feature_sets(df: DataFrame, target: str = "rank_tz") -> dict[str, list[str]]:
    """The sets of ``experiment_sets`` as lists, by name; sets without a column are empty lists."""
    found = {n: [] for n in ("features_10_dispatch", "features_13_arrival", "features_15_first_hose", "features_19_retrospective_time",
                             "features_35_enhanced_retrospective", "features_50_wide_no_target", "features_all_known_numeric")}
    for r in experiment_sets(df, target).orderBy("feature_set", "position").collect():
        found[r["feature_set"]].append(r["feature"])
    return found


def ordered_union(*column_lists: list[str]) -> list[str]:
    """The column lists concatenated in order, each name kept at its first appearance."""
    out: list[str] = []
    seen: set[str] = set()
    for cols in column_lists:
        for c in cols:
            if c not in seen:
                seen.add(c)
                out.append(c)
    return out


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def feature_types(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, dtype, kind) for the chosen columns; kind is numeric or categorical.

    Built from the schema (one row per column), so it is independent of the row count.
    """
    from pyspark.sql import SparkSession
    types = dict(df.dtypes)
    rows = [(c, types[c], "numeric" if types[c] in _NUMERIC or types[c].startswith("decimal") else "categorical")
            for c in (features or df.columns) if c in types]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, dtype string, kind string")
