"""Registered queries: feature engineering (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import feature_sets as FS
from ..operators import features as FE
from . import incidents as V
from . import sqlblocks as B
from . import sqlfeatures as SF
from .registry import register

K = ["sheet_ord", "row_id"]
KS = "sheet_ord, row_id"


def _w(chain, select: str) -> str:
    return B.with_(*chain) + select


def _sel(df, d: dict):
    return df.select(*K, *[v.alias(k) for k, v in d.items()])


def _ssel(d: dict) -> str:
    return f"SELECT {KS}, " + SF.select_list(d)


@register("f1_temporal", sql=lambda: _w(V.sql_stage1(), _ssel(SF.temporal()) + " FROM stage1"), ids=("F1",))
def f1_temporal(spark, sf):
    """day_of_week (Mon=0), month, quarter, season, is_weekend (0 when undated)."""
    return _sel(V.stage1(spark, sf), FE.temporal())


@register("f2_response_deltas", sql=lambda: _w(V.sql_stage1(), _ssel(SF.response_deltas()) + " FROM stage1"),
          ids=("F2",))
def f2_response_deltas(spark, sf):
    """Five consecutive stage deltas and the total response time."""
    df = V.stage1(spark, sf)
    return _sel(df, FE.response_deltas(df.columns))


@register("f3_building_risk", sql=lambda: _w(V.sql_stage1(),
          f"SELECT {KS}, round(fire_floor_ratio, 6) AS fire_floor_ratio, is_high_rise, is_super_high_rise, basement_fire, "
          f"top_floor_fire FROM ({_ssel(SF.building_risk())} FROM stage1)"), ids=("F3",))
def f3_building_risk(spark, sf):
    """Floor ratio clipped to [-1, 2], high-rise, super high-rise, basement, top floor."""
    d = FE.building_risk()
    d["fire_floor_ratio"] = F.round(d["fire_floor_ratio"], 6)
    return _sel(V.stage1(spark, sf), d)


@register("f4_distance", sql=lambda: _w(V.sql_stage1(), _ssel(SF.distance()) + " FROM stage1"), ids=("F4",))
def f4_distance(spark, sf):
    """Far (>5), very far (>10) and right-closed distance category."""
    return _sel(V.stage1(spark, sf), FE.distance())


@register("f5_severity_indicators", sql=lambda: _w(V.sql_stage1(), _ssel(SF.severity_indicators()) + " FROM stage1"),
          ids=("F5",))
def f5_severity_indicators(spark, sf):
    """has_fatalities / has_injuries / has_damage and their sum (0-3)."""
    return _sel(V.stage1(spark, sf), FE.severity_indicators())


_MISS = ["risk_category_code", "fpo_class_code", "building_floors", "fire_floor", "distance_to_station",
         "t_arrival_min", "equipment_count"]


@register("f6_missing_indicators", sql=lambda: _w(V.sql_stage1(), _ssel(SF.missing(_MISS)) + " FROM stage1"),
          ids=("F6",))
def f6_missing_indicators(spark, sf):
    """<column>_missing indicators."""
    return _sel(V.stage1(spark, sf), FE.missing_indicators(_MISS))


@register("f7_bins", sql=lambda: _w(V.sql_stage1(), _ssel(SF.bins()) + " FROM stage1"), ids=("F7", "W6"))
def f7_bins(spark, sf):
    """Right-closed floor (2,5,9,16) and equipment-count (0,2,5,10) bins."""
    return _sel(V.stage1(spark, sf), FE.bins())


_F9_OUT = (FE.GROUPS["temporal"] + FE.GROUPS["response_time"] + FE.GROUPS["building_risk"] + FE.GROUPS["distance"]
           + FE.GROUPS["missing_indicators"] + FE.GROUPS["binned"] + FE.GROUPS["interaction"]
           + ["has_fatalities", "has_injuries", "has_damage", "severity_level"])


def _round_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" if c in ("fire_floor_ratio", "floors_x_distance", "high_rise_x_floors")
                     else c for c in cols)


@register("f8_f9_all_features", sql=lambda: _w(V.sql_stage1() + SF.all_features_ctes("stage1", add_severity=True),
          f"SELECT {KS}, {_round_sql(_F9_OUT)} FROM feat"), ids=("F8", "F9"))
def f8_f9_all_features(spark, sf):
    """All feature families in one projection, interactions last, severity included."""
    df = FE.add_all(V.stage1(spark, sf), add_severity=True)
    return df.select(*K, *[F.round(c, 6).alias(c) if c in ("fire_floor_ratio", "floors_x_distance",
                                                            "high_rise_x_floors") else F.col(c) for c in _F9_OUT])


def _stage_out(name):
    return FS.CONTRACT_SETS[name][0]


def _stage_query(name: str, stage_token: str):
    cols = _stage_out(name)

    def sql():
        return _w(V.sql_stage1() + SF.stage_ctes("stage1", name, stage_token),
                  f"SELECT {KS}, {_round_sql(cols)} FROM stg")

    def build(spark, sf):
        df = FE.stage_features(V.stage1(spark, sf), name)
        return df.select(*K, *[F.round(c, 6).alias(c) if c == "fire_floor_ratio" else F.col(c) for c in cols])
    return sql, build


for _name, _stage in (("arrival_update_safe", "arrival_update"), ("first_hose_update_safe", "first_hose_update"),
                      ("enhanced_tactical", "retrospective")):
    _sql, _build = _stage_query(_name, _stage)
    _build.__doc__ = f"Stage-aware feature payload of the {_name} set."
    register(f"f10_stage_{_name}", sql=_sql, ids=("F10",))(_build)


_TWIN_OUT = ["day_of_week", "month", "quarter", "season", "is_weekend", "delta_detect_to_report",
             "delta_report_to_arrival", "delta_arrival_to_hose", "total_response_time", "fire_floor_ratio",
             "is_high_rise", "is_super_high_rise", "basement_fire", "top_floor_fire", "building_floors_bin", "is_far",
             "is_very_far", "distance_category", "floors_x_distance", "weekend_x_detect", "high_rise_x_floors",
             "risk_category_missing", "fpo_class_code_missing", "equipment_count_bin"]


@register("f11_recompute_derived", sql=lambda: _w(V.sql_stage1() + SF.twin_ctes("stage1"),
          f"SELECT {KS}, {_round_sql(_TWIN_OUT)} FROM tw"), ids=("F11",))
def f11_recompute_derived(spark, sf):
    """Derived features with the synthetic-twin thresholds (>=10 floors, >=10 km, other cuts)."""
    df = FE.recompute_derived(V.stage1(spark, sf))
    return df.select(*K, *[F.round(c, 6).alias(c) if c in ("fire_floor_ratio", "floors_x_distance",
                                                            "high_rise_x_floors") else F.col(c) for c in _TWIN_OUT])


_FILL = ["building_floors", "fire_floor", "distance_to_station", "t_detect_min", "region_code", "source_item_code"]


def _f15_sql():
    parts = []
    for c in _FILL:
        parts.append(
            f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median, "
            f"(SELECT CAST({c} AS DOUBLE) FROM stage1 WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode "
            "FROM stage1")
    return _w(V.sql_stage1(), " UNION ALL ".join(parts))


@register("f15_fill_values", sql=_f15_sql, ids=("F15",))
def f15_fill_values(spark, sf):
    """Median (exact, distributed) and mode (ties -> smallest) per feature."""
    df = V.stage1(spark, sf)
    med = FE.fill_values(df, _FILL, "median")
    mode = FE.fill_values(df, _FILL, "mode")
    rows = [(c, None if med[c] is None else round(med[c], 6), None if mode[c] is None else float(mode[c]))
            for c in _FILL]
    return spark.createDataFrame(rows, "feature string, median double, mode double")


def _f16_sql():
    feats = FS.TRAINING_SETS["managed"]
    inds = {f"{c[:-5]}_missing": f"CAST({c} IS NULL AS INTEGER)" for c in FS.DEFAULT_INDICATOR_COLUMNS}
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in feats)
    fill = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in feats)
    return _w(V.sql_labelled() + [
        f"tm AS (SELECT {KS}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in feats)}, "
        f"{SF.select_list(inds)}, rank_tz FROM labelled WHERE rank_tz IS NOT NULL)",
        f"md AS (SELECT {meds} FROM tm)"],
        f"SELECT {KS}, {fill}, {', '.join(inds)}, rank_tz FROM tm, md")


@register("f16_training_matrix", sql=_f16_sql, ids=("F16",))
def f16_training_matrix(spark, sf):
    """managed feature set, labelled rows, indicators, median fill."""
    return FE.training_matrix(V.labelled(spark, sf), "managed", "rank_tz", fill_strategy="median",
                              add_indicators=True, keep=K)


@register("f19_rank_to_class", sql=lambda: _w(V.sql_labelled(),
          f"SELECT {KS}, rank_tz, CASE rank_tz WHEN 1.0 THEN 1 WHEN 1.5 THEN 2 WHEN 2.0 THEN 3 WHEN 3.0 THEN 4 "
          "WHEN 4.0 THEN 5 WHEN 5.0 THEN 6 END AS rank_class FROM labelled"), ids=("F19",))
def f19_rank_to_class(spark, sf):
    """Rank -> class 1..6 (unsupported -> null)."""
    return V.labelled(spark, sf).select(*K, "rank_tz", FE.rank_to_class("rank_tz").alias("rank_class"))


_F21 = FS.TRAINING_SETS["full"]


@register("f21_missing_filter", sql=lambda: _w(V.sql_stage1(), " UNION ALL ".join(
          f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, "
          f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.9 AS keep FROM stage1" for c in _F21)),
          ids=("F21", "A2"))
def f21_missing_filter(spark, sf):
    """Missing share per feature (one aggregate) and the keep decision at 90 %."""
    shares = FE.missing_shares(V.stage1(spark, sf), _F21)
    rows = [(c, round(shares[c], 6), shares[c] <= 0.9) for c in _F21]
    return spark.createDataFrame(rows, "feature string, missing_share double, keep boolean")
