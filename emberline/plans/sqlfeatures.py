"""DuckDB expressions for the feature families (oracle side)."""

from __future__ import annotations

from ..operators.features import CONTRACT, RESEARCH, RESPONSE_PAIRS, SEASON_BY_MONTH, TWIN, Profile


def flag(cond: str, out_type: str = "INTEGER") -> str:
    return f"CAST(coalesce({cond}, false) AS {out_type})"


def _t(p: Profile) -> str:
    return "INTEGER" if p.out_type == "int" else "DOUBLE"


def cut(x: str, edges) -> str:
    whens = " ".join(f"WHEN {x} <= {e} THEN {float(i)}" for i, e in enumerate(edges))
    return f"(CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {float(len(edges))} END)"


def season(m: str) -> str:
    return "(CASE " + " ".join(f"WHEN {m} = {k} THEN {v}" for k, v in sorted(SEASON_BY_MONTH.items())) + " END)"


def temporal(p: Profile = RESEARCH, date: str = "fire_date") -> dict[str, str]:
    dow = f"(isodow({date}) - 1)"
    return {"day_of_week": f"CAST({dow} AS INTEGER)", "month": f"CAST(month({date}) AS INTEGER)",
            "quarter": f"CAST(quarter({date}) AS INTEGER)", "season": season(f"month({date})"),
            "is_weekend": flag(f"{dow} >= 5", _t(p))}


def response_deltas() -> dict[str, str]:
    out = {n: f"({b} - {a})" for a, b, n in RESPONSE_PAIRS}
    out["total_response_time"] = "(t_extinguished_min - t_detect_min)"
    return out


def _cmp(x: str, op_val) -> str:
    return f"{x} {op_val[0]} {op_val[1]}"


def building_risk(p: Profile = RESEARCH) -> dict[str, str]:
    bf, ff = "CAST(building_floors AS DOUBLE)", "CAST(fire_floor AS DOUBLE)"
    ratio = (f"least(greatest({ff} / nullif({bf}, 0.0), -1.0), 2.0)" if p.ratio_clip
             else f"(CASE WHEN {bf} > 0 THEN {ff} / {bf} END)")
    top = f"({bf} > 0 AND {ff} = {bf})" if p.top_floor_needs_floors else f"({ff} = {bf})"
    t = _t(p)
    return {"fire_floor_ratio": ratio, "is_high_rise": flag(_cmp(bf, p.high_rise), t),
            "is_super_high_rise": flag(_cmp(bf, p.super_high), t), "basement_fire": flag(f"{ff} < 0", t),
            "top_floor_fire": flag(top, t)}


def distance(p: Profile = RESEARCH) -> dict[str, str]:
    d = "CAST(distance_to_station AS DOUBLE)"
    t = _t(p)
    return {"is_far": flag(_cmp(d, p.far), t), "is_very_far": flag(_cmp(d, p.very_far), t),
            "distance_category": cut(d, p.distance_edges)}


def severity_indicators() -> dict[str, str]:
    hf, hi, hd = flag("fatalities > 0"), flag("injuries > 0"), flag("direct_damage > 0")
    return {"has_fatalities": hf, "has_injuries": hi, "has_damage": hd, "severity_level": f"({hf} + {hi} + {hd})"}


def bins(p: Profile = RESEARCH, with_equipment: bool = True) -> dict[str, str]:
    out = {"building_floors_bin": cut("CAST(building_floors AS DOUBLE)", p.floor_edges)}
    if with_equipment:
        out["equipment_count_bin"] = cut("CAST(equipment_count AS DOUBLE)", p.equipment_edges)
    return out


def missing(cols, suffix_style="append", out_type="INTEGER") -> dict[str, str]:
    out = {}
    for c in cols:
        name = f"{c[:-5]}_missing" if suffix_style == "strip_code" and c.endswith("_code") else f"{c}_missing"
        out[name] = f"CAST({c} IS NULL AS {out_type})"
    return out


def select_list(d: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in d.items())


def all_features_ctes(src: str, add_severity: bool = False) -> list[str]:
    """``feat0`` (families) and ``feat`` (interactions) over ``src``."""
    fam = {**temporal(), **response_deltas(), **building_risk(), **distance(),
           **missing(["risk_category_code", "fpo_class_code"]), **bins(),
           **(severity_indicators() if add_severity else {})}
    replaced = ", ".join(k for k in fam if k in ("month",))
    excl = f" EXCLUDE ({replaced})" if replaced else ""
    return [f"feat0 AS (SELECT *{excl}, {select_list(fam)} FROM {src})",
            "feat AS (SELECT *, building_floors * distance_to_station AS floors_x_distance,\n"
            "  is_weekend * t_detect_min AS weekend_x_detect, is_high_rise * building_floors AS high_rise_x_floors FROM feat0)"]


def stage_ctes(src: str, resolved: str, stage: str) -> list[str]:
    """``stg``: contract-profile stage features over ``src``."""
    p = CONTRACT
    fam = {k: v for k, v in temporal(p).items() if k != "quarter"}
    fam.update({**building_risk(p), **bins(p, with_equipment=False), **distance(p)})
    fam["risk_category_missing"] = "CAST(risk_category_code IS NULL AS DOUBLE)"
    fam["fpo_class_missing"] = "CAST(fpo_class_code IS NULL AS DOUBLE)"
    if resolved == "enhanced_tactical":
        fam["delta_detect_to_report"] = "CAST(t_report_min - t_detect_min AS DOUBLE)"
    late = {"arrival_update", "first_hose_update", "retrospective"}
    fam["delta_report_to_arrival"] = ("CAST(t_arrival_min - t_report_min AS DOUBLE)" if stage in late
                                      else "CAST(NULL AS DOUBLE)")
    fam["delta_arrival_to_hose"] = ("CAST(t_first_hose_min - t_arrival_min AS DOUBLE)"
                                    if stage in {"first_hose_update", "retrospective"} else "CAST(NULL AS DOUBLE)")
    return [f"stg AS (SELECT * EXCLUDE (month), {select_list(fam)} FROM {src})"]


def twin_ctes(src: str) -> list[str]:
    p = TWIN
    fam = {**temporal(p), **response_deltas(), **building_risk(p), **bins(p, with_equipment=False), **distance(p)}
    fam["floors_x_distance"] = "building_floors * distance_to_station"
    inter = {"high_rise_x_floors": "is_high_rise * building_floors", "weekend_x_detect": "is_weekend * t_detect_min",
             "risk_category_missing": "CAST(risk_category_code IS NULL AS DOUBLE)",
             "fpo_class_missing": "CAST(fpo_class_code IS NULL AS DOUBLE)",
             "risk_category_code_missing": "CAST(risk_category_code IS NULL AS DOUBLE)",
             "fpo_class_code_missing": "CAST(fpo_class_code IS NULL AS DOUBLE)",
             "equipment_count_bin": cut("CAST(equipment_count AS DOUBLE)", p.equipment_edges)}
    return [f"tw0 AS (SELECT * EXCLUDE (month), {select_list(fam)} FROM {src})",
            f"tw AS (SELECT *, {select_list(inter)} FROM tw0)"]
