"""Named feature sets, field kinds and availability policies.

The FIXED VALUES block must equal the source application's definitions.
"""

from __future__ import annotations

from . import schema as S

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source application's definitions)
# ---------------------------------------------------------------------------

_ONLINE_BASE = ["region_code", "settlement_type_code", "fire_protection_code", "enterprise_type_code",
                "building_floors", "fire_floor", "fire_resistance_code", "source_item_code", "distance_to_station"]
_ENHANCED = ["day_of_week", "month", "season", "is_weekend", "is_high_rise", "is_super_high_rise", "basement_fire",
             "top_floor_fire", "fire_floor_ratio", "is_far", "is_very_far", "distance_category",
             "building_floors_bin", "risk_category_code_missing", "fpo_class_code_missing"]

# Training feature sets (research trainer).
TRAINING_SETS = {
    "minimal": ["region_code", "building_floors", "fire_floor"],
    "managed": ["region_code", "settlement_type_code", "fire_protection_code", "risk_category_code",
                "enterprise_type_code", "fpo_class_code", "building_floors", "fire_floor", "fire_resistance_code",
                "source_item_code", "distance_to_station"],
    "observed": ["region_code", "building_floors", "fire_floor", "fatalities", "injuries", "direct_damage",
                 "people_saved", "people_evacuated"],
    "time": ["t_detect_min", "t_report_min", "t_arrival_min", "t_first_hose_min", "t_contained_min",
             "t_extinguished_min"],
    "full": ["region_code", "settlement_type_code", "fire_protection_code", "risk_category_code",
             "enterprise_type_code", "fpo_class_code", "building_floors", "fire_floor", "fire_resistance_code",
             "source_item_code", "distance_to_station", "fatalities", "injuries", "direct_damage", "people_saved",
             "people_evacuated", "t_detect_min", "t_report_min", "t_arrival_min", "t_first_hose_min",
             "t_contained_min", "t_extinguished_min"],
    "online_dispatch": _ONLINE_BASE,
    "online_early": _ONLINE_BASE + ["t_detect_min", "t_report_min", "t_arrival_min"],
    "online_tactical": _ONLINE_BASE + ["t_detect_min", "t_report_min", "t_arrival_min", "t_first_hose_min"],
    "enhanced_dispatch": _ONLINE_BASE + _ENHANCED,
    "enhanced_early": _ONLINE_BASE + _ENHANCED + ["t_detect_min", "t_report_min", "t_arrival_min",
                                                  "delta_detect_to_report", "delta_report_to_arrival"],
    "enhanced_tactical": _ONLINE_BASE + _ENHANCED + ["t_detect_min", "t_report_min", "t_arrival_min",
                                                     "t_first_hose_min", "delta_detect_to_report",
                                                     "delta_report_to_arrival", "delta_arrival_to_hose"],
}
ONLINE_TRAINING_SETS = {"online_dispatch", "online_early", "online_tactical"}
DEFAULT_INDICATOR_COLUMNS = ["risk_category_code", "fpo_class_code"]

# Contract feature sets: (feature order, availability stage, default fill strategy, offline only).
_CONTRACT_BASE = ["region_code", "settlement_type_code", "fire_protection_code", "enterprise_type_code",
                  "building_floors", "fire_floor", "fire_resistance_code"]
CONTRACT_SETS = {
    "basic": (["building_floors", "fire_floor", "distance_to_station", "fatalities", "injuries", "direct_damage"],
              S.STAGE_RETROSPECTIVE, "constant", True),
    "dispatch_initial_safe": (_CONTRACT_BASE + ["distance_to_station", "t_detect_min", "t_report_min"],
                              S.STAGE_DISPATCH, "median", False),
    "arrival_update_safe": (_CONTRACT_BASE + ["source_item_code", "distance_to_station", "t_detect_min",
                                              "t_report_min", "t_arrival_min", "delta_report_to_arrival"],
                            S.STAGE_ARRIVAL, "median", False),
    "first_hose_update_safe": (_CONTRACT_BASE + ["source_item_code", "distance_to_station", "t_detect_min",
                                                 "t_report_min", "t_arrival_min", "delta_report_to_arrival",
                                                 "t_first_hose_min", "delta_arrival_to_hose"],
                               S.STAGE_FIRST_HOSE, "median", False),
    "retrospective_benchmark": (_CONTRACT_BASE + ["source_item_code", "distance_to_station", "fatalities",
                                                  "injuries", "direct_damage", "t_detect_min", "t_report_min",
                                                  "t_arrival_min", "t_first_hose_min", "t_contained_min",
                                                  "t_extinguished_min"],
                                S.STAGE_RETROSPECTIVE, "median", True),
    "enhanced_tactical": (_CONTRACT_BASE + ["source_item_code", "distance_to_station", "day_of_week", "month",
                                            "season", "is_weekend", "is_high_rise", "is_super_high_rise",
                                            "basement_fire", "top_floor_fire", "fire_floor_ratio", "is_far",
                                            "is_very_far", "distance_category", "building_floors_bin",
                                            "risk_category_missing", "fpo_class_missing", "t_detect_min",
                                            "t_report_min", "t_arrival_min", "t_first_hose_min",
                                            "delta_detect_to_report", "delta_report_to_arrival",
                                            "delta_arrival_to_hose"],
                          S.STAGE_RETROSPECTIVE, "median", True),
    "online_tactical": (_CONTRACT_BASE + ["source_item_code", "distance_to_station", "t_detect_min",
                                          "t_report_min", "t_arrival_min", "t_first_hose_min"],
                        S.STAGE_FIRST_HOSE, "median", False),
}
LEGACY_SET_ALIASES = {"online_tactical": "first_hose_update_safe"}
STAGE_FEATURE_SETS = {"enhanced_tactical", "arrival_update_safe", "first_hose_update_safe"}

# Field kind for the preprocessor: categorical / ordinal; everything else numeric.
CATEGORICAL_FIELDS = ["region_code", "settlement_type_code", "fire_protection_code", "enterprise_type_code",
                      "fire_resistance_code", "source_item_code"]
ORDINAL_FIELDS = ["building_floors", "fire_floor"]
# Fields that always get a missing indicator.
ALWAYS_INDICATOR_FIELDS = ["settlement_type_code", "fire_protection_code", "enterprise_type_code",
                           "building_floors", "fire_floor", "fire_resistance_code", "source_item_code",
                           "distance_to_station", "t_detect_min", "t_report_min", "t_arrival_min",
                           "t_first_hose_min"]
ONE_HOT_MAX_DISTINCT = 10
MISSING_TOKEN = "__missing__"

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------


def field_kind(name: str) -> str:
    if name in CATEGORICAL_FIELDS:
        return "categorical"
    if name in ORDINAL_FIELDS:
        return "ordinal"
    return "numeric"
