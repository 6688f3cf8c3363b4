"""Column sets, domains and limits of the incident data model.

Everything in the FIXED VALUES block below must equal the source application's
definitions for results to line up; it is stated as plain data in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source application's definitions)
# ---------------------------------------------------------------------------

# The 37 raw sheet columns, in canonical order, as (sheet header, English name).
RAW_COLUMNS = [
    ("N п/п", "row_id"),
    ("Субъекты РФ", "region"),
    ("Дата возникновения пожара", "fire_date"),
    ("Вид нас. Пункта", "settlement_type"),
    ("Вид пож. Охраны", "fire_protection"),
    ("Категория риска объекта пожара", "risk_category"),
    ("Тип предприятия", "enterprise_type"),
    ("Класс ФПО", "fpo_class"),
    ("Этажность здания", "building_floors"),
    ("Этаж на котором возник пожар", "fire_floor"),
    ("Степень огнестойкости", "fire_resistance"),
    ("Изделие, устройство", "source_item"),
    ("Расстояние до пожарной части", "distance_to_station"),
    ("Погибло людей: Всего", "fatalities"),
    ("Получили травмы: Всего", "injuries"),
    ("Прямой ущерб", "direct_damage"),
    ("Спасено на пожаре людей", "people_saved"),
    ("Эвакуировано на пожаре людей", "people_evacuated"),
    ("Материальных ценностей", "assets_saved"),
    ("Время обнаружения", "t_detect"),
    ("Время сообщения", "t_report"),
    ("Время прибытия 1-го пож.подразд-ния", "t_arrival"),
    ("Время подачи 1-го ствола", "t_first_hose"),
    ("Время локализации", "t_contained"),
    ("Время ликвидации", "t_extinguished"),
    ("Время ликвидации посл. пожара, час. мин.", "t_final_extinguish"),
    ("Техника", "equipment"),
    ("Количество техники", "equipment_count"),
    ("Виды стволов", "nozzle_types"),
    ("Количество стволов", "nozzle_count"),
    ("Огнетушащие средства", "extinguishing_agents"),
    ("Первичные средства", "initial_means"),
    ("Использование СИЗОД", "respirators_use"),
    ("Водоисточники", "water_sources"),
    ("Вид АУП", "alarm_type"),
    ("Наименование объекта", "object_name"),
    ("Почтовый адрес", "address"),
]

TIME_COLS = ["t_detect", "t_report", "t_arrival", "t_first_hose", "t_contained",
             "t_extinguished", "t_final_extinguish"]

CODE_COLS = ["region", "settlement_type", "fire_protection", "risk_category", "enterprise_type",
             "fpo_class", "fire_resistance", "source_item", "equipment", "nozzle_types",
             "extinguishing_agents", "initial_means", "respirators_use", "water_sources", "alarm_type"]

NUM_COLS = ["building_floors", "fire_floor", "distance_to_station", "fatalities", "injuries",
            "direct_damage", "people_saved", "people_evacuated", "assets_saved",
            "equipment_count", "nozzle_count"]

OUTPUT_COLS = ["fatalities", "injuries", "direct_damage"]

MAX_FLOORS = 150
MAX_DISTANCE = 1000
MIN_YEAR = 2000
MAX_YEAR = 2020
DAMAGE_OUTLIER_QUANTILE = 0.995

# Sheet-name prefix -> period label, checked in this order.
PERIOD_BY_PREFIX = [("1...", "2000-2008"), ("2...", "2009-2020"), ("БД-1", "2000-2020 (склеено)")]
# Sheet-name prefix -> header row index of the exported sheet.
HEADER_ROW_BY_PREFIX = [("БД-1", 3)]
DEFAULT_HEADER_ROW = 1
# The merged sheet every canonical training row comes from.
CANONICAL_SOURCE_SHEET = "БД-1...2000--2020 (1+2)"
# Substring of the lower-cased sheet name -> source priority, checked in this order.
SOURCE_PRIORITY = [("lpr_manual_input", 110), ("бд-1", 100), ("1...", 80), ("2...", 90)]
DEFAULT_SOURCE_PRIORITY = 10

# Identity key parts, in fingerprint order.
IDENTITY_KEY_PARTS = ["row_id", "fire_date", "year", "region_code", "settlement_type_code",
                      "enterprise_type_code", "building_floors", "fire_floor", "object_name", "address"]
# Columns counted by the canonical-record completeness score.
COMPLETENESS_COLUMNS = ["row_id", "fire_date", "year", "region_code", "settlement_type_code",
                        "enterprise_type_code", "building_floors", "fire_floor", "object_name",
                        "address", "equipment", "equipment_count", "nozzle_count"]
# Fields whose disagreement inside a duplicate group marks the group as a conflict.
CONFLICT_FIELDS = ["equipment", "equipment_count", "nozzle_count", "source_item_code"]
LOW_CONFIDENCE_MIN_PARTS = 5

# Rank domain and class ids.
RANK_TO_CLASS = [(1.0, 1), (1.5, 2), (2.0, 3), (3.0, 4), (4.0, 5), (5.0, 6)]

# Label sources.
LABEL_SOURCE_HISTORICAL_VECTOR = "historical_vector"
LABEL_SOURCE_DECISION = "lpr_decision"
LABEL_SOURCE_PROXY_BOOTSTRAP = "proxy_bootstrap"
LABEL_SOURCE_RESEARCH_ONLY = "research_only"

# Availability stages.
STAGE_DISPATCH = "dispatch_initial"
STAGE_ARRIVAL = "arrival_update"
STAGE_FIRST_HOSE = "first_hose_update"
STAGE_RETROSPECTIVE = "retrospective"

# Fields that must not be used by a dispatch-stage model.
DISPATCH_FORBIDDEN_FIELDS = ["source_item_code", "t_arrival_min", "t_first_hose_min", "t_contained_min",
                             "t_extinguished_min", "fatalities", "injuries", "direct_damage",
                             "equipment_count", "nozzle_count", "rank_tz_count_proxy", "predicted_rank"]

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------

RU_COLS = [ru for ru, _ in RAW_COLUMNS]
EN_COLS = [en for _, en in RAW_COLUMNS]
RU_TO_EN = dict(RAW_COLUMNS)


def raw_schema() -> T.StructType:
    """Every raw sheet column arrives as text; typing happens in cleaning."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in EN_COLS])
