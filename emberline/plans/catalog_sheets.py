"""Registered queries: sheets exported from the incident view and read back through header harmonisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir
from ..sources import sheets as SH
from . import incidents as V
from . import sqlblocks as B
from .registry import register

# (header text, view column): other spellings, broken characters, a second copy of a column, unnamed and unknown columns.
_MERGED = [("N  п/п.", "row_id"), ("Unnamed: 1", "address"), ("Код региона� РФ", "region"), ("Дата  возникновения", "fire_date"),
           ("Вид нас. пункта", "settlement_type"), ("Вид пож. охраны", "fire_protection"), ("Тип предприятия", "enterprise_type"),
           ("ЭТАЖНОСТЬ", "building_floors"), ("Этаж, где возник пожар", "fire_floor"), ("Изделие", "source_item"),
           ("Расст. до пож. части", "distance_to_station"), ("Погибло: всего", "fatalities"), ("Получили травмы", "injuries"),
           ("Прямой ущерб, руб.", "direct_damage"), ("Прямой ущерб (копия)", "building_floors"), ("Обнаружение, время обнаруж.", "t_detect"),
           ("Время сообщения", "t_report"), ("Время прибытия", "t_arrival"), ("Техника, виды", "equipment"), ("Количество", "equipment_count"),
           ("Количество стволов", "nozzle_count"), ("Наименование объёкта", "object_name"), ("Почтовый адрес", "address"), ("Примечание", "region"), ("", None)]
_PERIOD = [(ru, en) for ru, en in S.RAW_COLUMNS if en in {c for _, c in _MERGED if c}]
_SHEETS = [(S.CANONICAL_SOURCE_SHEET, _MERGED, ["Сводная база", "по годам, 2000--2020", ""]), ("1...2000-2008", _PERIOD, ["Период"]), ("2...2009-2020", _PERIOD, ["Период"])]


def _filled() -> set[str]:
    return {c for _, c in _PERIOD}


def _s1_sql():
    cols = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c in _filled() else f"CAST(NULL AS VARCHAR) AS {c}" for c in S.EN_COLS)
    return B.with_(*V.sql_raw()) + f"SELECT {cols}, source_sheet FROM incidents WHERE source_sheet IN ({', '.join(B.q(s) for s, _, _ in _SHEETS)})"


@register("s1_sheet_harmonisation", sql=_s1_sql, ids=("S1", "S2"))
def s1_sheet_harmonisation(spark, sf):
    """All three sheets exported with title lines and messy headers, read back as canonical columns and united."""
    rows, out = V.raw(spark, sf), None
    for i, (sheet, headers, titles) in enumerate(_SHEETS):
        path = f"{_folder(spark)}/{i}"
        SH.write_sheet(rows.where(F.col("source_sheet") == sheet), path, titles, headers)
        one = SH.read_sheet(spark, path, sheet)
        out = one if out is None else out.unionByName(one)
    return out


def _folder(spark) -> str:
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheets/{uuid.uuid4().hex}"
