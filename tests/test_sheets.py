"""Header rules and reading of exported sheets."""

import pytest

from emberline import schema as S
from emberline.sources import sheets as SH
from emberline.streaming import scratch


@pytest.mark.parametrize(("header", "name"), [
    ("N п/п.", "N п/п"), (" n  П/п ", "N п/п"), ("Код региона", "Субъекты РФ"), ("Дата возникновения", "Дата возникновения пожара"),
    ("Дата и возникновение", None), ("Этажность (число)", "Этажность здания"), ("Этаж возникновения", "Этаж на котором возник пожар"),
    ("Расстояние до пож. части", "Расстояние до пожарной части"), ("Расстояние", None), ("пож.-спас. подразд.", "Расстояние до пожарной части"),
    ("Время ликвидации", "Время ликвидации"), ("Время ликвидации последствий", "Время ликвидации посл. пожара, час. мин."),
    ("Время подачи ствола", "Время подачи 1-го ствола"), ("Количество", "Количество техники"), ("Количество техники", "Количество техники"),
    ("Количество стволов", "Количество стволов"), ("Виды стволов", "Виды стволов"), ("Техника", "Техника"), ("Вся техника", None),
    ("Прим.", None), ("Наименование объёкта", "Наименование объекта"), ("Вид пожарной автоматики", "Вид пож. Охраны")])
def test_header_rules(header, name):
    assert SH.canonical_name(header) == name


def test_every_canonical_header_maps_to_itself_or_its_rule():
    assert SH.resolve_headers(S.RU_COLS) == {en: i for i, en in enumerate(S.EN_COLS)}


def test_first_of_doubled_headers_wins_and_unnamed_go():
    assert SH.resolve_headers(["Unnamed: 0", "Прямой ущерб", "прямой ущерб 2", None, "x"]) == {"direct_damage": 1}


def test_round_trip_with_quotes_and_header_row(spark):
    path = scratch(spark, "sheet")
    df = spark.createDataFrame([("1", 'a "b", c', None), ("2", "\\x", "5")], "row_id string, object_name string, building_floors string")
    SH.write_sheet(df, path, ["title, with comma"], [("N п/п", "row_id"), ("Наименование", "object_name"), ("Этажность", "building_floors"), ("Прочее", None)])
    out = SH.read_sheet(spark, path, "2...2009-2020")
    assert out.columns == [*S.EN_COLS, "source_sheet"]
    got = sorted((r["row_id"], r["object_name"], r["building_floors"], r["region"], r["source_sheet"]) for r in out.collect())
    assert got == [("1", 'a "b", c', None, None, "2...2009-2020"), ("2", "\\x", "5", None, "2...2009-2020")]
    with pytest.raises(ValueError):
        SH.read_sheet(spark, path, "2...", header=9)


def test_rows_like_title_lines_and_blank_rows_are_kept(spark):
    heads = [("N п/п", "row_id"), ("Этажность", "building_floors"), ("Прим.", None)]
    rows = [("7", "2"), ("Сводная база", None), ("N п/п", "Этажность"), (None, None), (None, None), ("7", "2")]
    df = spark.createDataFrame(rows, "row_id string, building_floors string").repartition(3)
    for titles in (["Сводная база", ",,", ""], ["Сводная база,,", "Сводная база", "7,2"]):
        path = scratch(spark, "sheet")
        SH.write_sheet(df, path, titles, heads)
        got = [(r["row_id"], r["building_floors"]) for r in SH.read_sheet(spark, path, "БД-1").collect()]
        assert sorted(got, key=str) == sorted(rows, key=str)
    # Title lines and rows in one part.
    path = scratch(spark, "sheet")
    spark.createDataFrame([("a,b",), ("N п/п,Этажность",), ("a,b",), (",",), ("N п/п,Этажность",)], "value string").coalesce(1).write.text(path)
    got = [(r["row_id"], r["building_floors"]) for r in SH.read_sheet(spark, path, "1...").collect()]
    assert sorted(got, key=str) == sorted([("a", "b"), (None, None), ("N п/п", "Этажность")], key=str)
