"""Harmonised reading of exported sheets.

A sheet is exported as a folder of CSV parts: the first part starts with a few title
lines, then the header, then rows; further parts hold rows only. The header is
resolved once, from the first lines of the first part; rows are then read, renamed
and projected in parallel with a schema of text columns.
"""

from __future__ import annotations

import csv
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

# FIXED VALUES (must equal the source application's): what a normalised, lower-cased header must be, start with, hold
# and not hold, and the canonical name it gets; the first line that fits wins.
# (is, starts with, holds all of, holds none of, name)
HEADER_RULES = [
    (["n п/п", "n п/п."], None, [], [], "N п/п"),
    ([], None, ["код региона"], [], "Субъекты РФ"),
    ([], None, ["субъект"], [], "Субъекты РФ"),
    ([], "дата возник", [], [], "Дата возникновения пожара"),
    ([], None, ["вид нас"], [], "Вид нас. Пункта"),
    ([], None, ["вид пож"], [], "Вид пож. Охраны"),
    ([], None, ["пож. охран"], [], "Вид пож. Охраны"),
    ([], None, ["категория риска"], [], "Категория риска объекта пожара"),
    ([], None, ["тип предпр"], [], "Тип предприятия"),
    ([], None, ["класс фпо"], [], "Класс ФПО"),
    ([], None, ["этажност"], [], "Этажность здания"),
    ([], None, ["этаж", "возник"], [], "Этаж на котором возник пожар"),
    ([], None, ["огнестойк"], [], "Степень огнестойкости"),
    ([], None, ["изделие"], [], "Изделие, устройство"),
    ([], None, ["расст", "част"], [], "Расстояние до пожарной части"),
    ([], None, ["пож.-спас"], [], "Расстояние до пожарной части"),
    ([], None, ["погибло"], [], "Погибло людей: Всего"),
    ([], None, ["травмы"], [], "Получили травмы: Всего"),
    ([], None, ["прямой ущерб"], [], "Прямой ущерб"),
    ([], None, ["спасено", "люд"], [], "Спасено на пожаре людей"),
    ([], None, ["эвакуир"], [], "Эвакуировано на пожаре людей"),
    ([], None, ["материальных ценност"], [], "Материальных ценностей"),
    ([], None, ["обнаруж"], [], "Время обнаружения"),
    ([], None, ["сообщ"], [], "Время сообщения"),
    ([], None, ["прибытия"], [], "Время прибытия 1-го пож.подразд-ния"),
    ([], None, ["подачи", "ствол"], [], "Время подачи 1-го ствола"),
    ([], None, ["локализ"], [], "Время локализации"),
    ([], None, ["ликвидации", "посл"], [], "Время ликвидации посл. пожара, час. мин."),
    ([], None, ["ликвидации"], [], "Время ликвидации"),
    ([], "техник", [], [], "Техника"),
    ([], None, ["количество техник"], [], "Количество техники"),
    ([], "количество", [], ["ствол"], "Количество техники"),
    ([], None, ["ствол"], ["количество"], "Виды стволов"),
    ([], None, ["количество ствол"], [], "Количество стволов"),
    ([], None, ["количество .1"], [], "Количество стволов"),
    ([], None, ["огнетуш"], [], "Огнетушащие средства"),
    ([], None, ["первич"], [], "Первичные средства"),
    ([], None, ["сизод"], [], "Использование СИЗОД"),
    ([], None, ["водоснабж"], [], "Водоисточники"),
    ([], None, ["водоисточ"], [], "Водоисточники"),
    ([], None, ["ауп"], [], "Вид АУП"),
    ([], None, ["пожарной автоматик"], [], "Вид АУП"),
    ([], None, ["наименован"], [], "Наименование объекта"),
    ([], None, ["почтовый адрес"], [], "Почтовый адрес"),
]
UNNAMED = "Unnamed"
# end of fixed values


def normalise_header(text: str | None) -> str:
    """Broken characters and runs of white space as one space, trimmed."""
    return re.sub(r"\s+", " ", (text or "").replace("�", " ")).strip()


def canonical_name(header: str) -> str | None:
    """The canonical column of a sheet header, None if no rule fits."""
    low = normalise_header(header).lower().replace("ё", "е")
    for same, start, every, none, name in HEADER_RULES:
        fits = low in same if same else (start is None or low.startswith(start)) and all(x in low for x in every)
        if fits and not any(x in low for x in none):
            return name
    return None


def resolve_headers(headers: list[str | None]) -> dict[str, int]:
    """Canonical English column -> position of the first header that maps to it. Unnamed and unknown headers map to nothing."""
    found: dict[str, int] = {}
    for i, h in enumerate(headers):
        text = normalise_header(h)
        if text and not text.startswith(UNNAMED) and (name := canonical_name(text)):
            found.setdefault(S.RU_TO_EN[name], i)
    return found


def header_row(sheet: str) -> int:
    return next((row for prefix, row in S.HEADER_ROW_BY_PREFIX if sheet.startswith(prefix)), S.DEFAULT_HEADER_ROW)


def read_sheet(spark: SparkSession, path: str, sheet: str, header: int | None = None) -> DataFrame:
    """The 37 canonical columns of an exported sheet as text, missing ones null, with ``source_sheet``.

    ``header`` is the 0-based line of the header, by default that of the sheet's name.
    Title and header lines are told by file and position: of the first block of the
    first part, the first rows that equal them are left out, as many as there are
    such lines. Data rows that equal one, and rows without any value, are kept;
    lines without any character are no rows.
    """
    at = header_row(sheet) if header is None else header
    first = spark.read.text(f"{path}/part-00000*").select("value", F.col("_metadata.file_name").alias("file")).limit(at + 1).collect()
    if len(first) <= at:
        raise ValueError(f"{path} has no header line {at}")
    above = [next(csv.reader([r["value"]], escapechar="\\"), []) for r in first]
    width = len(above[at])
    names = [f"c{i}" for i in range(width)]
    rows = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("mode", "PERMISSIVE").csv(path)
    whole = F.concat_ws("\x1f", *[F.coalesce(F.col(n), F.lit("")) for n in names])
    # The reader itself leaves out lines of white space alone.
    times = Counter("\x1f".join((cells + [""] * width)[:width]) for r, cells in zip(first, above, strict=True) if r["value"].strip())
    head = (F.col("_metadata.file_name") == first[0]["file"]) & (F.col("_metadata.file_block_start") == 0)
    like = whole.isin(list(times))
    n_times = F.coalesce(*[F.when(F.col("whole") == t, F.lit(n)) for t, n in times.items()], F.lit(0))
    # Only rows that equal a title line are numbered; ids rise with the place in the file.
    nth = F.row_number().over(Window.partitionBy("whole").orderBy("place"))
    again = rows.where(head & like).select(*names, whole.alias("whole"), F.monotonically_increasing_id().alias("place")).select(*names, "whole", nth.alias("nth"))
    kept = rows.where(~(head & like)).select(*names).unionByName(again.where(F.col("nth") > n_times).select(*names))
    found = resolve_headers(above[at])
    cols = [F.col(names[found[c]]).alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in S.EN_COLS]
    return kept.select(*cols, F.lit(sheet).alias("source_sheet"))


def write_sheet(df: DataFrame, path: str, titles: list[str], headers: list[tuple[str, str | None]]) -> None:
    """Export ``df`` as a sheet: title lines, a header line, then rows; ``headers`` are (header text, column or None)."""
    quoted = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    cells = [quoted(F.col(c).cast("string")) if c else F.lit("") for _, c in headers]
    body = df.select(F.concat_ws(",", *cells).alias("value"))
    head = ",".join('"' + h.replace('"', '\\"') + '"' for h, _ in headers)
    first = df.sparkSession.createDataFrame([(x,) for x in (*titles, head)], "value string").coalesce(1)
    first.unionByName(body).write.text(path)
