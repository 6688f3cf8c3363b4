"""Column expressions for text fields: codes, normalisation, times of day.

All of them are native Catalyst expressions, without Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time of day: "<h>[non-digits]<m>" at the end of the text, searched anywhere.
TIME_PATTERN = r"([0-9]{1,2})[^0-9]+([0-9]{1,2})$"
HOURS_ONLY_PATTERN = r"^[0-9]{1,2}$"
STRICT_TIME_PATTERN = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$"
# The characters of Unicode's White_Space property, which ``(?U)\s`` matches.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _as_text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def strip(c: Column | str) -> Column:
    """Unicode-aware strip (Spark ``trim`` alone only removes ASCII spaces)."""
    return F.btrim(_as_text(c), F.lit(WHITE_SPACE))


def first_int(c: Column | str) -> Column:
    """First run of digits in the text as a double; null when there is none."""
    # Without digits the extract is '', which is no number.
    return F.regexp_extract(_as_text(c), r"([0-9]+)", 1).try_cast("double")


def norm_text(c: Column | str) -> Column:
    """strip + lower; null stays null."""
    return F.lower(strip(c))


def norm_free_text(c: Column | str) -> Column:
    """strip + lower + collapse inner whitespace; null becomes ''."""
    collapsed = F.regexp_replace(F.lower(strip(c)), f"[{WHITE_SPACE}]+", " ")
    return F.coalesce(collapsed, F.lit(""))


def _time_parts(c: Column | str, mode: str):
    s = strip(c)
    if mode == "strict":
        ok = s.rlike(STRICT_TIME_PATTERN)
        h = F.regexp_extract(s, STRICT_TIME_PATTERN, 1).try_cast("int")
        m = F.regexp_extract(s, STRICT_TIME_PATTERN, 2).try_cast("int")
        return s, ok, h, m, F.lit(False), F.lit(None).cast("int")
    hours = F.regexp_extract(s, TIME_PATTERN, 1)
    pair, h = hours != "", hours.try_cast("int")  # a pair has an hour digit
    m = F.regexp_extract(s, TIME_PATTERN, 2).try_cast("int")
    hours_only = s.rlike(HOURS_ONLY_PATTERN)
    h_only = s.try_cast("int")
    return s, pair, h, m, hours_only, h_only


def time_minutes(c: Column | str, mode: str = "reference") -> Column:
    """Minutes since midnight; null for missing or invalid input.

    ``reference``: the "<h>…<m>" pair is taken from the end of the text wherever it
    starts (so ``10:20:00`` reads as 20:00), a bare 1–2 digit value is hours, and
    anything else is invalid. ``strict``: only ``HH:MM`` or ``HH:MM:SS``.
    """
    s, pair, h, m, hours_only, h_only = _time_parts(c, mode)
    return (F.when(s.isNull(), None)
            .when(pair, F.when((h < 24) & (m < 60), h * 60 + m))
            .when(hours_only, F.when(h_only < 24, h_only * 60)))


def time_invalid(c: Column | str, mode: str = "reference") -> Column:
    """True when a present value cannot be read as a time of day; null input is valid."""
    s, pair, h, m, hours_only, h_only = _time_parts(c, mode)
    return (F.when(s.isNull(), F.lit(False))
            .when(pair, (h >= 24) | (m >= 60))
            .when(hours_only, h_only >= 24)
            .otherwise(F.lit(True)))
