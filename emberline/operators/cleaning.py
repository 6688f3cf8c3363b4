"""Cleaning and quality flags (one lazy projection plus two scalar statistics).

``clean`` is projections over the raw table, without a shuffle. The only
data-dependent inputs are three severity quartiles and the 99.5th damage
percentile; they come from :mod:`emberline.operators.quantiles` (distributed,
exact) and enter the plan as literals. Queries that need neither the severity rank
nor the damage flag start from ``clean_stage1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import first_int, norm_text, strip, time_invalid, time_minutes
from .quantiles import percentile_values


def ensure_columns(df: DataFrame, names: list[str], dtype: str = "string") -> DataFrame:
    """Add every missing column as a typed null (schema stays stable)."""
    missing = [c for c in names if c not in df.columns]
    if not missing:
        return df
    return df.select("*", *[F.lit(None).cast(dtype).alias(c) for c in missing])


def sheet_period(c: Column | str) -> Column:
    name = F.col(c) if isinstance(c, str) else c
    expr = F.lit("other")
    for prefix, period in reversed(S.PERIOD_BY_PREFIX):
        expr = F.when(name.startswith(prefix), F.lit(period)).otherwise(expr)
    return expr


def source_priority(c: Column | str) -> Column:
    """Ordered substring rules over the lower-cased, stripped sheet name."""
    name = F.lower(strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    expr = F.lit(S.DEFAULT_SOURCE_PRIORITY)
    for needle, prio in reversed(S.SOURCE_PRIORITY):
        expr = F.when(name.contains(needle), F.lit(prio)).otherwise(expr)
    return expr


def period_group(year: Column | str, split_year: int = 2008) -> Column:
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y.isNull(), None).when(y <= split_year, F.lit(f"<={split_year}")).otherwise(F.lit(f">{split_year}"))


def _falsy(c: Column) -> Column:
    """pandas comparison semantics: a missing operand compares False."""
    return F.coalesce(c, F.lit(False))


def clean_stage1(df: DataFrame, time_mode: str = "reference") -> DataFrame:
    """Dates, codes, texts, numerics, times, severity and row-local flags."""
    df = ensure_columns(df, S.EN_COLS)
    date_raw = F.col("fire_date")
    if dict(df.dtypes)["fire_date"] == "string":
        date_raw = F.to_date(F.try_to_timestamp(strip(date_raw)))
    else:
        date_raw = date_raw.cast("date")
    year = F.year(date_raw)
    date_outlier = _falsy((year < S.MIN_YEAR) | (year > S.MAX_YEAR))

    passthrough = [c for c in df.columns if c not in set(S.NUM_COLS) | {"fire_date"}]
    cols: list[Column] = [F.col(c) for c in passthrough]
    cols += [F.when(~date_outlier, date_raw).alias("fire_date"),
             F.when(~date_outlier, year).alias("year"),
             F.when(~date_outlier, F.month(date_raw)).alias("month"),
             date_outlier.alias("flag_date_outlier")]
    for c in S.CODE_COLS:
        cols += [first_int(c).alias(f"{c}_code"), norm_text(c).alias(f"{c}_text")]
    for c in S.NUM_COLS:
        if c in ("equipment_count", "nozzle_count"):
            cols.append(first_int(c).alias(c))
        else:
            cols.append(F.col(c).cast("string").try_cast("double").alias(c) if dict(df.dtypes)[c] == "string"
                        else F.col(c).cast("double").alias(c))
    for c in S.TIME_COLS:
        cols += [time_minutes(c, time_mode).alias(f"{c}_min"), time_invalid(c, time_mode).alias(f"{c}_invalid")]
    out = df.select(*cols)

    dmg = F.col("direct_damage")
    dmg_log = F.when(dmg > -1, F.log1p(dmg))
    severity = F.coalesce(F.col("fatalities"), F.lit(0.0)) * 5 + F.coalesce(F.col("injuries"), F.lit(0.0)) * 2 + dmg_log
    all_missing = F.col("fatalities").isNull() & F.col("injuries").isNull() & dmg.isNull()
    neg = None
    for c in S.NUM_COLS:
        term = _falsy(F.col(c) < 0)
        neg = term if neg is None else (neg | term)
    t_any = None
    for c in S.TIME_COLS:
        term = F.col(f"{c}_invalid")
        t_any = term if t_any is None else (t_any | term)
    return out.select(
        "*",
        dmg_log.alias("direct_damage_log"),
        F.when(~all_missing, severity).alias("severity_score"),
        _falsy(F.col("building_floors") > S.MAX_FLOORS).alias("flag_floor_outlier"),
        _falsy(F.col("distance_to_station") > S.MAX_DISTANCE).alias("flag_distance_outlier"),
        _falsy(F.col("fire_floor") > F.col("building_floors")).alias("flag_floor_inconsistent"),
        neg.alias("flag_negative_values"),
        t_any.alias("flag_time_invalid"),
        all_missing.alias("flag_missing_outputs"),
    )


def severity_quantiles(stage1: DataFrame) -> dict[float, float]:
    found = percentile_values(stage1.where(F.col("severity_score") > 0), "severity_score", [0.25, 0.5, 0.75])
    return {p: v for (_, p), v in found.items()}


def damage_limit(stage1: DataFrame, q: float = S.DAMAGE_OUTLIER_QUANTILE) -> float | None:
    return percentile_values(stage1, "direct_damage", [q]).get(("direct_damage", q))


def severity_rank(score: Column | str, quartiles: dict[float, float]) -> Column:
    """0 -> 1; positive -> 2..5 by the quartiles of the positive scores; else null."""
    s = F.col(score) if isinstance(score, str) else score
    if not quartiles:
        return F.when(s == 0, F.lit(1.0))
    positive = (F.when(s <= quartiles[0.25], F.lit(2.0)).when(s <= quartiles[0.5], F.lit(3.0))
                .when(s <= quartiles[0.75], F.lit(4.0)).otherwise(F.lit(5.0)))
    return F.when(s == 0, F.lit(1.0)).when(s > 0, positive)


def cleaning_statistics(stage1: DataFrame) -> tuple[dict[float, float], float | None]:
    """Severity quartiles (positive scores) and the damage outlier limit in one pass set."""
    both = stage1.select(F.when(F.col("severity_score") > 0, F.col("severity_score")).alias("sev_pos"),
                         "direct_damage")
    found = percentile_values(both, ["sev_pos", "direct_damage"], [0.25, 0.5, 0.75, S.DAMAGE_OUTLIER_QUANTILE])
    q = {p: v for (c, p), v in found.items() if c == "sev_pos" and p < 0.9}
    return q, found.get(("direct_damage", S.DAMAGE_OUTLIER_QUANTILE))


def clean(df: DataFrame, time_mode: str = "reference") -> DataFrame:
    """Typed, flagged incident table (identity is added by :func:`identity.event_identity`)."""
    stage1 = clean_stage1(df, time_mode)
    q, limit = cleaning_statistics(stage1)
    flag_damage = (_falsy(F.col("direct_damage") > F.lit(limit)) if limit is not None else F.lit(False))
    return stage1.select("*", severity_rank("severity_score", q).alias("rank_ref"),
                         flag_damage.alias("flag_damage_outlier"))


def quality_report(cleaned: DataFrame) -> DataFrame:
    """One-row report: invalid counts per time column and flag counts (+identity coverage if present)."""
    aggs = [F.count_if(F.col(f"{c}_invalid")).alias(f"invalid_{c}") for c in S.TIME_COLS]
    for flag in ["flag_floor_outlier", "flag_distance_outlier", "flag_floor_inconsistent",
                 "flag_negative_values", "flag_damage_outlier", "flag_missing_outputs", "flag_date_outlier",
                 "flag_time_invalid"]:
        aggs.append(F.count_if(F.col(flag)).alias(flag.replace("flag_", "n_")))
    if "is_canonical_event_record" in cleaned.columns:
        aggs += [F.count_if(F.col("is_canonical_event_record")).alias("canonical_rows"),
                 F.count_if(~F.col("is_canonical_event_record")).alias("duplicate_rows"),
                 F.round(F.avg(F.col("event_id").isNotNull().cast("double")) * 100, 6).alias("event_id_coverage_pct")]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    return cleaned.agg(*aggs)
