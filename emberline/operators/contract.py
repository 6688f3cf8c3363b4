"""Stage contract checks.

All three are row-level Column expressions or one aggregate pass, and never shuffle
more than a one-row aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

# Required (non-missing) fields per availability stage.
STAGE_REQUIRED = {
    S.STAGE_ARRIVAL: ["t_arrival_min"],
    S.STAGE_FIRST_HOSE: ["t_arrival_min", "t_first_hose_min"],
}


def missing_for_stage(stage: str) -> Column:
    """array<string> of the stage's required fields that are missing in this row (in field order)."""
    req = STAGE_REQUIRED.get(stage, [])
    checks = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in req]
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")


def forbidden_features(features: Column, stage: str) -> Column:
    """Sorted features not allowed at ``stage`` (only the dispatch stage forbids any)."""
    if stage != S.STAGE_DISPATCH:
        return F.array().cast("array<string>")
    banned = F.array(*[F.lit(c) for c in S.DISPATCH_FORBIDDEN_FIELDS])
    return F.array_sort(F.array_intersect(features, banned))


def production_safe(features: Column, stage: str) -> Column:
    """The feature list has no forbidden feature for ``stage``."""
    return F.size(forbidden_features(features, stage)) == 0


def first_failing_rule(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule (in order) whose condition holds; null when none does."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def apply_rejection_rules(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(surviving rows, removal log).

    Rules apply in order and each counts only rows that survived the earlier
    ones, i.e. the rows whose *first* failing rule it is. The log is one
    aggregate pass: per-rule counts, unpivoted, with the rows remaining after
    each step.
    """
    tagged = df.withColumn("_rule", first_failing_rule(rules))
    kept = tagged.where(F.col("_rule").isNull()).drop("_rule")
    counts = tagged.agg(F.count(F.lit(1)).alias("_n"),
                        *[F.count_if(F.col("_rule") == name).alias(f"_r{i}") for i, (name, _) in enumerate(rules)])
    stack = ", ".join(f"{i + 1}, '{name}', _r{i}" for i, (name, _) in enumerate(rules))
    cumulative = F.aggregate(F.slice(F.array(*[F.col(f"_r{i}") for i in range(len(rules))]), 1, F.col("step")),
                             F.lit(0).cast("bigint"), lambda a, x: a + x)
    log = counts.selectExpr("*", f"stack({len(rules)}, {stack}) AS (step, rule, removed)")
    return kept, log.select(F.col("step").cast("int").alias("step"), "rule", "removed",
                            (F.col("_n") - cumulative).alias("remaining"))


def default_rejection_rules() -> list[tuple[str, Column]]:
    """The four removal rules, in order: later exact copies, date outside the window, negatives, floor > floors."""
    return [("dup_flag", F.col("is_exact_duplicate")), ("flag_date_outlier", F.col("flag_date_outlier")),
            ("flag_negative_values", F.col("flag_negative_values")),
            ("flag_floor_inconsistent", F.col("flag_floor_inconsistent"))]


# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source application's definitions)
# ---------------------------------------------------------------------------

PRODUCTION_ROLE_WHITELIST = ["rank_tz_lpr_dispatch_production"]
PRODUCTION_SAFE_SPLITS = ["group_shuffle", "group_kfold", "temporal_holdout"]
DEFAULT_LPR_FEATURE_SET = "dispatch_initial_safe"
LEGACY_FEATURE_SET = "online_tactical"

# Reasons a model may not serve the dispatch screen, in the order the rules are checked.
UNSAFE_REASONS = [
    "модель обучена не для ранга пожара",
    "модель помечена как исследовательская или архивная",
    "модель не предназначена для рабочего экрана ЛПР",
    "стадия данных не подходит для прогноза до прибытия подразделения",
    "используется неподходящий тип целевой разметки",
    "набор признаков не совпадает с рабочей формой ЛПР",
    "модель использует устаревшую схему признаков",
    "схема разделения выборки не подходит для рабочего контура",
    "в проверке качества есть пересечение одних и тех же событий",
    "не найден файл подготовки признаков",
    "нет версии схемы обучения",
    "нет версии нормативов",
    "не описана входная форма модели",
    "в признаках есть поля, недопустимые для прогноза ЛПР",
]

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def unsafe_reasons(passports: DataFrame) -> DataFrame:
    """Per model passport, the failed production rules (in rule order) and ``production_safe``.

    Expected passport columns: target, offline_only, deployment_role, availability_stage,
    semantic_target, feature_set, legacy_alias, split_protocol, event_overlap_rate,
    preprocessor_path, training_schema_version, normative_version, input_schema, features.
    """
    def isnt(c: str, value: str) -> Column:
        return ~F.coalesce(F.col(c) == F.lit(value), F.lit(False))

    def not_in(c: str, values: list[str]) -> Column:
        return ~F.coalesce(F.col(c).isin(*values), F.lit(False))

    dispatch = F.coalesce(F.col("availability_stage") == F.lit(S.STAGE_DISPATCH), F.lit(False))
    checks = [
        isnt("target", "rank_tz"),
        F.coalesce(F.col("offline_only"), F.lit(False)),
        not_in("deployment_role", PRODUCTION_ROLE_WHITELIST),
        ~dispatch,
        isnt("semantic_target", "rank_tz_vector"),
        isnt("feature_set", DEFAULT_LPR_FEATURE_SET),
        F.coalesce(F.col("feature_set") == F.lit(LEGACY_FEATURE_SET), F.lit(False)) | ~_blank("legacy_alias"),
        not_in("split_protocol", PRODUCTION_SAFE_SPLITS),
        F.coalesce(F.col("event_overlap_rate").cast("double"), F.lit(1.0)) != 0.0,
        _blank("preprocessor_path"),
        _blank("training_schema_version"),
        _blank("normative_version"),
        _blank("input_schema"),
        dispatch & ~production_safe(F.coalesce(F.col("features"), F.array().cast("array<string>")), S.STAGE_DISPATCH),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in zip(checks, UNSAFE_REASONS)]),
                       lambda x: x.isNotNull())
    return passports.withColumn("unsafe_reasons", reasons) \
        .withColumn("production_safe", F.size("unsafe_reasons") == 0)
