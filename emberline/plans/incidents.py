"""Shared stages of the incident flow, on the Spark side and as oracle CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean, clean_stage1
from ..operators.identity import event_identity
from ..operators.resources import assign_rank
from ..sources.incident_view import incident_view
from . import sqlblocks as B

ORDER = ["sheet_ord", "row_id"]


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return incident_view(spark, sf)


def stage1(spark: SparkSession, sf: str) -> DataFrame:
    return clean_stage1(raw(spark, sf))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean(raw(spark, sf))


def identified(spark: SparkSession, sf: str) -> DataFrame:
    """Identity needs none of the data-dependent statistics, so it starts from ``stage1``."""
    return event_identity(stage1(spark, sf), ORDER)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return assign_rank(identified(spark, sf), target="vector")


# Oracle CTE chains -----------------------------------------------------------

def sql_raw() -> list[str]:
    return [B.INCIDENT_VIEW]


def sql_stage1() -> list[str]:
    return [B.INCIDENT_VIEW, B.stage1()]


def sql_cleaned() -> list[str]:
    return [B.INCIDENT_VIEW, B.stage1(), B.cleaned()]


def sql_identified() -> list[str]:
    return [*sql_stage1(), B.identity("stage1")]


def sql_labelled() -> list[str]:
    """CTE ``labelled``: identity + vector rank (columns named like the Spark side)."""
    return [*sql_identified(), B.parsed("ident"), B.ranked("parsed"),
            "labelled AS (SELECT * EXCLUDE (usable_for_training), rank_tz_vector AS rank_tz,\n"
            "  CASE WHEN rank_tz_vector IS NOT NULL THEN 'historical_vector' END AS rank_label_source,\n"
            "  usable_for_training FROM ranked)"]
