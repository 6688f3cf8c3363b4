"""Registered queries: what is done with model outputs, checked on deterministic tables derived from the data.

The stand-in for a forest is one "tree" per temperature: softmax values of the
count-proxy scores at five temperatures, and five multiples of the declared count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import learning as L
from ..session import written
from . import catalog_eval as CE
from . import catalog_explore as CX
from . import incidents as V
from . import sqlblocks as B
from .registry import register

K, KS = ["sheet_ord", "row_id"], "sheet_ord, row_id"
_POWERS = [0.25, 0.5, 1.0, 1.5, 2.0]
_FACTORS = [0.5, 0.9, 1.0, 1.2, 2.5]


def _w(chain, select: str) -> str:
    return B.with_(*chain) + select


def _tree_probs(p):
    def tree(power: float):
        return L.scaled(F.transform("probability", lambda x: F.pow(x, F.lit(power))))

    trees = [tree(t) for t in _POWERS]
    return p.select(*K, F.array(*trees).alias("tree_probs"))


def _m16_sql():
    scaled = ", ".join(f"list_transform(list_transform(probability, lambda x: power(x, {t})), lambda v: v / list_sum(list_transform(probability, lambda x: power(x, {t}))))" for t in _POWERS)
    each = lambda e: f"list_transform(range(1, 7), lambda j: {e.format(v='list_transform(tp, lambda a: a[j])')})"
    q = lambda f: ("list_sort({v})[CAST(floor(4 * " + f + ") AS INTEGER) + 1] + (list_sort({v})[CAST(ceil(4 * " + f + ") AS INTEGER) + 1] - "  # noqa: E731
                   "list_sort({v})[CAST(floor(4 * " + f + ") AS INTEGER) + 1]) * (4 * " + f + " - floor(4 * " + f + "))")
    return _w(CE._pred_sql_ctes() + [
        f"tr AS (SELECT {KS}, [{scaled}] AS tp FROM pred)",
        f"st AS (SELECT {KS}, {each('list_avg({v})')} AS mp, {each('list_stddev_pop({v})')} AS sd, {each(q('0.05'))} AS lo, {each(q('0.95'))} AS hi FROM tr)"],
        f"SELECT {KS}, CAST(list_position(mp, list_max(mp)) AS INTEGER) AS predicted_class, {CE._RANK_CASE.format(c='list_position(mp, list_max(mp))')} AS predicted_rank, "
        "round(list_max(mp), 6) AS mean_prob_class, round(list_max(sd), 6) AS std_prob_class, round(list_max(lo), 6) AS ci_lower_prob, round(list_max(hi), 6) AS ci_upper_prob, "
        "round(-list_sum(list_transform(mp, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END)), 6) AS entropy FROM st")


_M16 = ["mean_prob_class", "std_prob_class", "ci_lower_prob", "ci_upper_prob", "entropy"]


@register("m16_tree_reduction", sql=_m16_sql, ids=("M16",))
def m16_tree_reduction(spark, sf):
    """Class, mean, spread, quantiles and entropy over five stand-in trees of every prediction."""
    return _reduced(written(CE._pred(spark, sf), "pred"))


def _reduced(pred):
    r = L.reduce_tree_probabilities(_tree_probs(pred), K)
    return r.select(*K, "predicted_class", "predicted_rank", *[F.round(c, 6).alias(c) for c in _M16])


@register("m18_confidence_join", ids=("M18", "J8"), sql=lambda: _w([f"m16 AS ({_m16_sql()})", f"t3 AS ({CE.all_t3_sql()})"],
          "SELECT sheet_ord, row_id, t3.cls AS top1_class, t3.probability AS top1_prob, m16.mean_prob_class, m16.entropy FROM t3 JOIN m16 USING (sheet_ord, row_id) WHERE position = 1"))
def m18_confidence_join(spark, sf):
    """Top-1 predictions joined by row key with the uncertainty over trees."""
    pred = written(CE._pred(spark, sf), "pred")
    top = E.top_k(pred, K, 3).where("position = 1").select(*K, F.col("cls").alias("top1_class"), F.col("probability").alias("top1_prob"))
    return top.join(_reduced(pred).select(*K, "mean_prob_class", "entropy"), K)


@register("m17_value_reduction", ids=("M17",), sql=lambda: _w(V.sql_stage1() + [
          f"tv AS (SELECT {KS}, unnest([{', '.join(map(str, _FACTORS))}]) * equipment_count AS v FROM stage1 WHERE equipment_count IS NOT NULL)"],
          f"SELECT {KS}, round(quantile_cont(v, 0.2), 6) AS p20, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.8), 6) AS p80, round(min(v), 6) AS min, "
          f"round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std FROM tv GROUP BY ALL"))
def m17_value_reduction(spark, sf):
    """Quantiles, extremes and spread over five stand-in trees of every declared count."""
    rows = V.stage1(spark, sf).where(F.col("equipment_count").isNotNull())
    r = L.reduce_tree_values(rows.select(*K, F.array(*[F.col("equipment_count") * f for f in _FACTORS]).alias("tree_values")), K)
    return r.select(*K, *[F.round(c, 6).alias(c) for c in ("p20", "p50", "p80", "min", "max", "std")])


@register("m5_regression_metrics", ids=("M5",), sql=lambda: _w(V.sql_labelled() + [
          "er AS (SELECT resource_count_parsed - equipment_count AS e, equipment_count AS y FROM labelled WHERE equipment_count IS NOT NULL)"],
          "SELECT round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2, count(*) AS n FROM er"))
def m5_regression_metrics(spark, sf):
    """MAE, MSE, RMSE and R2 of the parsed count as a prediction of the declared one."""
    rows = V.labelled(spark, sf).where(F.col("equipment_count").isNotNull()).select(F.col("resource_count_parsed").cast("double").alias("p"), "equipment_count")
    m = L.regression_metrics(rows, "equipment_count", "p")
    return m.select(*[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse", "r2")], "n")


@register("m25_standardise", ids=("M25",), sql=lambda: _w(V.sql_stage1(), f"SELECT {KS}, " + ", ".join(
          f"round((coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER ()) / stddev_pop(coalesce({c}, 0.0)) OVER (), 6) AS {c}" for c in CX._SEG) + " FROM stage1"))
def m25_standardise(spark, sf):
    """Columns brought to mean 0 and population deviation 1, missing values as 0."""
    rows = V.stage1(spark, sf).select(*K, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CX._SEG])
    return L.standardize(rows, CX._SEG, keep=K).select(*K, *[F.round(c, 6).alias(c) for c in CX._SEG])


@register("a19_cluster_profile", ids=("A19",), sql=lambda: _w(V.sql_cleaned() + [
          f"pf AS (SELECT {CX.sql_cut('CAST(building_floors AS DOUBLE)', CX.FE.RESEARCH.floor_edges)} AS cluster, * FROM cleaned WHERE building_floors IS NOT NULL)"],
          "SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS size, round(avg(building_floors), 6) AS mean_building_floors, round(avg(distance_to_station), 6) AS "
          "mean_distance_to_station, round(avg(rank_ref), 6) AS mean_rank FROM pf GROUP BY 1"))
def a19_cluster_profile(spark, sf):
    """Size, feature means and mean severity rank of fixed clusters."""
    rows = V.cleaned(spark, sf).where(F.col("building_floors").isNotNull())
    seg = rows.withColumn("cluster", CX.FE.cut(F.col("building_floors").cast("double"), CX.FE.RESEARCH.floor_edges).cast("int"))
    p = E.cluster_profile(seg, "cluster", CX._SEG, "rank_ref")
    return p.select("cluster", "size", *[F.round(c, 6).alias(c) for c in ("mean_building_floors", "mean_distance_to_station", "mean_rank")])
