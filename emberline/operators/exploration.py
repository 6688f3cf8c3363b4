"""Slices, searches, comparisons and automatic features."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import written
from .quantiles import percentiles
from .splits import hash_uniform

# FIXED VALUES (must equal the source application's)
TIME_ORDER_COLUMNS = ["t_detect_min", "t_report_min", "t_arrival_min", "t_first_hose_min", "t_contained_min", "t_extinguished_min"]
COMPARED_COLUMNS = ["building_floors", "fire_floor", "distance_to_station", "t_report_min", "t_arrival_min"]
RUN_METRICS = ["rows_used", "silhouette", "davies_bouldin", "calinski_harabasz", "final_score", "spearman", "purity", "nmi",
               "cluster_min", "cluster_max", "cluster_smallest_share"]
CATEGORICAL_LIMIT = 50
LOW_CONFIDENCE, HIGH_ENTROPY = 0.5, 1.2
MODEL_WARNINGS = ["Модель использует другой тип целевой разметки", "Модель относится к архивному режиму и не подходит для ЛПР",
                  "Используется устаревшая схема признаков", "При проверке качества пересекались одни и те же события",
                  "Использована устаревшая схема разделения выборки", "Низкая уверенность прогноза",
                  "Высокая неопределенность прогноза", "Вероятности не калиброваны"]
# end of fixed values


def interactive_slice(df: DataFrame, column: str, years: tuple[int, int] | None = None, region: float | None = None, top: int = 10) -> DataFrame:
    """Rows, missing % of ``column`` and the ``top`` flag rates of a year range and region, as (item, name, value)."""
    if years:
        df = df.where(F.col("year").between(*years))
    if region is not None:
        df = df.where(F.col("region_code") == region)
    flags = [c for c in df.columns if c.startswith("flag_")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col(column).isNull().cast("double")) * 100, 1).alias("missing"),
                 *[F.avg(F.col(c).cast("double")).alias(c) for c in flags])
    head = F.array(F.struct(F.lit("rows").alias("item"), F.lit("").alias("name"), F.col("rows").cast("double").alias("value")),
                   F.struct(F.lit("missing_pct").alias("item"), F.lit(column).alias("name"), F.col("missing").alias("value")))
    rates = F.array(*[F.struct((-F.col(c)).alias("order"), F.lit(c).alias("name"), F.round(F.col(c), 6).alias("value")) for c in flags])
    ranked = F.transform(F.slice(F.array_sort(rates), 1, top), lambda r: F.struct(F.lit("flag_rate").alias("item"), r["name"].alias("name"), r["value"].alias("value")))
    return row.select(F.explode(F.concat(head, ranked)).alias("s")).select("s.*")


def search_decisions(decisions: DataFrame, id_part: str = "", time_part: str = "", rank: float | None = None,
                     comment_part: str = "", fire_part: str = "") -> DataFrame:
    """Decisions whose id, shown time, comment and incident id contain the parts, and whose rank equals ``rank``."""
    tests = []
    if id_part:
        tests.append(F.col("decision_id").cast("string").contains(id_part))
    if time_part:
        tests.append(F.lower(F.date_format("decided_at", "dd.MM.yyyy HH:mm")).contains(time_part.lower()))
    if rank is not None:
        tests.append(F.coalesce(F.col("decision_rank") == rank, F.lit(False)))
    if comment_part:
        tests.append(F.lower(F.coalesce("comment", F.lit(""))).contains(comment_part.strip().lower()))
    if fire_part:
        tests.append(F.coalesce(F.col("fire_id").cast("string"), F.lit("")).contains(fire_part))
    return decisions.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """T5: ``n`` rows in the order of a seeded hash of their key; the same rows in every run."""
    u = hash_uniform(F.concat_ws("|", *[F.col(c).cast("string") for c in key]), seed)
    return df.withColumn("u_", u).orderBy("u_", *key).limit(n).drop("u_")


def _floor_mod(x: Column, y: Column) -> Column:
    """x - y * floor(x / y); null for y = 0."""
    d = F.nullif(y, F.lit(0.0))
    return ((x % d) + d) % d


def feature_recipes(columns: list[str], most: int = 50) -> dict[str, tuple[str, ...]]:
    """name -> (operation, names it is made of) for compositions of absolute, negate, multiply, divide and modulo.

    Order: the columns, all features of depth one by operation, then those of depth
    two (absolute, negate; products, ratios and remainders with a column), until
    ``most`` features are named.
    """
    out: dict[str, tuple[str, ...]] = {c: ("column", c) for c in columns}

    def grow(names: list[str], both: list[tuple[str, str]], ordered: list[tuple[str, str]]) -> None:
        for op in ("absolute", "negate"):
            out.update({f"{op}({n})": (op, n) for n in names})
        out.update({f"multiply({a},{b})": ("multiply", a, b) for a, b in both})
        for op in ("divide", "modulo"):
            out.update({f"{op}({a},{b})": (op, a, b) for a, b in ordered})

    grow(columns, list(combinations(columns, 2)), list(permutations(columns, 2)))
    first = [n for n in out if n not in columns]
    pairs = [(a, b) for a in first for b in columns]
    grow(first, pairs, pairs)
    return dict(list(out.items())[:most])


def generated_features(columns: list[str], most: int = 50) -> dict[str, Column]:
    """the features of :func:`feature_recipes` as expressions. A division by zero is null."""
    made: dict[str, Column] = {}
    for name, (op, *args) in feature_recipes(columns, 1 << 30).items():
        x = [made.get(a) for a in args]
        if op == "column":
            made[name] = F.col(args[0]).cast("double")
        elif op == "absolute":
            made[name] = F.abs(x[0])
        elif op == "negate":
            made[name] = -x[0]
        elif op == "multiply":
            made[name] = x[0] * x[1]
        elif op == "divide":
            made[name] = x[0] / F.nullif(x[1], F.lit(0.0))
        else:
            made[name] = _floor_mod(x[0], x[1])
        if len(made) == most:
            break
    return made


def top_variances(df: DataFrame, features: dict[str, Column], top: int = 20) -> DataFrame:
    """the ``top`` features by sample variance (infinite values as missing, all-missing ones left out)."""
    names = list(features)
    finite = df.select(*[F.when(F.abs(e) != float("inf"), e).alias(f"f{i}") for i, e in enumerate(features.values())])
    row = finite.agg(*[F.var_samp(f"f{i}").alias(f"f{i}") for i in range(len(names))])
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f{i}").alias("variance")) for i, n in enumerate(names)])
    return (row.select(F.explode(cells).alias("s")).select("s.*").where(F.col("variance").isNotNull() & ~F.isnan("variance"))
            .orderBy(F.desc("variance"), "feature").limit(top))


def monotone_times(df: DataFrame) -> DataFrame:
    """Stage times of a row raised to the running maximum of the known ones before (negatives to 0, rounded)."""
    last: Column = F.lit(None).cast("double")
    new: dict[str, Column] = {}
    for c in (c for c in TIME_ORDER_COLUMNS if c in df.columns):
        now = F.greatest(F.col(c).cast("double"), F.lit(0.0))
        new[c] = F.when(F.col(c).isNotNull(), F.round(F.greatest(now, last)))
        last = F.greatest(new[c], last)
    return df.withColumns(new)


def compare_distributions(df: DataFrame, origin: Column, target: str, columns: list[str] | None = None) -> DataFrame:
    """(item, name, first, second): shares of the target's values, mean missingness, means and medians of numeric
    columns and the mean absolute difference of their correlations, of the rows where ``origin`` is false and true."""
    cols = columns or [c for c in COMPARED_COLUMNS if c in df.columns]
    rows = written(df.select(origin.cast("int").alias("o_"), target, *cols), "compared")

    def pair(item: str, name: Column, value: Column, grouped: DataFrame) -> DataFrame:
        return (grouped.groupBy(F.lit(item).alias("item"), name.alias("name"))
                .agg(F.max(F.when(F.col("o_") == 0, value)).alias("first"), F.max(F.when(F.col("o_") == 1, value)).alias("second")))

    known = rows.where(F.col(target).isNotNull())
    total = known.groupBy("o_").agg(F.count(F.lit(1)).alias("all_")).withColumnRenamed("o_", "o2_")
    shares = known.groupBy("o_", target).agg(F.count(F.lit(1)).alias("n")).join(total, F.col("o_") == F.col("o2_"))
    out = pair("share", F.col(target).cast("string"), F.round(F.col("n") / F.col("all_"), 4), shares)
    gone = sum((F.col(c).isNull().cast("double") for c in (target, *cols)), F.lit(0.0)) / (len(cols) + 1)
    corr = [(a, b) for a, b in combinations(cols, 2)]
    stats = rows.groupBy("o_").agg(F.avg(gone).alias("missing"), *[F.avg(c).alias(f"mean_{c}") for c in cols],
                                   *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(corr)],
                                   *[(F.min(c) != F.max(c)).alias(f"varies_{c}") for c in cols])
    # One row an origin, read once for each column.
    stats = written(stats, "stats")
    out = out.unionByName(pair("missingness", F.lit(""), F.round("missing", 6), stats))
    for c in cols:
        out = out.unionByName(pair("mean", F.lit(c), F.round(f"mean_{c}", 6), stats))
    medians = percentiles(rows, cols, {0.5: "median"}, ["o_"])
    out = out.unionByName(pair("median", F.col("column"), F.round("median", 6), medians))
    one, two = (stats.where(F.col("o_") == o) for o in (0, 1))
    two = two.select(*[F.col(c).alias(f"{c}_2") for c in two.columns])
    both = one.crossJoin(two)  # one row each
    # The matrix over the columns that vary among the first rows; its diagonal differs nowhere.
    used = sum((F.col(f"varies_{c}").cast("int") for c in cols), F.lit(0))
    apart = sum((F.when(F.col(f"varies_{a}") & F.col(f"varies_{b}"),
                        F.abs(F.coalesce(F.col(f"r{i}"), F.lit(0.0)) - F.coalesce(F.col(f"r{i}_2"), F.lit(0.0)))).otherwise(0.0)
                 for i, (a, b) in enumerate(corr)), F.lit(0.0))
    diff = F.when(used >= 2, F.round(2 * apart / (used * used), 6))
    return out.unionByName(both.select(F.lit("correlation_difference").alias("item"), F.lit("").alias("name"), diff.alias("first"),
                                       F.lit(None).cast("double").alias("second")))


def source_counts(historical: DataFrame, promoted: DataFrame, decisions: DataFrame) -> DataFrame:
    """How many rows each training source holds, how many are ready, and saved decisions not yet promoted, as (name, n)."""
    ready = F.col("rank_tz").isNotNull() & F.coalesce("usable_for_training", F.lit(False)) & F.coalesce("is_canonical_event_record", F.lit(True))
    h = historical.agg(F.count(F.lit(1)).alias("historical_total"), F.count_if(ready).alias("historical_ready"))
    p = promoted.agg(F.count(F.lit(1)).alias("lpr_total"), F.count_if(F.col("rank_tz").isNotNull()).alias("lpr_ready"))
    new = (decisions.where(F.coalesce("save_to_db", F.lit(True)))
           .join(promoted.select(F.col("decision_id").alias("known_")), F.col("decision_id") == F.col("known_"), "left_anti"))
    one = h.crossJoin(p).crossJoin(new.agg(F.count(F.lit(1)).alias("new_lpr_candidates")))  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in one.columns])).alias("s")).select("s.*")


def infer_categorical(df: DataFrame, derived: set[str] = frozenset()) -> DataFrame:
    """(column, categorical): text and boolean columns, codes, flags and invalid marks, whole-number types of few values."""
    def few(c: str) -> Column:
        return F.count_distinct(F.col(c)) <= CATEGORICAL_LIMIT

    tests = {}
    for c, kind in df.dtypes:
        if kind in ("string", "boolean"):
            tests[c] = F.lit(True)
        elif c in derived:
            tests[c] = F.lit(False)
        elif c.endswith(("_code", "_invalid")) or c.startswith("flag_"):
            tests[c] = F.lit(True)
        else:
            tests[c] = few(c) if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(False)
    row = df.agg(F.count(F.lit(1)).alias("n_"), *[t.alias(c) for c, t in tests.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("categorical")) for c in tests])).alias("s")).select("s.*")


def compare_runs(runs: DataFrame, a: int, b: int, metrics: list[str] | None = None) -> DataFrame:
    """(metric, a, b, delta) of two runs; a run that is not there gives nulls."""
    names = metrics or [m for m in RUN_METRICS if m in runs.columns]
    long = runs.where(F.col("run_id").isin(a, b)).select("run_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("s")).select("run_id", "s.*")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("run_id") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("run_id") == b, F.col("value"))).alias("b"))
    return wide.select("metric", "a", "b", (F.col("a") - F.col("b")).alias("delta"))


def leaderboard(runs: DataFrame, metric: str, name: str, baseline: str, top: int = 3) -> DataFrame:
    """T4: the ``top`` runs by ``metric`` (ties by name) with the improvement over the baseline run in %."""
    base = runs.where(F.col(name) == baseline).agg(F.max(metric).alias("base_"))
    return (runs.crossJoin(base)  # the baseline is one row
            .select(name, metric, F.round((F.col(metric) - F.col("base_")) / F.col("base_") * 100, 4).alias("improvement_pct"))
            .orderBy(F.desc(metric), name).limit(top))


def decision_payload(predictions: DataFrame, keys: list[str], passport: Column, k: int = 3) -> DataFrame:
    """Per scored row the top-k ranks with probabilities, confidence, entropy and the warnings that hold.

    ``passport`` is a struct column of the model: semantic_target, availability_stage,
    feature_set, legacy_alias, event_overlap_rate, split_protocol, calibration_status.
    """
    from ..functions import resources as R
    from .features import class_to_rank

    idx = F.sequence(F.lit(1), F.size("probability"))
    entries = F.array_sort(F.zip_with("probability", idx, lambda p, j: F.struct((-p).alias("neg"), j.alias("cls"), p.alias("p"))))
    top = F.transform(F.slice(entries, 1, k), lambda e: F.struct(class_to_rank(e["cls"]).alias("rank"), R.rank_label(class_to_rank(e["cls"])).alias("rank_name"),
                                                                F.round(e["p"], 6).alias("probability")))
    entropy = -F.aggregate("probability", F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    rows = predictions.select(*keys, top.alias("top_k_ranks"), F.array_max("probability").alias("confidence"), entropy.alias("entropy"), passport.alias("m"))
    tests = [~F.coalesce(F.col("m.semantic_target") == "rank_tz_vector", F.lit(False)),
             F.coalesce(F.col("m.availability_stage") == S.STAGE_RETROSPECTIVE, F.lit(False)),
             F.coalesce(F.col("m.feature_set") == "online_tactical", F.lit(False)) | (F.coalesce(F.col("m.legacy_alias"), F.lit("")) != ""),
             F.coalesce(F.col("m.event_overlap_rate"), F.lit(0.0)) != 0.0,
             F.coalesce(F.col("m.split_protocol") == "row_random_legacy", F.lit(False)),
             F.col("confidence") < LOW_CONFIDENCE, F.col("entropy") > HIGH_ENTROPY,
             F.coalesce(F.col("m.calibration_status"), F.lit("not_calibrated")) == "not_calibrated"]
    warnings = F.filter(F.array(*[F.when(t, F.lit(w)) for t, w in zip(tests, MODEL_WARNINGS, strict=True)]), lambda w: w.isNotNull())
    return rows.select(*keys, "top_k_ranks", "confidence", "entropy", warnings.alias("warnings"))
