"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

1. Every whole text gets a row of statistics, all built-in Spark expressions; texts
   are read once and the statistics written.
2. A random forest is grown on the learnable rows, and each path from a root to a
   node becomes a rule: a conjunction of thresholds on statistics.
3. A lasso logistic regression over the rules' 0/1 values keeps few of them.
4. The kept rules and weights are compiled into one column expression, the score.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_learnable, read_table, small_batches, written

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
TREES, DEPTH, LASSO, SEED = 20, 3, 0.002, 7

#: Names of the statistics, in the order of the feature vector.
STATISTICS = ["log_chars", "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "bars", "full_stops",
              "distinct_words", "repeated_next", "distinct_lines", "line_words"]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; a null or empty text has 0 in all but the ratios of distinct parts, which are 1."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    chars = F.greatest(n, F.lit(1))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(t, "\n")
    count, some = F.size(words), F.greatest(F.size(words), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / chars

    def literal(mark: str) -> Column:
        return (n - F.length(F.replace(t, F.lit(mark), F.lit("")))) / chars

    again = F.aggregate(words, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
                        lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("int")).alias("n")), lambda a: a["n"])
    return {
        "log_chars": F.log1p(n), "log_words": F.log1p(count), "word_length": n / some,
        "upper": share(r"\p{Lu}"), "digits": share("[0-9]"), "symbols": share(r"[#$%&*+/<=>@\\^_`{}~]"),
        "exclamations": literal("!"), "bars": literal("|"), "full_stops": literal("."),
        "distinct_words": F.when(count == 0, 1.0).otherwise(F.size(F.array_distinct(words)) / some), "repeated_next": again / some,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines), "line_words": F.log1p(count / F.size(lines)),
    }


def paths(debug: str, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """Distinct conjunctions ``((statistic, '<=' or '>', threshold), ...)`` of all root-to-node paths of a printed forest."""
    found: dict[frozenset, tuple] = {}
    stack: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
        if " Tree" in line:
            stack = []
        rule = tuple(x for _, x in stack)
        found.setdefault(frozenset(rule), rule)
    return list(found.values())


def condition(rule: tuple[tuple[str, str, float], ...]) -> Column:
    out = F.lit(True)
    for name, sign, at in rule:
        out = out & (F.col(name) <= at if sign == "<=" else F.col(name) > at)
    return out


class RuleEnsemble:
    """Weighted rules over the statistics; ``score()`` is a column expression over statistics columns."""

    def __init__(self, rules: list[tuple[tuple, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Grow, extract and weigh rules on ``rows`` (statistics and a 0/1 label). With one class or no rows the score is constant."""
    seen = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return RuleEnsemble([], 0.0 if not seen else 4.0 if 1.0 in seen else -4.0)
    data = rows.select(F.col(label), array_to_vector(F.array(*[F.col(c).cast("double") for c in STATISTICS])).alias("features"), *STATISTICS)
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=2).fit(data)
    rules = paths(forest.toDebugString, STATISTICS)
    if not rules:
        share = seen.get(1.0, 0) / sum(seen.values())
        return RuleEnsemble([], 4.0 * (2 * share - 1))
    marked = written(data.select(F.col(label), array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("rules")), "rules")
    model = LogisticRegression(featuresCol="rules", labelCol=label, elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(marked)
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble(kept, float(model.intercept))


def labels_of(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """One 0/1 label per learnable doc_id: rows without id or label are left out, repeated ones are averaged and rounded."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & is_learnable(F.col("doc_id"), folds, held_out))
            .groupBy(F.col("doc_id").alias("label_id")).agg(F.round(F.avg(column)).alias("label")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, rules (their number).

    Null texts count as empty and are scored like any text; a null id is not held out
    and never learned from; repeated rows are scored each; other columns are not read.
    """
    rows = written(docs.select("doc_id", *[e.cast("double").alias(c) for c, e in statistics(F.col("text")).items()]), "statistics")
    known = written(rows.join(labels_of(labels, "quality", FOLDS, HELD_OUT), F.col("doc_id") == F.col("label_id"))
                    .select("label", *STATISTICS), "learnable")
    model = fit(known)
    held = F.coalesce(~is_learnable(F.col("doc_id"), FOLDS, HELD_OUT), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), model.score().alias("score"),
                       F.lit(len(model.rules)).alias("rules")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_rule_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    small_batches(spark)
    found = quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
