"""Quality rules as a learned decision list.

1. Every whole text gets counts (words, symbols, equal lines, repeated windows of words
   and others), in one pass, written once. Statistics are whole numbers, most of them
   counts in 10,000 words or characters, so thresholds compare exactly.
2. Base rules come first: too few words, or too many of them in repeated windows.
3. Sequential covering learns the rest from labelled rows that pass the base rules. A
   rule that rejects is grown on two thirds of them, one threshold at a time by FOIL's
   information gain, until it covers no row to keep; the other third prunes it from the
   end; covered rows leave, and the next rule is grown on the rest. A pruned rule that
   is not precise enough ends the list; whatever no rule rejects is kept.
4. The list is compiled into one ordered conditional column expression.

Scale. A threshold is chosen from grouped counts of all learnable rows: per statistic and
cell (two significant digits) one row with its least and largest value, so that what
reaches the driver is bounded by statistics x cells, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_learnable, read_table, small_batches, written
from .rule_quality import labels_of

#: Base rules: fewest words, and largest percentage of words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Labels learned from: not of this fold of the id's crc32. Rows of the pruning third: this fold of three.
FOLDS, HELD_OUT, PRUNE_FOLDS, PRUNE_FOLD = 5, 0, 3, 0
#: Least precision on the pruning rows, and least number of them rejected rightly; sizes of a list and of a rule.
PRECISION, SUPPORT, RULES, CONDITIONS = 0.95, 2, 40, 6
#: Text is worked on in slices of at most so many bytes, or one text.
SLICE_BYTES = 4 << 20
UNIT = 10_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits",
          "n_stops", "n_distinct", "n_next"]


def statistics() -> dict[str, Column]:
    """Statistics that rules compare, whole numbers from the counts; those without a base are 0.

    Variety is log distinct words over log words, since the plain share of distinct words falls with a text's length.
    """
    def share(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.floor(F.col(part) * UNIT / F.col(of))).otherwise(0).cast("long")

    return {"words": F.col("n_words"), "lines": F.col("n_lines"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
            "equal_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words"), "upper": share("n_upper", "n_chars"),
            "digits": share("n_digits", "n_chars"), "stops": share("n_stops", "n_words"), "variety": F.when(F.col("n_words") > 1, F.floor(F.log(F.col("n_distinct")) / F.log(F.col("n_words")) * UNIT)).otherwise(0).cast("long"),
            "word_twice": share("n_next", "n_words"), "words_a_line": share("n_words", "n_lines")}


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values have equal numbers, from 0."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _codes(pa.array(left * (int(right.max(initial=0)) + 1) + right))


def repeated(codes: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words, given as numbers with the number of their text, lie in a window found twice or more in that text."""
    n = len(codes)
    hit = np.zeros(n + 1, np.int64)
    if n >= window:
        # A window's number is that of a pair of shorter windows which cover it, so equal numbers mean equal words.
        found, have = codes, 1
        while have < window:
            step = min(have, window - have)
            found, have = _pairs(found[:-step], found[step:]), have + step
        whole = np.flatnonzero(text[:n - window + 1] == text[window - 1:])
        if len(whole):
            same = _pairs(text[whole], found[whole])
            at = whole[np.bincount(same)[same] > 1]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + window, -1)
    return np.cumsum(hit[:n]) > 0


def _parts(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a slice, without nulls."""
    n = len(texts)

    def per_text(parents: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(parents, weights, minlength=n).astype(np.int64)

    def matches(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    def distinct(parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        width = int(codes.max(initial=0)) + 1
        return per_text(pc.unique(pa.array(parents * width + codes)).to_numpy(zero_copy_only=False) // width)

    words, parents = _parts(pc.ascii_split_whitespace(texts))
    some = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(some), parents[some.to_numpy(zero_copy_only=False)]
    codes = _codes(words)
    lines, owners = _parts(pc.split_pattern(texts, "\n"))
    some = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    lines, owners = lines.filter(some), owners[some.to_numpy(zero_copy_only=False)]
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (parents[1:] == parents[:-1]))
    n_lines = per_text(owners)
    return {"n_words": per_text(parents), "word_chars": per_text(parents, pc.utf8_length(words).to_numpy(zero_copy_only=False)),
            "n_symbols": matches("[#*$%&|<>]"), "n_dup_lines": n_lines - distinct(owners, _codes(lines)),
            "n_repeat_words": per_text(parents[repeated(codes, parents)]), "n_chars": pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64),
            "n_lines": n_lines, "n_upper": matches(r"\p{Lu}"), "n_digits": matches("[0-9]"), "n_stops": matches("[.!?]"),
            "n_distinct": distinct(parents, codes), "n_next": per_text(parents[again])}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            part = batch.slice(start, stop - start)
            found = counts(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[c]) for c in COUNTS]], ["doc_id", *COUNTS])
            start = stop


def counted(docs: DataFrame) -> DataFrame:
    """Counts of every whole text of ``docs(doc_id, text)``, one row per row. Null texts have none; other columns are not read."""
    small_batches(docs.sparkSession)
    lean = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return lean.mapInArrow(_count, f"doc_id {dict(lean.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: int

    def column(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold}"


def both(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


class DecisionList:
    """Ordered rules that reject, each a conjunction of thresholds; rows that none covers are kept."""

    def __init__(self, rules: list[tuple[Condition, ...]]):
        self.rules = rules

    def fired(self) -> Column:
        """Number of the first rule that covers a row, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            out = F.when(both(self.rules[k - 1]), k).otherwise(out)
        return out

    def kept(self) -> Column:
        return self.fired().isNull()

    def __str__(self) -> str:
        return "\n".join([*["reject if " + " and ".join(map(str, r)) for r in self.rules], "keep"])


def _cell(value: Column) -> Column:
    """The whole number at two significant digits at or above a value, which keeps the order of values."""
    step = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")) - 2, F.lit(0))).cast("long")
    return F.ceil(value / step).cast("long") * step


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def best_condition(cells: list[tuple[int, int, int, int, int]], names: list[str]) -> tuple[Condition | None, int, int]:
    """Threshold of most gain, with the rows to reject and to keep that pass it.

    ``cells`` are (statistic, least, largest value, rows to reject, rows to keep), in order
    of statistic and value. A threshold lies midway between neighbouring cells; equal gains
    go to the first statistic, then to > and then to the smaller threshold.
    """
    found, best = (None, 0, 0), 0.0
    for s, name in enumerate(names):
        own = [c for c in cells if c[0] == s]
        p0, n0 = sum(c[3] for c in own), sum(c[4] for c in own)
        options, p, n = [], 0, 0
        for here, after in zip(own, own[1:], strict=False):
            p, n = p + here[3], n + here[4]
            at = (here[2] + after[1]) // 2
            options += [(True, at, p0 - p, n0 - n), (False, at, p, n)]
        for above, at, p, n in sorted(options, key=lambda o: (not o[0], o[1])):
            gain = _gain(p, n, p0, n0) if p and p0 else -math.inf
            if gain > best + 1e-9:
                found, best = (Condition(name, above, at), p, n), gain
    return found


def _cells(rows: DataFrame, names: list[str]) -> list[tuple[int, int, int, int, int]]:
    pairs = F.posexplode(F.array(*[F.struct(_cell(F.col(c)).alias("cell"), F.col(c).alias("value")) for c in names])).alias("s", "c")
    grouped = (rows.select("reject", pairs).groupBy("s", "c.cell")
               .agg(F.min("c.value"), F.max("c.value"), F.sum(F.col("reject").cast("long")), F.sum((~F.col("reject")).cast("long"))))
    return sorted((r[0], *r[2:]) for r in grouped.collect())


def fit(rows: DataFrame, names: list[str], precision: float = PRECISION, support: int = SUPPORT, most_rules: int = RULES,
        most_conditions: int = CONDITIONS) -> DecisionList:
    """Sequential covering over ``rows(reject, grow, <names>)``, statistics as whole numbers from 0. With one class or no rows, all is kept."""
    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(rules) < most_rules:
        grow, prune = rows.where(left & F.col("grow")), rows.where(left & ~F.col("grow"))
        rule: tuple[Condition, ...] = ()
        while len(rule) < most_conditions:
            condition, p, n = best_condition(_cells(grow.where(both(rule)), names), names)
            if condition is None:
                break
            rule += (condition,)
            if not n:
                break
        if not rule:
            break
        lengths = range(1, len(rule) + 1)
        found = prune.agg(*[F.count(F.when(both(rule[:k]) & (F.col("reject") == r), 1)) for k in lengths for r in (True, False)]).first()
        covered = [(found[2 * k], found[2 * k + 1]) for k in range(len(rule))]
        # Laplace's estimate of precision; equal ones go to the shorter rule.
        k = max(range(len(rule)), key=lambda k: ((covered[k][0] + 1) / (sum(covered[k]) + 2), -k))
        p, n = covered[k]
        if p < support or p < precision * (p + n):
            break
        rules.append(rule[:k + 1])
        left = left & ~both(rule[:k + 1])
    return DecisionList(rules)


def judged(docs: DataFrame, labels: DataFrame, **settings) -> tuple[DataFrame, DecisionList]:
    """One row per row of ``docs`` with doc_id, counts, statistics, base_failed, rule (that rejects it, else null) and kept; and the list.

    Null and empty texts have no words and fail the base rules. A null id is never learned
    from; repeated rows are judged each; labels that are null or without id are left out;
    without labels, or with labels of one kind, the base rules alone decide. Labels and ids
    are no statistics. Other columns are not read.
    """
    found = written(counted(docs).withColumn("base_failed", base_failed()), "counts").withColumns(statistics())
    names = list(statistics())
    known = labels_of(labels, "quality", FOLDS, HELD_OUT)
    learn = found.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("label_id"))
    learn = written(learn.select((F.col("label") < 0.5).alias("reject"), is_learnable(F.col("doc_id"), PRUNE_FOLDS, PRUNE_FOLD).alias("grow"), *names), "learnable")
    rules = fit(learn, names, **settings)
    out = found.withColumn("rule", F.when(~F.col("base_failed"), rules.fired()))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def op13_decision_lists(spark, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of the learned list for every document."""
    out, _ = judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
