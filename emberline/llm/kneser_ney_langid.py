"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters and single spaces, as UTF-16 units, so an n-gram of
up to four units is one exact 64-bit key. 4-grams are counted over all learnable
texts (in the tasks, then summed by Spark); lower orders are continuation counts of
the next higher one. For every order the models of all languages share one sorted
array of hashed keys with a row of log probabilities, one per language, already
interpolated; contexts have rows of back-off weights. A text goes to the language
with the lowest cross-entropy per unit.

Calibration: models of nine tenths of the learnable texts judge the other tenth. A logistic
curve turns the margin between the two best languages into the score, and texts with
a score under ``REJECT`` or a cross-entropy far above their language's are marked rejected.
The models that judge the documents are then built again from all learnable texts.

Bound of what tasks receive: while counted 4-grams times languages stay within
``MODEL_CELLS``, the models are built on the driver and sent whole. Beyond it nothing
is left out: the same models are computed in Spark (``Blocks``) as one table of
sparse entries, and texts are scanned once for every ``BLOCK_ENTRIES`` of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import fresh, is_learnable, read_table, small_batches, written

FOLDS, HELD_OUT = 3, 1
ORDER = 4
MODEL_CELLS, BLOCK_ENTRIES = 1 << 24, 1 << 22
CALIBRATION = 10
REJECT, FAR = 0.5, 6.0
UNKNOWN = "und"
SPACE = 0x20
_UNITS: list[np.ndarray] = []


def _unit_table() -> np.ndarray:
    """Lower-case unit of every letter of the first plane; a space for all other units, surrogates as they are."""
    table = np.full(0x10000, SPACE, np.uint16)
    table[0xD800:0xE000] = np.arange(0xD800, 0xE000)
    for cp in (*range(0xD800), *range(0xE000, 0x10000)):
        if unicodedata.category(chr(cp))[0] == "L":
            low = chr(cp).lower()
            table[cp] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else cp
    return table


def units(text: str | None) -> np.ndarray:
    """Letters and single spaces of ``text``, after three spaces; empty if it has no letter."""
    if not _UNITS:
        _UNITS.append(_unit_table())
    if not text:
        return np.empty(0, np.uint16)
    if max(text) > "￿":
        text = "".join(c if c <= "￿" or unicodedata.category(c)[0] == "L" else " " for c in text)
    u = _UNITS[0][np.frombuffer(text.encode("utf-16-le", "replace"), np.uint16)]
    space = u == SPACE
    u = u[~(space & np.r_[True, space[:-1]])]
    if not len(u):
        return u
    return np.r_[np.full(ORDER - 1, SPACE, np.uint16), u, np.full(int(u[-1] != SPACE), SPACE, np.uint16)]


def grams(u: np.ndarray) -> np.ndarray:
    """Keys of the 4-grams that end at each unit after the leading spaces."""
    if len(u) < ORDER:
        return np.empty(0, np.uint64)
    w = u.astype(np.uint64)
    key = w[:len(w) - 3] << np.uint64(48)
    for j in range(1, ORDER):
        key |= w[j:len(w) - 3 + j] << np.uint64(48 - 16 * j)
    return key


def hashed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit keys, so that equal hashes mean equal keys."""
    x = keys ^ (keys >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, fold, key, n): n-gram counts of a task, folded whenever 4 million keys have gathered."""
    held: dict[tuple[str, bool], list[np.ndarray]] = {}
    size = 0

    def flush():
        for (lang, fold), parts in held.items():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array([fold] * len(key), pa.bool_()),
                                              pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "fold", "key", "n"])

    for batch in batches:
        for lang, text, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            keys = grams(units(text))
            if len(keys):
                held.setdefault((lang, fold), []).append(keys)
                size += len(keys)
            if size > 4_000_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


@dataclass
class Order:
    """Sorted hashes of one order's n-grams and contexts, with a row per language of log2 probabilities and back-off weights."""
    grams: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _rows(sorted_hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Row of each key, -1 where absent."""
    if not len(sorted_hashes):
        return np.full(len(keys), -1)
    h = hashed(keys)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)


class Models:
    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.orders: list[Order] = []       # of 1, 2, 3, 4 units
        self.floor = np.log2(1.0 / 0x10000)
        per_order: list[list[tuple[np.ndarray, np.ndarray]]] = [counts]
        for n in range(ORDER - 1, 0, -1):   # continuation counts: distinct units before a shorter n-gram
            mask = np.uint64((1 << 16 * n) - 1)
            per_order.append([np.unique(np.unique(k) & mask, return_counts=True) for k, _ in per_order[-1]])
        for n, tables in enumerate(reversed(per_order), start=1):
            self.orders.append(self._order(n, tables))
        self.slope, self.intercept = 1.0, 0.0
        self.usual = np.full((len(langs), 2), [0.0, np.inf])

    def _order(self, n: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> Order:
        every = np.unique(np.concatenate([k for k, _ in tables])) if tables else np.empty(0, np.uint64)
        contexts = np.unique(every >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
        logs, weights = np.empty((len(every), len(tables)), np.float32), np.zeros((len(contexts), len(tables)), np.float32)
        for lang, (key, count) in enumerate(tables):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            place = np.searchsorted(contexts, key >> np.uint64(16)) if n > 1 else np.zeros(len(key), np.int64)
            total, kinds = np.bincount(place, count, len(contexts)), np.bincount(place, minlength=len(contexts))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(every))
            own[np.searchsorted(every, key)] = np.maximum(count - discount, 0)
            where = np.searchsorted(contexts, every >> np.uint64(16)) if n > 1 else np.zeros(len(every), np.int64)
            lower = 2.0 ** self.log_probabilities(every & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)[:, lang] if n > 1 else 2.0 ** self.floor
            logs[:, lang] = np.log2(own / np.maximum(total[where], 1) + back[where] * lower)
            weights[:, lang] = np.log2(back)
        by, sort = (np.argsort(hashed(x), kind="stable") for x in (every, contexts))
        return Order(hashed(every)[by], logs[by], hashed(contexts)[sort], weights[sort])

    def log_probabilities(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """log2 of the probability of each n-gram's last unit after the others, per language."""
        order = self.orders[n - 1]
        at = _rows(order.grams, keys)
        out = order.logs[np.maximum(at, 0)] if len(order.logs) else np.empty((len(keys), len(self.langs)), np.float32)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            context = _rows(order.contexts, keys[lost] >> np.uint64(16)) if n > 1 else np.zeros(len(lost), np.int64)
            weight = np.where(context[:, None] >= 0, order.weights[np.maximum(context, 0)], 0) if len(order.weights) else 0
            shorter = self.log_probabilities(keys[lost] & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) if n > 1 else self.floor
            out[lost] = weight + shorter
        return out

    def entropies(self, text: str | None) -> np.ndarray | None:
        """Bits per unit of the whole text under each language; None if it has no letter."""
        u = units(text)
        if not len(u) or not self.langs:
            return None
        total, keys = np.zeros(len(self.langs)), grams(u)
        for at in range(0, len(keys), 1 << 18):
            total -= self.log_probabilities(np.sort(keys[at:at + (1 << 18)])).sum(axis=0, dtype=np.float64)
        return total / len(keys)

    def decide(self, text: str | None) -> tuple[int, float, float, float]:
        """Number of the language (-1: no letter), its bits per unit, the margin to the next, and the score."""
        return _decision(self.entropies(text), len(text or ""), self.slope, self.intercept)

    def decided(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """``rows`` with the decision on column ``text`` as column ``out``."""
        return rows.withColumn(out, _decide_column(rows.sparkSession, self, F.col(text)))


def _decision(bits: np.ndarray | None, length: int, slope: float, intercept: float) -> tuple[int, float, float, float]:
    if bits is None:
        return -1, 0.0, 0.0, 0.0
    best = int(bits.argmin())
    rest = np.delete(bits, best)
    margin = float(np.log1p(((rest.min() if len(rest) else bits[best] + 1.0) - bits[best]) * length ** 0.5))
    return best, float(bits[best]), margin, float(1 / (1 + np.exp(-(slope * margin + intercept))))


DECISION = StructType([StructField("lang", IntegerType()), StructField("bits", DoubleType()), StructField("margin", DoubleType()),
                       StructField("score", DoubleType())])


def _decide_column(spark, models: Models, text):
    sent = spark.sparkContext.broadcast(models)

    @F.pandas_udf(DECISION)
    def decide(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in texts:
            yield pd.DataFrame([m.decide(t) for t in batch], columns=DECISION.names)

    return decide(text)


class Blocks:
    """The models of ``Models``, computed in Spark from ``counts(lang, key, n)`` and kept there.

    log2 p(unit | context) is a sum over the orders: the context's back-off weight, where
    the language holds the context, and what the n-gram adds to it, where the language holds
    the n-gram. So every weight and every addition is an entry by itself, absent ones are 0,
    and a text's bits are sums over any split of the entries into blocks (here by hash).
    Kind 2n is an addition of order n, kind 2n - 1 a back-off weight of order n; the weight of
    order 1, whose context is empty, is part of ``base``.
    """

    def __init__(self, langs: list[str], counts: DataFrame):
        self.langs, self.slope, self.intercept = langs, 1.0, 0.0
        self.usual = np.full((len(langs), 2), [0.0, np.inf])
        self.base, floor = np.zeros(len(langs)), -16.0
        orders = {ORDER: counts.select("lang", "key", "n")}
        for n in range(ORDER - 1, 0, -1):
            shorter = orders[n + 1].select("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("key"))
            orders[n] = written(shorter.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")), "continuations")
        parts, lower = [], None
        for n in range(1, ORDER + 1):
            ones, twos = (F.sum((F.col("n") == k).cast("double")) for k in (1, 2))
            discount = orders[n].groupBy("lang").agg(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"))
            grams = orders[n].withColumn("context", F.shiftrightunsigned("key", 16) if n > 1 else F.lit(0).cast("long"))
            contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(F.broadcast(discount), "lang")
            contexts = written(contexts.select("lang", "context", "total", "discount", (F.col("discount") * F.col("kinds") / F.col("total")).alias("back")), "contexts")
            grams = grams.join(F.broadcast(contexts) if n == 1 else contexts, ["lang", "context"])
            if n > 1:
                before = lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("q"))
                grams = grams.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))).join(before, ["lang", "suffix"])
            else:
                grams = grams.withColumn("q", F.lit(2.0 ** floor))
            p = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("q")
            lower = written(grams.select("lang", "key", "q", "back", p.alias("p")), "probabilities")
            parts.append(lower.select(F.lit(2 * n).alias("kind"), "key", "lang", F.log2(F.col("p") / F.col("q") / F.col("back")).alias("value")))
            if n > 1:
                parts.append(contexts.select(F.lit(2 * n - 1).alias("kind"), F.col("context").alias("key"), "lang", F.log2("back").alias("value")))
            else:
                for r in contexts.collect():
                    self.base[langs.index(r["lang"])] = floor + np.log2(r["back"])
        entries = parts[0]
        for part in parts[1:]:
            entries = entries.unionByName(part)
        entries = entries.where(F.col("value") != 0).withColumn("hash", F.xxhash64("kind", "key"))
        self.entries = written(entries.repartitionByRange("hash").sortWithinPartitions("hash"), "entries")
        self.blocks = max(1, -(-self.entries.count() // BLOCK_ENTRIES))

    def _block(self, k: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the ``k``-th range of hashes, per kind: sorted keys, first entry of each, and languages and values of the entries."""
        low, high = (-(1 << 63) + (1 << 64) * i // self.blocks for i in (k, k + 1))
        t = self.entries.where(F.col("hash").between(low, high - 1)).select("kind", "key", "lang", "value").toArrow()
        kinds, keys, values = t.column("kind").to_numpy(), t.column("key").to_numpy().view(np.uint64), t.column("value").to_numpy().astype(np.float32)
        names = t.column("lang").combine_chunks().dictionary_encode()
        number = {x: i for i, x in enumerate(self.langs)}
        langs = np.array([number[x] for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()] if len(t) else np.empty(0, np.int32)
        out = {}
        for kind in np.unique(kinds):
            own = np.flatnonzero(kinds == kind)
            own = own[np.argsort(keys[own], kind="stable")]
            found, first = np.unique(keys[own], return_index=True)
            out[int(kind)] = found, np.r_[first, len(own)], langs[own], values[own]
        return out

    def decided(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """``rows`` with the decision on column ``text`` as column ``out``; every block is one scan of the texts.

        The sums of a block go by the SHA-256 of the text, as rows have no id of their own, and are added up per text.
        """
        spark, total, langs = rows.sparkSession, None, len(self.langs)
        code = F.sha2(F.col(text), 256)
        for k in range(self.blocks):
            sent = spark.sparkContext.broadcast(self._block(k))
            add = F.pandas_udf(_adder(sent, langs), ArrayType(DoubleType()))
            part = rows.where(F.col(text).isNotNull()).select(code.alias("code"), F.length(text).alias("length"), add(F.col(text)).alias("sums"))
            part = written(part.where(F.col("sums").isNotNull()).dropDuplicates(["code"]), "block_sums")
            sent.destroy()
            total = part if total is None else total.unionByName(part)
        each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(langs + 1)]
        sums = total.groupBy("code").agg(F.first("length").alias("length"), *each).select("code", "length", F.array(*[f"s{i}" for i in range(langs + 1)]).alias("sums"))
        base, blocks, slope, intercept = self.base, self.blocks, self.slope, self.intercept

        @F.pandas_udf(DECISION)
        def decide(lengths: pd.Series, sums: pd.Series) -> pd.DataFrame:
            # The last sum holds the number of units, once for every block.
            found = [_decision(-(base + np.asarray(s)[:-1] / (s[-1] / blocks)), n, slope, intercept) for n, s in zip(lengths, sums, strict=True)]
            return pd.DataFrame(found, columns=DECISION.names)

        key, other = fresh("code", rows.columns), fresh("code_", rows.columns)
        decided = written(sums.select(F.col("code").alias(other), decide("length", "sums").alias(out)), "decisions")
        none = F.struct(F.lit(-1).alias("lang"), *[F.lit(0.0).alias(x) for x in DECISION.names[1:]])
        return (rows.withColumn(key, code).join(decided, F.col(key) == F.col(other), "left")
                .select(*rows.columns, F.coalesce(out, none).alias(out)))


def _adder(sent, langs: int):
    """Function from texts to what the sent block adds to log2 of their probability, per language, and their number of units."""

    def sums(u: np.ndarray) -> np.ndarray:
        out, keys = np.zeros(langs + 1), grams(u)
        for at in range(0, len(keys), 1 << 18):
            part, n = np.unique(keys[at:at + (1 << 18)], return_counts=True)
            for kind, (found, first, lang, value) in sent.value.items():
                order = (kind + 1) // 2
                k = part & np.uint64((1 << 16 * order) - 1)
                k = k >> np.uint64(16) if kind % 2 else k
                place = np.minimum(np.searchsorted(found, k), len(found) - 1)
                hit = found[place] == k
                place, times = place[hit], n[hit]
                many = first[place + 1] - first[place]
                entry = np.repeat(first[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                out[:langs] += np.bincount(lang[entry], value[entry] * np.repeat(times, many).astype(np.float64), langs)
        out[langs] = len(keys)
        return out

    def add(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sums(u) if len(u := units(t)) else None for t in batch], dtype=object)

    return add


def _models(counts: DataFrame) -> Models | Blocks:
    """Models of ``counts(lang, key, n)``: on the driver if they are within ``MODEL_CELLS``, else in Spark."""
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if sum(sizes.values()) * len(langs) > MODEL_CELLS:
        return Blocks(langs, counts)
    tables = []
    for lang in langs:
        part = counts.where(F.col("lang") == lang).select("key", "n").toArrow()
        key, n = part.column("key").to_numpy().view(np.uint64), part.column("n").to_numpy()
        by = np.argsort(key)
        tables.append((key[by], n[by]))
    return Models(langs, tables)


def train(rows: DataFrame) -> Models | Blocks:
    """Models and calibration from ``rows(lang, text)``; rows without language or text teach nothing."""
    fold = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = written(known.select("lang", "text", fold.alias("fold")).mapInArrow(_count_grams, "lang string, fold boolean, key long, n long")
                      .groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("fold"), F.col("n"))).alias("seen")), "grams")
    partial = _models(counted.where(F.col("seen").isNotNull()).select("lang", "key", F.col("seen").alias("n")))
    if partial.langs:
        _calibrate(partial, known.where(fold))
    models = _models(counted.select("lang", "key", "n"))
    models.slope, models.intercept = partial.slope, partial.intercept
    for lang, usual in zip(partial.langs, partial.usual, strict=True):
        models.usual[models.langs.index(lang)] = usual
    return models


def _calibrate(models: Models | Blocks, rows: DataFrame) -> None:
    """Fit the score on margins of texts that the counts have not seen; note the usual bits per unit of each language.

    Texts of languages without a model are left out, as no model can judge them right.
    """
    names = F.array(*[F.lit(x) for x in models.langs])
    d = written(models.decided(rows.where(F.array_contains(names, F.col("lang"))).select("lang", "text"), "text", "d")
                .where("d.lang >= 0").select("d.*", (F.get(names, F.col("d.lang")) == F.col("lang")).alias("right")), "margins")
    bins = d.groupBy(F.round("margin", 1).alias("margin"), "right").agg(F.count(F.lit(1)).alias("n")).collect()
    # One right and one wrong text without margin keep the curve finite.
    x = np.array([0.0, 0.0, *(r["margin"] for r in bins)])
    y = np.array([0.0, 1.0, *(float(r["right"]) for r in bins)])
    n = np.array([1.0, 1.0, *(r["n"] for r in bins)])
    a, v = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-(a @ v)))
        v = v - np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (n * (p - y)) + 0.01 * v)
    models.slope, models.intercept = max(0.0, float(v[0])), float(v[1])
    for r in d.where("right").groupBy("lang").agg(F.avg("bits").alias("m"), F.stddev("bits").alias("s")).collect():
        models.usual[r["lang"]] = (r["m"], r["s"] if r["s"] else np.inf)


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits (per unit), rejected.

    ``und`` with score 0 for null texts, texts without a letter, and if nothing could
    be learned; such rows are rejected. Ties go to the first language by name. A null
    id is not held out and never learned from; repeated rows are judged each; other columns are not read.
    """
    small_batches(docs.sparkSession)
    learn = F.col("doc_id").isNotNull() & is_learnable(F.col("doc_id"), FOLDS, HELD_OUT)
    models = train(docs.where(learn).select("lang", "text"))
    held = F.coalesce(~is_learnable(F.col("doc_id"), FOLDS, HELD_OUT), F.lit(False))
    names = F.array(*[F.lit(x) for x in (models.langs or [UNKNOWN])])
    limits = F.array(*[F.lit(float(m + FAR * s)) for m, s in models.usual] or [F.lit(0.0)])
    d = models.decided(docs.select("doc_id", held.alias("held_out"), "text"), "text", "d")
    known = F.col("d.lang") >= 0
    return d.select("doc_id", "held_out", F.when(known, F.get(names, F.col("d.lang"))).otherwise(UNKNOWN).alias("lang_pred"),
                    F.when(known, F.col("d.score")).otherwise(0.0).alias("score"), F.col("d.bits").alias("bits"),
                    (~known | (F.col("d.score") < REJECT) | (F.col("d.bits") > F.get(limits, F.greatest(F.col("d.lang"), F.lit(0))))).alias("rejected"))


def op2_kneser_ney_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(read_table(spark, sf_dir, "documents"))
