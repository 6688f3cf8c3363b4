"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all letter triples that occur in both as
subsequences, decay to the power of both stretches. Triples may skip letters, so a
word with gaps or inserted characters stays near the plain one. Punctuation inside a
word is passed over, digits only widen its gaps, and letters spelled one by one are
read as one word. The fit adds copies of chosen words with one character inserted.

Fit. Words of clean texts are negative; of a toxic text only the best two words are
positive, so words are chosen and the machine refitted in turn (multiple-instance
learning). Spark counts the texts of each class that hold a word, and makes each
choice, over all learnable labelled rows (``Evidence``). What is fitted on the driver
are the words chosen in the texts of a bounded sample, the words of its clean texts,
and every other word chosen in three texts or more whose counts are not chance.
Words are mapped by the kernel with ``landmarks`` and the inverse root of the
landmarks' kernel matrix (Nyström); a linear machine with squared hinge loss is
solved by Newton steps. A text is as toxic as its most toxic sentence; a logistic
calibration over whole texts turns that value into the score.

Scoring. For a fixed machine the weighted landmarks add up to one table of triples,
64^3 numbers. That proven size is all a task receives; whole texts are scored in one pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import fresh, is_learnable, read_table, small_batches, written
from .rule_quality import labels_of

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Bounds of the labelled sample: texts of each class, and the UTF-8 bytes of one.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 3000, 16_384
DECAY, SPAN, LANDMARKS, ROUNDS = 0.65, 6, 256, 4
#: Weight of a chosen word's copies with an insertion, against the word itself.
INSERTED = 0.2
#: A toxic text whose best word scores below this counts as mislabelled.
DOUBTFUL = -0.3
#: A positive word below this kernel value with every landmark becomes one itself.
UNLIKE = 0.5

# Classes of characters: 0 white space, 1-26 a-z, 27-61 other letters, 62 digits, 63 the start of a word, 64 passed over.
MARK, START, NOTHING = 62, 63, 64
CLASSES = 64
PAIRS = [(d1, d2) for d2 in range(2, SPAN) for d1 in range(1, d2)]


def _class_table() -> np.ndarray:
    table = np.full(0x10000, NOTHING, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if ch.isdigit():
            table[cp] = MARK
        elif ch.isspace():
            table[cp] = 0
        elif ch.isalpha():
            low = ch.lower()[0]
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 35
    return table


_TABLE: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    """Character classes of ``text`` after one leading space, without what is passed over (as are planes beyond the first)."""
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer((" " + text).encode("utf-32-le", "replace"), np.uint32)
    found = _TABLE[0][np.where(points < 0x10000, points, 0xFFFD)]
    return found[found != NOTHING]


def word_stream(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all words, each after its START; the place of each START; the letters of each word.

    Words end at white space. A space between two words of one letter is left out.
    """
    c = classes(text)
    space = c == 0
    begin = np.flatnonzero(space[:-1] & ~space[1:])           # the space before each word
    if not len(begin):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    keep = ~space
    keep[begin] = True
    ends = np.flatnonzero(~space & np.r_[space[1:], True])
    single = ends - begin == 1
    spelled = single[1:] & single[:-1] & (begin[1:] == ends[:-1] + 1)
    keep[begin[1:][spelled]] = False
    c = np.where(space, START, c)[keep].astype(np.uint8)
    starts = np.flatnonzero(c == START)
    letters = np.add.reduceat((c != START) & (c != MARK), starts).astype(np.int64)
    return c, starts, letters


_NORM = [1.0]


def norms(letters: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of the triples of a word, by its number of letters (and START)."""
    most = int(letters.max()) if len(letters) else 0
    while len(_NORM) <= most:
        n = len(_NORM) + 1
        _NORM.append(max(sum((n - d2) * DECAY ** (2 * (d2 + 1)) for _, d2 in PAIRS if d2 < n), 1e-3) ** 0.5)
    return np.array(_NORM)[letters]


def word_scores(table: np.ndarray, c: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Kernel sum of every word of the stream with ``table``, over the word's norm."""
    if not len(starts):
        return np.empty(0)
    stops = np.r_[starts[1:], len(c)]
    rest = np.repeat(stops, stops - starts) - np.arange(len(c))
    codes = np.r_[c, np.zeros(SPAN, np.uint8)].astype(np.int32)
    n, total = len(c), np.zeros(len(c), np.float32)
    for d1, d2 in PAIRS:
        at = codes[:n] << 12 | codes[d1:n + d1] << 6 | codes[d2:n + d2]
        total += np.where(rest > d2, table[at], 0) * np.float32(DECAY ** (d2 + 1))
    return np.add.reduceat(total, starts) / norms(letters)


class Machine:
    """Triple table, bias and calibration (slope, intercept) of a fitted machine."""

    def __init__(self, table: np.ndarray, bias: float, calibration: tuple[float, float]):
        self.table, self.bias, self.calibration = table.astype(np.float32), bias, calibration

    def best(self, text: str | None) -> float:
        """The highest word score of the whole text, held to [-2, 2]; -2 without words. Read in blocks of words."""
        highest = -2.0
        for block in blocks(text or ""):
            scores = word_scores(self.table, *word_stream(block))
            if len(scores):
                highest = max(highest, float(scores.max()) + self.bias)
        return min(2.0, highest)

    def score(self, text: str | None) -> float:
        slope, intercept = self.calibration
        return float(1 / (1 + np.exp(-(slope * self.best(text) + intercept))))


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The whole text in blocks of about ``size`` characters, cut at white space."""
    at = 0
    while at < len(text):
        stop = at + size
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        yield text[at:stop]
        at = stop


def _words(text: str) -> list[bytes]:
    """Words as bytes of classes, START first, without marks."""
    c, starts, _ = word_stream(text)
    head = bytes([START])
    return [head + p for p in c[c != MARK].tobytes().split(head)[1:]] if len(starts) else []


def _triples(word: bytes) -> dict[int, float]:
    out: dict[int, float] = {}
    for i in range(len(word)):
        for d1, d2 in PAIRS:
            if i + d2 < len(word):
                key = word[i] << 12 | word[i + d1] << 6 | word[i + d2]
                out[key] = out.get(key, 0.0) + DECAY ** (d2 + 1)
    return out


def _landmark_tables(landmarks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The landmarks' normalised triples as (landmark, triple, weight) entries."""
    at, key, weight = [], [], []
    for j, (word, norm) in enumerate(zip(landmarks, norms(np.array([len(w) - 1 for w in landmarks])), strict=True)):
        for k, v in _triples(word).items():
            at.append(j)
            key.append(k)
            weight.append(v / norm)
    return np.array(at, np.int64), np.array(key, np.int64), np.array(weight, np.float64)


def _kernel(words: list[bytes], marks: tuple[np.ndarray, np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """Kernel values of ``words`` with the ``m`` landmarks."""
    used, place = np.unique(marks[1], return_inverse=True)
    dense = np.zeros((len(used) + 1, m), np.float32)
    dense[place, marks[0]] = marks[2]
    where = np.full(CLASSES ** 3, len(used), np.int32)
    where[used] = np.arange(len(used))
    out = np.zeros((len(words), m), np.float32)
    for at in range(0, len(words), 512):
        part = words[at:at + 512]
        c = np.frombuffer(b"".join(part), np.uint8)
        length = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.cumsum(length) - length
        rest = np.repeat(starts + length, length) - np.arange(len(c))
        codes, total = np.r_[c, np.zeros(SPAN, np.uint8)].astype(np.int32), np.zeros((len(c), m), np.float32)
        for d1, d2 in PAIRS:
            key = codes[:len(c)] << 12 | codes[d1:len(c) + d1] << 6 | codes[d2:len(c) + d2]
            total += dense[np.where(rest > d2, where[key], len(used))] * np.float32(DECAY ** (d2 + 1))
        out[at:at + 512] = np.add.reduceat(total, starts, axis=0) / norms(length - 1)[:, None]
    return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss: minimises ridge/2 |v|^2 + sum weight * max(0, 1 - y f)^2 / 2."""
    a = np.c_[x, np.ones(len(x))].astype(np.float64)
    v, penalty = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]

    def loss(u: np.ndarray) -> float:
        return float((penalty * u * u).sum() / 2 + (weight * np.maximum(0, 1 - y * (a @ u)) ** 2).sum() / 2)

    for _ in range(30):
        slack = 1 - y * (a @ v)
        on = slack > 0
        grad = penalty * v - a[on].T @ (weight[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(penalty) + a[on].T @ (a[on] * weight[on, None]), grad)
        size, now = 1.0, loss(v)
        while size > 1e-4 and loss(v - size * step) > now:
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return v[:-1], float(v[-1])


def _fit_words(positive: Counter, negative: list[bytes], in_clean: Counter, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Table and bias of the machine that tells ``positive`` words from ``negative`` ones (hardest first).

    Landmarks: the most frequent positive words, the hardest negative ones, negative ones at
    random, and beyond ``LANDMARKS`` the positive ones that are like none of these.
    """
    marked = [w for w, _ in positive.most_common(LANDMARKS // 2)] + negative[:LANDMARKS // 4]
    marked += [negative[i] for i in rng.permutation(len(negative))[:max(0, LANDMARKS - len(marked))]]
    marked = list(dict.fromkeys(marked))
    marked += _unlike([w for w, _ in positive.most_common()], marked)
    entries = _landmark_tables(marked)
    gram = _kernel(marked, entries, len(marked)).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    inserted = _with_insertions(positive, rng)
    words = [*positive, *inserted, *negative]
    x = _kernel(words, entries, len(marked)) @ root
    y = np.r_[np.ones(len(positive) + len(inserted)), -np.ones(len(negative))]
    count = np.r_[np.minimum(np.array(list(positive.values()), float), 20.0), list(inserted.values()), [min(in_clean[w], 20) for w in negative]]
    count[y > 0] *= max(1.0, 0.5 * count[y < 0].sum() / count[y > 0].sum())
    v, bias = _newton(x, y, count)
    table = np.zeros(CLASSES ** 3)
    np.add.at(table, entries[1], entries[2] * (root @ v)[entries[0]])
    return table, bias


def _unlike(words: list[bytes], marked: list[bytes]) -> list[bytes]:
    """Of ``words``, in turn, those whose kernel values with all landmarks and with the ones taken before are below ``UNLIKE``."""
    def far(some: list[bytes], others: list[bytes]) -> np.ndarray:
        return _kernel(some, _landmark_tables(others), len(others)).max(axis=1) < UNLIKE

    out: list[bytes] = []
    left = [w for w, x in zip(words, far(words, marked), strict=True) if x]
    while left:
        part, left = left[:LANDMARKS], left[LANDMARKS:]
        gram = _kernel(part, _landmark_tables(part), len(part))
        taken: list[int] = []
        for i in range(len(part)):
            if not taken or gram[i, taken].max() < UNLIKE:
                taken.append(i)
        new = [part[i] for i in taken]
        out += new
        left = [w for w, x in zip(left, far(left, new), strict=True) if x] if left else []
    return out


def _with_insertions(words: Counter, rng: np.random.Generator) -> dict[bytes, float]:
    """Copies of the words of five letters or more with a random letter inserted at each inner place, and their small weights."""
    out: dict[bytes, float] = {}
    for word, n in words.items():
        places = range(3, len(word)) if len(word) > 5 else ()
        for at in places:
            copy = word[:at] + bytes([int(rng.integers(1, 27))]) + word[at:]
            if copy not in words:
                out[copy] = INSERTED * min(n, 20) / len(places)
    return out


def fit(toxic: list[str], clean: list[str], seed: int = 8, evidence: Evidence | None = None) -> Machine:
    """Machine from labelled texts. Without texts of both classes the score is a constant (0.9 for toxic ones only, else 0.1).

    With ``evidence`` of a larger table, the texts are a sample of it, and words are judged and chosen over the whole of it.
    """
    rng = np.random.default_rng(seed)
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    bags, other = [Counter(_words(t)) for t in toxic], [set(_words(t)) for t in clean]
    bags = [b for b in bags if b]
    in_clean = Counter(w for b in other for w in b)
    if not bags or not in_clean:
        return Machine(np.zeros(CLASSES ** 3), 0.0, (0.0, 2.2 if bags else -2.2))
    in_toxic = Counter(w for b in bags for w in b)
    # Words that toxic texts hold at least ten times as often as clean ones. Labels err at times, so none need be absent from clean texts.
    open_to = evidence.open_of(in_clean) if evidence else {w for w, n in in_toxic.items() if in_clean[w] * 10 * len(bags) <= n * len(other)}
    types = sorted(w for w in in_clean if w not in open_to)

    def chosen(value, first: float, second: float) -> Counter:
        """The two best words of each toxic text; none of a text whose best is below ``first``, as its label may be wrong."""
        out: Counter = Counter()
        for b in bags:
            best = sorted((w for w in b if w in open_to), key=lambda w: (-value(w), w))[:2]
            out.update(w for w, least in zip(best, (first, second), strict=False) if value(w) >= least)
        return out

    # First choice: words, or beginnings of words absent from clean texts, by the number of toxic texts they occur in.
    prefix = Counter()
    for b in bags:
        prefix.update({w[:5] for w in b})
    clean_prefix = {w[:5] for w in types}
    if evidence:
        positive = evidence.chosen(None, 0.0, min(3, 1 + evidence.toxic // 20), 3)
    else:
        positive = chosen(lambda w: max(in_toxic[w], 0 if w[:5] in clean_prefix else prefix[w[:5]]), min(3, 1 + len(bags) // 20), 3)
    negative = [types[i] for i in rng.permutation(len(types))[:6000]]
    table, bias = np.zeros(CLASSES ** 3), 0.0
    pool = sorted(in_toxic)
    for turn in range(ROUNDS):
        if not positive or not negative:
            break
        table, bias = _fit_words(positive, negative, in_clean, rng)
        hard = np.argsort(-_score_words(table, types), kind="stable")[:3000]
        negative = list(dict.fromkeys([*(types[i] for i in hard), *(types[i] for i in rng.permutation(len(types))[:4000])]))
        if evidence:
            positive = evidence.chosen(table, bias, DOUBTFUL, 0.0)
        else:
            value = dict(zip(pool, _score_words(table, pool) + bias, strict=True))
            positive = chosen(value.__getitem__, DOUBTFUL, 0.0)
    machine = Machine(table, bias, (1.0, 0.0))
    best = np.array([machine.best(t) for t in (*toxic, *clean)])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    trusted = (y == 0) | (best >= DOUBTFUL)
    if y[trusted].any():
        best, y = best[trusted], y[trusted]
    machine.calibration = _logistic(best, y)
    return machine


def _score_words(table: np.ndarray, words: list[bytes]) -> np.ndarray:
    out = []
    for at in range(0, len(words), 20_000):
        part = words[at:at + 20_000]
        length = np.fromiter(map(len, part), np.int64, len(part))
        out.append(word_scores(table.astype(np.float32), np.frombuffer(b"".join(part), np.uint8), np.cumsum(length) - length, length - 1))
    return np.concatenate(out) if out else np.empty(0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope (not negative) and intercept of the best word score. Both classes weigh the same."""
    a, v = np.c_[x, np.ones(len(x))], np.zeros(2)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ v)))
        grad = a.T @ (weight * (p - y)) + ridge * v
        v = v - np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
    return max(0.0, float(v[0])), float(v[1])


WORD, BEGINNING, OF_TEXT = 0, 1, 2


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, code, toxic, clean) from (code, label, copies, text): texts of each class that hold a word, and that
    hold a word with a beginning of four letters, folded whenever 200,000 have gathered; and the words of every toxic text.

    A row that is there ``copies`` times counts as that part of a text.
    """
    counts = {(kind, label): Counter() for kind in (WORD, BEGINNING) for label in (0, 1)}
    names = ["word", "kind", "code", "toxic", "clean"]

    def flush():
        for (kind, label), own in counts.items():
            n, none = len(own), pa.array(np.zeros(len(own)))
            some = pa.array(list(own.values()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.int64()),
                                              some if label else none, none if label else some], names)
            own.clear()

    for batch in batches:
        for code, label, copies, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = {w for block in blocks(text) for w in _words(block)}
            for kind, some in ((WORD, words), (BEGINNING, {w[:5] for w in words})):
                counts[kind, int(label)].update(some if copies == 1 else dict.fromkeys(some, 1 / copies))
            if label and words:
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array([OF_TEXT] * n, pa.int32()), pa.array([code] * n, pa.int64()),
                                                  pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names)
            if sum(map(len, counts.values())) > 200_000:
                yield from flush()
    yield from flush()


class Evidence:
    """Counts of words over all labelled texts ``rows(code, label, copies, text)``, and choices of words over all toxic ones.

    ``words`` holds the words that toxic texts hold at least ten times as often as clean ones, with the
    value of the first choice and whether their counts are sure: chance would bring less than one such word
    among all words (Chernoff bound of the binomial tail). ``bags`` holds these words of every toxic text.
    """

    def __init__(self, rows: DataFrame, toxic: int, clean: int, last: int | None):
        """``toxic`` and ``clean``: numbers of texts; ``last``: highest code of the sampled toxic texts."""
        self.toxic = toxic
        found = written(rows.select("code", "label", "copies", "text")
                        .mapInArrow(_count_words, "word binary, kind int, code long, toxic double, clean double"), "word_rows")
        counts = written(found.where(F.col("kind") != OF_TEXT).groupBy("word", "kind").agg(F.round(F.sum("toxic")).alias("toxic"), F.round(F.sum("clean")).alias("clean")), "word_counts")
        counts = counts.withColumn("open", (F.col("toxic") > 0) & (F.col("clean") * 10 * toxic <= F.col("toxic") * clean))
        words = counts.where(F.col("kind") == WORD)
        n, share = F.col("toxic") + F.col("clean"), toxic / max(1, toxic + clean)
        bound = (F.col("toxic") * F.log(F.col("toxic") / (n * share))
                 + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * max(1 - share, 1e-9)))).otherwise(0.0))
        sure = (bound > float(np.log(max(1, words.count()))))
        taken = (words.groupBy(F.substring("word", 1, 5).alias("start")).agg(F.max(~F.col("open") & (F.col("clean") > 0)).alias("taken")))
        starts = (counts.where(F.col("kind") == BEGINNING).select(F.col("word").alias("start"), F.col("toxic").alias("started")).join(taken, "start"))
        self.words = written(words.where("open").withColumn("sure", sure).withColumn("start", F.substring("word", 1, 5)).join(starts, "start")
                             .select("word", "sure", "clean", F.when(F.col("taken"), F.col("toxic")).otherwise(F.greatest("toxic", "started")).alias("value")), "open_words")
        sampled = F.col("code") <= F.lit(last) if last is not None else F.lit(False)
        self.bags = written(found.where(F.col("kind") == OF_TEXT).select("code", "word").join(self.words, "word")
                            .groupBy("code").agg(F.collect_set(F.struct("word", "value", "sure")).alias("words"))
                            .select(sampled.alias("sampled"), "words.word", "words.value", "words.sure"), "bags")

    def open_of(self, words) -> set[bytes]:
        """Those of ``words``, which clean texts hold, that are open."""
        some = self.words.sparkSession.createDataFrame([(bytearray(w),) for w in sorted(words)], "word binary")
        return {bytes(r["word"]) for r in self.words.where("clean > 0").join(some, "word", "left_semi").select("word").collect()}

    def chosen(self, table: np.ndarray | None, bias: float, first: float, second: float) -> Counter:
        """Numbers of toxic texts that choose a word as one of their two best, by ``table`` or else the value of the first choice.

        Words that sampled texts choose, and sure ones that three texts choose.
        """
        sent = self.bags.sparkSession.sparkContext.broadcast(None if table is None else table.astype(np.float32))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[bytes, list] = {}
                sampled, words, values, sures = (batch.column(i).to_pylist() for i in range(4))
                pool = sorted({w for bag in words for w in bag})
                scores = dict(zip(pool, _score_words(sent.value, pool) + bias, strict=True)) if sent.value is not None else None
                for own, bag, given, sure in zip(sampled, words, values, sures, strict=True):
                    value = given if scores is None else [scores[w] for w in bag]
                    best = sorted(range(len(bag)), key=lambda i: (-value[i], bag[i]))[:2]
                    for i, least in zip(best, (first, second), strict=False):
                        if value[i] >= least:
                            count = out.setdefault(bag[i], [0, 0, sure[i]])
                            count[0] += 1
                            count[1] += own
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), *(pa.array([c[k] for c in out.values()], kind)
                                                  for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_())))], ["word", "n", "own", "sure"])

        picked = self.bags.mapInArrow(pick, "word binary, n long, own long, sure boolean").groupBy("word", "sure").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
        rows = picked.where((F.col("own") > 0) | (F.col("sure") & (F.col("n") >= 3))).collect()
        sent.destroy()
        return Counter(dict(sorted((bytes(r["word"]), r["n"]) for r in rows)))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Machine from the learnable labelled rows of ``docs``: words are counted and chosen over all of them.

    The sample holds, of each class, the texts lowest by hash, up to the stated bounds.
    """
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("code"))
    known = written(texts.select("doc_id", "code", F.octet_length("text").alias("bytes")).join(labels_of(labels, "toxic", FOLDS, HELD_OUT), F.col("doc_id") == F.col("label_id"))
                    .groupBy("doc_id", "code", "label").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies")), "learnable")

    def sample(label: int, most: int) -> tuple[list[str], int | None]:
        # At most ``most`` pairs of id and code; only their texts are fetched, and no text is shuffled.
        keys = known.where((F.col("label") == label) & (F.col("bytes") <= SAMPLE_BYTES)).orderBy("code", "doc_id").limit(most)
        picked = keys.select(F.col("doc_id").alias("picked_id"), F.col("code").alias("picked_code"))
        same = (F.col("doc_id") == F.col("picked_id")) & (F.xxhash64("text") == F.col("picked_code"))
        found = docs.select("doc_id", "text").join(F.broadcast(picked), same, "left_semi").select("text").distinct()
        return [r["text"] for r in found.collect()], picked.agg(F.max("picked_code")).first()[0]

    (toxic, last), (clean, _) = sample(1, SAMPLE_TOXIC), sample(0, SAMPLE_CLEAN)
    # One row stands for all copies of a text in a class.
    each = known.groupBy("code", "label").agg(F.min(F.struct("doc_id", "copies")).alias("one")).select("code", "label", "one.doc_id", "one.copies")
    sizes = {int(r["label"]): r["count"] for r in each.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return fit(toxic, clean)
    # Labels grow with the documents, so none are broadcast: the learnable texts are shuffled once, at every size.
    rows = texts.where(is_learnable(F.col("doc_id"), FOLDS, HELD_OUT)).join(each.hint("merge"), ["doc_id", "code"])
    return fit(toxic, clean, evidence=Evidence(rows, sizes[1], sizes[0], last))


def score_column(spark, machine: Machine, text):
    """Column of toxicity scores of a text column."""
    sent = spark.sparkContext.broadcast(machine)

    @F.pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null, empty and word-free texts get the score of a text without any word; a null
    id is not held out and never learned from; repeated rows are scored each; other
    columns are not read. Documents without a label are scored like the others.
    """
    small_batches(docs.sparkSession)
    machine = train(docs, labels)
    held = F.coalesce(~is_learnable(F.col("doc_id"), FOLDS, HELD_OUT), F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score_column(docs.sparkSession, machine, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` scored below the threshold, with the same columns."""
    small_batches(docs.sparkSession)
    machine, score = train(docs, labels), fresh("score", docs.columns)
    return docs.select("*", score_column(docs.sparkSession, machine, F.col("text")).alias(score)).where(F.col(score) < THRESHOLD).select(*docs.columns)


def op8_kernel_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
