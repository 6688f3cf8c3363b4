import collections
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from emberline.llm import decision_lists as D

from .cases import docs, empty, labels


def plain(text):
    """Counts of the contract in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_chars": len(text), "n_lines": len(lines),
            "n_distinct": len(set(words)), "n_next": sum(a == b for a, b in zip(words, words[1:]))}


def texts():
    rng = random.Random(2)
    out = ["", " \n\t\x0b\x0c\r ", "a", "same line\nsame line\n\n \nsame line ", "x " * 7, "x " * 8, "x " * 9, "a b c d e f g h " * 2, "é 😀  # | <>"]
    for _ in range(300):
        out.append("".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "\t", "#", "é", "\r"]) for _ in range(rng.randrange(200))))
    return out


def test_counts_against_plain_python():
    found = D.counts(pa.array(texts()))
    for k, text in enumerate(texts()):
        want = plain(text)
        assert {c: int(found[c][k]) for c in want} == want, text


def test_edge_rows_and_base_rules(spark):
    d = docs(spark, [(20 + i, t, "en", "a", 1, 1.0, "", 1) for i, t in enumerate(texts())])
    out, rules = D.judged(d, labels(spark, []))
    rows = out.collect()
    assert rules.rules == [] and len(rows) == d.count()
    want = sorted(tuple(plain(r["text"]).values()) for r in d.collect())
    assert sorted(tuple(r[c] for c in plain("")) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    # Labels of one kind, null labels, null and repeated ids.
    for given in ([(1, 1, 0), (5, 1, 0), (None, 0, 0), (7, None, None)], [(5, 0, 0), (5, 0, 1), (6, 0, 0)]):
        assert D.judged(d, labels(spark, given))[0].count() == d.count()
    assert D.judged(empty(spark), labels(spark, []))[0].count() == 0


def made(spark, n=3000, noise=0.0, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(1000), rng.randrange(1000), rng.randrange(100_000)
        bad = (a > 700 and b <= 300) or c > 90_000
        rows.append((i, (bad != (rng.random() < noise)), rng.random() < 0.67, a, b, c))
    return spark.createDataFrame(rows, "id long, reject boolean, grow boolean, a long, b long, c long")


def test_covering_finds_planted_rules(spark):
    rows = made(spark).persist()
    found = D.fit(rows, ["a", "b", "c"])
    assert {frozenset((c.statistic, c.above) for c in r) for r in found.rules} >= {frozenset({("c", True)})}
    assert 2 <= len(found.rules) <= 6
    wrong = rows.where(found.kept() == F.col("reject")).count()
    assert wrong <= 0.02 * 3000, str(found)
    noisy = D.fit(made(spark, noise=0.5), ["a", "b", "c"])
    assert len(noisy.rules) <= 1, str(noisy)
    rows.unpersist()


def brute_best(values, names):
    """Most gain over every threshold between neighbouring cells, from the rows themselves."""
    import math
    best = (0.0, None)
    p0 = sum(v["reject"] for v in values)
    n0 = len(values) - p0
    for name in names:
        def cell(x):
            step = 10 ** max(len(str(x)) - 2, 0)
            return -(-x // step) * step
        groups = collections.defaultdict(list)
        for v in values:
            groups[cell(v[name])].append(v[name])
        order = sorted(groups)
        for here, after in zip(order, order[1:]):
            at = (max(groups[here]) + min(groups[after])) // 2
            for above in (True, False):
                covered = [v for v in values if (v[name] > at) == above]
                p = sum(v["reject"] for v in covered)
                if p:
                    gain = p * (math.log2(p / len(covered)) - math.log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, above, at, p, len(covered) - p))
    return best


def test_best_condition_against_brute_force(spark):
    rows = made(spark, 400, noise=0.1)
    names = ["a", "b", "c"]
    condition, p, n = D.best_condition(D._cells(rows, names), names)
    gain, want = brute_best([r.asDict() for r in rows.collect()], names)
    got = D._gain(p, n, rows.where("reject").count(), rows.where("not reject").count())
    assert abs(got - gain) < 1e-6 and condition.statistic == want[0]
    seen = rows.where(condition.column()).agg(F.sum(F.col("reject").cast("long")), F.sum((~F.col("reject")).cast("long"))).first()
    assert tuple(seen) == (p, n)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out, rules = D.judged(D.read_table(spark, sf, "documents"), D.read_table(spark, sf, "labels"))
    held = out.join(D.read_table(spark, sf, "labels").select(F.col("doc_id").alias("i"), "quality"), F.col("doc_id") == F.col("i"))
    held = held.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    clean = held.where("quality = 1 and not base_failed")
    junk = held.where("quality = 0")
    assert rules.rules and clean.where("kept").count() >= 0.97 * clean.count() and junk.where("not kept").count() >= 0.85 * junk.count()
