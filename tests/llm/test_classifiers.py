import zlib

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import kernel_toxicity as K
from emberline.llm import rule_quality as R

from .cases import docs, empty, labels

SYLLABLES = ["the", "an", "er", "on", "re", "st", "nd", "ti", "es", "or", "ha", "ou"]
INSULTS = ["blockhead", "numbskull", "dimwit"]


def sentence(rng, n=12):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n)).capitalize() + "."


def texts(rng, insult, sentences=4):
    parts = [sentence(rng) for _ in range(sentences)]
    if insult:
        for _ in range(2):
            words = parts[k := rng.integers(sentences)].split()
            words.insert(int(rng.integers(len(words))), str(rng.choice(INSULTS)))
            parts[k] = " ".join(words)
    return " ".join(parts)


def test_kernel_tables_equal_plain_sums():
    """The table of triples gives the same score as the sum over landmarks of the kernel."""
    rng = np.random.default_rng(0)
    words = [bytes([K.START, *rng.integers(1, 8, n)]) for n in (1, 2, 3, 5, 9)]
    entries = K._landmark_tables(words)
    weights = rng.normal(size=len(words))
    table = np.zeros(K.CLASSES ** 3)
    np.add.at(table, entries[1], entries[2] * weights[entries[0]])
    gram = K._kernel(words, entries, len(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            shared = sum(v * K._triples(b).get(t, 0) for t, v in K._triples(a).items())
            assert abs(gram[i, j] - shared / K.norms(np.array([len(a) - 1]))[0] / K.norms(np.array([len(b) - 1]))[0]) < 1e-5
    assert np.allclose(K._score_words(table, words), gram @ weights, atol=1e-4)


def test_machine_bears_gaps_and_insertions():
    rng = np.random.default_rng(1)
    m = K.fit([texts(rng, True) for _ in range(150)], [texts(rng, False) for _ in range(300)])
    held = [(texts(rng, y), y) for y in (True, False) for _ in range(100)]
    got = np.array([m.score(t) >= K.THRESHOLD for t, _ in held])
    want = np.array([y for _, y in held])
    assert got[want].mean() > 0.97 and got[~want].mean() < 0.03
    for form in ("n u m b s k u l l", "num-bskull", "nummbskull", "b.l.o.c.k.h.e.a.d", "BLOCKHEAD!"):
        assert m.score(f"There on {form} the tion") >= K.THRESHOLD, form
    assert m.score("the and " * 400_000) < K.THRESHOLD and m.score("the and " * 400_000 + "blockhead") >= K.THRESHOLD
    assert m.score(None) == m.score("") < K.THRESHOLD


def test_machine_without_a_class():
    assert K.fit([], ["a b"]).score("a") < 0.5 < K.fit(["a b"], []).score("a") and K.fit([], []).score(None) < 0.5


def test_toxicity_rows(spark):
    rng = np.random.default_rng(2)
    extra = [(100 + i, texts(rng, i % 3 == 0), "en", "z", 1, 1.0, "", 1) for i in range(300)]
    d = docs(spark, extra)
    known = labels(spark, [(100 + i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (0, None, None), (101, 1, 0)])
    found = {r["doc_id"]: r for r in K.toxicity(d, known).collect()}
    assert K.toxicity(d, known).count() == d.count()
    held = [i for i in range(300) if zlib.crc32(str(100 + i).encode()) % 3 == 1]
    assert all(found[100 + i]["held_out"] for i in held) and not found[None]["held_out"]
    assert np.mean([found[100 + i]["predicted"] == (i % 3 == 0) for i in held]) > 0.95
    kept = K.drop_toxic(d, known)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}
    assert K.toxicity(empty(spark), known).count() == 0
    assert K.toxicity(d, known.limit(0)).where("predicted = 0").count() == d.count()


def test_insults_outside_the_sample_are_learned(spark, monkeypatch):
    """An insult unlike the others that one toxic text in twenty holds, so about two of the sample, is found in new texts."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(K, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(K, "SAMPLE_CLEAN", 150)
    extra = [(100 + i, texts(rng, i % 3 == 0 and i % 60 != 3), "en", "z", 1, 1.0, "", 1) for i in range(1500)]
    extra = [(i, f"{t} Zygmuquix {sentence(rng)}" if i % 60 == 43 else t, *rest) for i, t, *rest in extra]
    d = docs(spark, extra)
    toxic = {e[0]: int((e[0] - 100) % 3 == 0) for e in extra}
    machine = K.train(d, labels(spark, list((i, 1, y) for i, y in toxic.items())))
    fresh = [sentence(rng) for _ in range(100)]
    assert np.mean([machine.score(f"{t} zygmuquix {t}") >= K.THRESHOLD for t in fresh]) > 0.95
    assert np.mean([machine.score(f"{t} dimwit {t}") >= K.THRESHOLD for t in fresh]) > 0.95
    assert np.mean([machine.score(t) >= K.THRESHOLD for t in fresh]) < 0.05


def test_paths_of_a_printed_forest():
    debug = """Model: (uid=x, numTrees=2)
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     Predict: 1.0
    Else (feature 0 > 0.5)
     If (feature 2 <= 1.0E-3)
      Predict: 0.0
     Else (feature 2 > 1.0E-3)
      Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 7.0)
     Predict: 1.0
    Else (feature 1 > 7.0)
     Predict: 0.0
"""
    got = R.paths(debug, ["a", "b", "c"])
    assert got == [(("a", "<=", 0.5),), (("a", ">", 0.5),), (("a", ">", 0.5), ("c", "<=", 0.001)), (("a", ">", 0.5), ("c", ">", 0.001)),
                   (("b", "<=", 7.0),), (("b", ">", 7.0),)]


def test_quality_rows(spark):
    rng = np.random.default_rng(3)
    junk = lambda: rng.choice([" ".join([sentence(rng).upper() + "!!"] * 3), "spam " * 40, "### $$$ " + sentence(rng).replace(" ", "### ")])
    extra = [(100 + i, str(junk()) if i % 4 == 0 else texts(rng, False), "en", "z", 1, 1.0, "", 1) for i in range(240)]
    d = docs(spark, extra)
    known = labels(spark, [(100 + i, int(i % 4 != 0), 0) for i in range(240)] + [(None, 1, 1), (0, None, None)])
    found = {r["doc_id"]: r for r in R.quality(d, known).collect()}
    held = [i for i in range(240) if zlib.crc32(str(100 + i).encode()) % 5 == 0]
    assert all(found[100 + i]["held_out"] for i in held)
    assert np.mean([found[100 + i]["predicted"] == (i % 4 != 0) for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert R.quality(empty(spark), known).count() == 0 and R.quality(d, known.limit(0)).count() == d.count()
    values = d.where("doc_id in (2, 3)").select(*[e.cast("double").alias(c) for c, e in R.statistics(F.col("text")).items()]).distinct().collect()
    assert len(values) == 1 and list(values[0].asDict()) == R.STATISTICS
