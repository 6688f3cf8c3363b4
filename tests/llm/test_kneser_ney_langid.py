import numpy as np

from emberline.llm import kneser_ney_langid as L

from .cases import docs, empty

EN = ["the cat sat on the mat and the dog ran away with them", "this is the house that they had built in the north", "there were other things to think of then"]
DE = ["der hund und die katze sind nicht im haus gewesen", "das ist eine schöne straße für uns und für euch", "ich weiß nicht was soll es bedeuten"]
FR = ["le chat est sur la table et le chien est dehors", "c'est une belle journée pour aller à la plage", "nous avons été très contents de vous voir"]


def test_units():
    assert L.units("  A1b😀Ç ").tobytes() == np.array([32, 32, 32, 97, 32, 98, 32, 231, 32], np.uint16).tobytes()
    assert not len(L.units(None)) and not len(L.units("12 😀!")) and len(L.units("𐌰"))


def test_models_are_distributions():
    """Probabilities of all units after a seen context add up to one, less what unseen units get."""
    tables = []
    for texts in (EN, DE):
        keys, n = np.unique(np.concatenate([L.grams(L.units(t)) for t in texts]), return_counts=True)
        tables.append((keys, n))
    m = L.Models(["en", "de"], tables)
    context = tables[0][0][7] >> np.uint64(16)
    every = (context << np.uint64(16)) + np.arange(0x10000, dtype=np.uint64)
    total = (2.0 ** m.log_probabilities(every).astype(np.float64)).sum(axis=0)
    assert np.allclose(total, 1, atol=1e-3)
    assert all((np.diff(o.grams.astype(np.float64)) >= 0).all() for o in m.orders)


def test_learns_and_edge_rows(spark):
    extra = []
    for k, (lang, texts) in enumerate((("en", EN), ("de", DE), ("fr", FR))):
        extra += [(100 + 60 * k + i, " ".join(texts[j % 3] for j in range(i % 5 + 1)) + f" {texts[i % 3][:i]}", lang, "z", 1, 1.0, "", 1) for i in range(60)]
    d = docs(spark, extra)
    found = {r["doc_id"]: r for r in L.identify(d).collect()}
    right = [found[e[0]]["lang_pred"] == e[2] for e in extra]
    assert np.mean(right) > 0.98
    for i in (2, 3, 4, 7):
        assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and found[i]["rejected"]
    assert found[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in found.values())
    assert L.identify(d).count() == d.count() and L.identify(empty(spark)).count() == 0
    unlearned = L.identify(d.withColumn("lang", d.lang.substr(0, 0).cast("string")).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}


def test_blocks_beyond_the_bound_drop_nothing(spark, monkeypatch):
    """Models too large to send whole give the same decisions, from every 4-gram, in several scans."""
    extra = [(100 + 60 * k + i, " ".join(texts[j % 3] for j in range(i % 5 + 1)) + f" {texts[i % 3][:i]}", lang, "z", 1, 1.0, "", 1)
             for k, (lang, texts) in enumerate((("en", EN), ("de", DE), ("fr", FR))) for i in range(60)]
    d = docs(spark, extra)
    rows = lambda: sorted((tuple(r) for r in L.identify(d).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(L, "MODEL_CELLS", 300)
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 700, raising=False)
    cut = rows()
    assert len(cut) == len(whole) and [(r[0], r[1], r[2], r[5]) for r in cut] == [(r[0], r[1], r[2], r[5]) for r in whole]
    assert all(np.allclose(a[3:5], b[3:5], atol=1e-4) for a, b in zip(cut, whole, strict=True))
    assert L.train(d.select("lang", "text")).blocks > 2 and L.identify(empty(spark)).count() == 0


def test_languages_of_the_calibration_fold_alone_are_learned(spark):
    """One distinct French text, in the fold that calibrates: its counts are in the models, and its n-grams with them."""
    some = [f"{FR[0]} {i * 'encore '}" for i in range(60)]
    held = [r["text"] for r in spark.createDataFrame([(t,) for t in some], "text string").where(f"pmod(xxhash64(text), {L.CALIBRATION}) = 0").collect()]
    rows = [(lang, f"{t} {t[:i]}") for lang, texts in (("en", EN), ("de", DE)) for t in texts for i in range(20)] + [("fr", held[0])] * 5
    models = L.train(spark.createDataFrame(rows, "lang string, text string"))
    assert models.langs == ["de", "en", "fr"] and models.decide(held[0])[0] == 2 and models.slope > 0
    assert models.usual[2][1] == np.inf and models.usual[0][1] < np.inf
