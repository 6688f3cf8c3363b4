import hashlib
import random
import re
import time

import numpy as np

from emberline.llm import winnowing as W

from .cases import docs, empty

ITEMS = "item_id long, text string, hits string"


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    d, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if w else ():
            for p in range(len(d) - k + 1):
                if d[p:p + k] == w[i:i + k]:
                    hit |= set(range(p, p + k))
                    found.add(name)
    return len(d), len(hit), sorted(found)


def test_every_shared_window_is_found():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)] + ["Ünï", "x9"]
    for _ in range(150):
        items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 12, 13, 14, 40])))) for i in range(4)]
        text = " ".join(rng.choices(vocabulary, k=60)) + " | " + items[0][1][rng.randrange(5):] + ", " + items[1][1]
        spans, found = W.ItemIndex([(n, t.encode()) for n, t in items]).hits(W.words_of(text.encode()))
        n, hit, want = brute(text, items)
        assert sum(b - a for a, b in spans) == hit and found == want


def test_runs_and_repeated_phrases_cost_what_differs():
    rng = random.Random(4)
    for phrase in (["a"], ["a", "b"], "one two three four five six".split()):
        # Short ones against brute force, with other words between the phrases.
        for _ in range(20):
            items = [(str(i), " ".join(w for _ in range(9) for w in (*phrase, *rng.choices("xyz", k=rng.randrange(3))))) for i in range(4)]
            text = " ".join(w for _ in range(14) for w in (*phrase, *rng.choices("xyz", k=rng.randrange(3))))
            spans, found = W.ItemIndex([(n, t.encode()) for n, t in items]).hits(W.words_of(text.encode()))
            _, hit, want = brute(text, items)
            assert sum(b - a for a, b in spans) == hit and found == want
        # A million words against an item of three thousand: one span, within seconds.
        index = W.ItemIndex([("0", " ".join(phrase * 3000).encode())])
        began = time.monotonic()
        spans, found = index.hits(W.words_of(" ".join(phrase * (1_000_000 // len(phrase))).encode()))
        assert spans == [(0, 1_000_000 // len(phrase) * len(phrase))] and found == ["0"]
        assert time.monotonic() - began < 30


def test_winnow_keeps_one_of_every_window():
    h = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    kept = set(W.winnow(h, 8).tolist())
    assert all(any(p in kept for p in range(i, i + 8)) for i in range(len(h) - 7))
    assert not len(W.winnow(h[:5], 8)) and not len(W.winnow(h[:0], 1))


def test_edge_rows_in_one_block_and_many(spark):
    long = "jumps over the lazy dog the quick brown fox jumps over the lazy dog the quick brown fox"
    items = [(1, "this is a small text of some words", None), (2, long, "x"), (3, None, None), (4, "...", None), (None, "mot après", None), (5, "wörtern", None),
             (5, "wörtern", None)]
    d, table = docs(spark), spark.createDataFrame(items, ITEMS)
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    named = [("" if i is None else str(i), t) for i, t, _ in items]
    for block in (W.BLOCK_BYTES, 40):
        out = W.digest(W.contamination(d, table, block_bytes=block, out="found"), "found")
        assert out.columns[:len(d.columns)] == d.columns
        rows = out.collect()
        assert len(rows) == d.count()
        for r in rows:
            n, hit, found = brute(text[r["doc_id"]] if len(text[r["doc_id"]] or "") < 9000 else text[r["doc_id"]][:9000], named)
            assert r["found"]["items"] == found
            if len(text[r["doc_id"]] or "") < 9000:
                assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
            assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
    assert W.contamination(empty(spark), table).count() == 0
    none = W.digest(W.contamination(d, table.limit(0), out="found"), "found").collect()
    assert len(none) == d.count() and not any(r["contaminated"] for r in none)
    kept = W.drop_contaminated(d, table)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 7, 9}
