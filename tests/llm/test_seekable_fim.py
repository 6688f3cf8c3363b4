import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import seekable_fim as S

from .cases import docs, empty


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """The contract in plain Python: form, prefix length, middle length, output."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def extra():
    rng = random.Random(5)
    rows = []
    for i in range(200):
        text = "".join(rng.choice("ab <P>SM\né😀́") for _ in range(rng.randrange(60)))
        rows.append((100 + i, text, "en", "a", 1, 1.0, "", 1))
    return [*rows, (400, "has <M> inside", "en", "a", 1, 1.0, "", 1), (401, "<", "en", "a", 1, 1.0, "", 1)]


def test_against_plain_python_with_edge_rows(spark):
    d = docs(spark, extra())
    for units in (3, 1 << 16):
        out = S.fill_in_middle(d, frame_units=units).persist()
        want = sorted(((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()), key=str)
        texts = sorted(((r["doc_id"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in S.texts(out).collect()), key=str)
        assert texts == sorted(((i, *plain(i, t)) for i, t in want), key=str)
        found = sorted(((r["doc_id"], r["n"], r["output_sha256"], r["restored_sha256"]) for r in S.digests(out).collect()), key=str)
        assert found == sorted(((i, len(t or ""), sha(plain(i, t)[3]), sha(t or "")) for i, t in want), key=str)
        out.unpersist()
    assert S.digests(S.fill_in_middle(empty(spark))).count() == 0


def test_only_cut_frames_are_compressed_again(spark):
    text = "".join(chr(97 + k % 26) for k in range(10_000))
    stored = S.store(spark.createDataFrame([(1, text)], "doc_id long, text string"), frame_units=100).first()
    assert stored["n"] == 10_000 and [f["first"] for f in stored["frames"]] == list(range(0, 10_000, 100))
    frames = S.Frames([f.asDict() for f in stored["frames"]])
    out = S.assemble(frames, "psm", 1234, 7890)
    kept = {id(f["data"]) for f in frames.rows}
    # Three sentinels and both sides of two cut frames are new.
    assert sum(id(f["data"]) not in kept for f in out.rows) == 3 + 4
    assert out.units == 10_009 and "".join(S.restore(out, "psm").texts()) == text


@settings(max_examples=200, deadline=None)
@given(st.text("<PSM>aé😀", max_size=30), st.integers(1, 7), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm", "plain"]))
def test_round_trip(text, units, a, b, form):
    for mark in ("<P>", "<S>", "<M>"):
        text = text.replace(mark, "")
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    frames = S.Frames()
    frames.write(text, units)
    out = S.assemble(frames, form, a, b)
    assert "".join(S.restore(out, form).texts()) == text
    joined = "".join(out.texts())
    for mark in ("<P>", "a", "Sa", "é😀"):
        for start in (0, 1, a):
            assert out.find(mark, start) == joined.find(mark, start)


def test_draws(spark):
    h = [r for r in spark.range(5).select("id", F.array(*S.draws(F.col("id"))).alias("h")).collect()]
    for r in h:
        code = hashlib.sha256(f"1:{r['id']}".encode()).hexdigest()
        assert r["h"] == [int(code[8 * k:8 * k + 8], 16) for k in range(4)]
