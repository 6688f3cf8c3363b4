import hashlib

from emberline.llm import prefix_hashes as P

from .cases import docs, empty


def common_part(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def like(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    first = common_part(a, b)
    return (first + min(common_part(a[::-1], b[::-1]), min(len(a), len(b)) - first)) / max(len(a), len(b))


def test_spans_and_extensions():
    a, b = P.Prefixes("abcabcabd😀"), P.Prefixes("xabcabd😀")
    assert P.spans_equal(a, 3, b, 1, 7) and not P.spans_equal(a, 0, b, 1, 6) and P.spans_equal(a, 5, b, 2, 0)
    assert P.extension(a, b) == 0 and P.extension(a, b, backwards=True) == 7
    spliced = P.Prefixes.spliced(a, 4, b, 3)
    assert spliced.text == "abcaxab" and spliced.fingerprint() == P.Prefixes("abcaxab").fingerprint()


def test_against_plain_strings(spark):
    d = docs(spark, extra=[(20 + i, "beginning " + "ab" * i + " end", "en", "a", 1, 1.0, "", 1) for i in range(30)])
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in d.collect())
    found = P.fingerprints(d)
    got = sorted(found.collect(), key=lambda r: ((r["doc_id"] is not None, r["doc_id"] or 0), r["edited_sha256"]))
    want = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((key, hashlib.sha256(edited.encode()).hexdigest(), len(text), P.Prefixes(text).fingerprint(), P.Prefixes(edited).fingerprint(),
                     like(text, edited), like(text, after)))
    want.sort(key=lambda r: r[:2])
    assert [((r["doc_id"] is not None, r["doc_id"] or 0), r["edited_sha256"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"],
             r["near_edited"], r["near_next"]) for r in got] == want


def test_empty_and_single(spark):
    assert P.fingerprints(empty(spark)).count() == 0
    one = P.fingerprints(docs(spark).where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
