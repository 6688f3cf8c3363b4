import numpy as np
import xxhash

from emberline.llm import common
from emberline.llm import simhash_anchors as S

from .cases import docs, empty


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, k=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_and_hamming_cover():
    golay = S._patterns(S.GOLAY_POLYNOMIAL, 23, 3)
    assert all(sum(map(len, by_weight)) == 1 for by_weight in golay)      # perfect: one pattern of weight <= 3 each
    assert all(sum(map(len, by_weight)) == 1 for by_weight in S._patterns(S.HAMMING_POLYNOMIAL, 7, 1))


def test_replicas_reach_the_home_of_every_near_half():
    a, rng = S.Anchors(), np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    homes = a.homes(x)
    assert np.bitwise_count(homes ^ x).max() <= S.RADIUS
    assert not a.syndrome(homes).any()
    for h, v in zip(homes.tolist(), x.tolist()):
        y = v ^ 1 << int(rng.integers(32)) ^ 1 << int(rng.integers(32))
        codewords = {y ^ int(e) for e in a.errors(int(a.syndrome(np.array([y], np.uint32))[0]))}
        assert h in codewords and len(codewords) == len(a.errors(int(a.syndrome(np.array([y], np.uint32))[0])))


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:                                       # chains of links, up to 4 bits a step
        x = int(b)
        for _ in range(12):
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                x ^= 1 << bit
            fps.append(x)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for block in (2048, 2):                                   # a block of 2 makes anchors hot and salted
        links = S.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), home_block=block)
        found = {r["node"]: r["root"] for r in common.components(links).collect()}
        want = groups(fps)
        got = [found.get(s, s) for s in signed]
        pairs = {(a, b) for a, b in zip(want, got)}
        assert len(pairs) == len(set(want)) == len(set(got))


def test_edge_rows(spark):
    d = docs(spark)
    rows = S.near_duplicates(d).collect()
    assert len(rows) == d.count()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in rows:
        assert r["fp"] % (1 << 64) == plain_fingerprint(text[r["doc_id"]])
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    assert comp[0] == comp[1] == 0 and comp[2] == comp[3] == comp[4] == 2 and comp[6] == 5 and comp[9] == 9 and comp[None] is None
    assert S.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    d = docs(spark)
    kept = S.drop_near_duplicates(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([0, 2, 5, None, 7, 8, 9], key=str)
    single = S.drop_near_duplicates(d.where("doc_id < 9"))
    assert single.columns == d.columns and sorted(r["doc_id"] for r in single.collect()) == [0, 2, 5, 7, 8]
    assert S.drop_near_duplicates(empty(spark)).count() == 0
