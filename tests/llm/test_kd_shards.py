import zlib

import numpy as np
import pandas as pd

from emberline.llm import kd_shards as K

from .cases import docs, empty


def check(rows, shards):
    p = pd.DataFrame(rows, columns=["doc_id", "size", "text_crc32", "shard", "slot"])
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert p.empty or p.shard.between(0, shards - 1).all()
    return p


def brute(rows, shards, first=0):
    """Shards of ``rows`` (dims, size, id), splitting a sorted list in memory; spread as of all rows."""
    spread = [max(1, max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) for d in range(len(rows[0][0]))]

    def split(part, n, first):
        if n == 1 or not part:
            return {r[2]: first for r in part}
        d = max(range(len(spread)), key=lambda d: (max(r[0][d] for r in part) - min(r[0][d] for r in part)) / spread[d])
        part = sorted(part, key=lambda r: (r[0][d], r[2]))
        half, total, at, left = n // 2, sum(r[1] for r in part), 0, 0
        for r in part:
            if not (2 * at + r[1]) * n < 2 * total * half:
                break
            at += r[1]
            left += 1
        return split(part[:left], half, first) | split(part[left:], n - half, first + half)

    return split(rows, shards, first)


def test_matches_plain_recursion(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(rng.integers(1, 400)), "hot" if i % 3 else f"s{i % 7}", "en" if i % 5 else "de") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    p = check([tuple(r) for r in K.kd_shards(d, 24).collect()], 24)
    code = lambda s: zlib.crc32(s.encode())
    want = brute([((len(t) + 8, code(s), code(g)), len(t) + 8, i) for i, t, s, g in rows], 24)
    assert dict(zip(p.doc_id, p.shard)) == want
    sizes = p.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() < 2 * 408


def test_target_bytes_and_equal_rows(spark):
    d = spark.createDataFrame([(1, "same text", "a")] * 100, "doc_id long, text string, source string")
    p = check([tuple(r) for r in K.kd_shards(d, None, target_bytes=170).collect()], 10)
    assert p.groupby("shard").size().tolist() == [10] * 10


def test_edge_rows(spark):
    d = docs(spark)
    found = K.kd_shards(d)
    p = check([tuple(r) for r in found.collect()], 24)
    assert len(p) == d.count()
    assert p[p.doc_id == 2][["size", "text_crc32"]].values.tolist() == [[8, 0]]
    assert p[p.doc_id == 8].text_crc32.tolist() == [zlib.crc32("mot après mot après mot après mot".encode())]
    assert K.kd_shards(empty(spark)).count() == 0
    out = K.contract(found)
    assert {r["law"] for r in out.collect()} == {"bytes"} and out.columns[-1] == "grown_shard"


def test_text_ids_and_many_leaves(spark):
    rows = [(f"doc-{i}" if i % 3 else None, "x" * (i % 50), f"s{i % 5}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id string, text string, source string")
    p = check([tuple(r) for r in K.kd_shards(d, 500).collect()], 500)
    assert sorted(p.doc_id, key=str) == sorted((r[0] for r in rows), key=str)
    sizes = p.groupby("shard")["size"].sum()
    assert len(sizes) == 500 and sizes.max() - sizes.min() < 2 * 58
