"""The pipeline end to end on rows with nulls, empty and long texts, ties, repeated rows and extra columns; and without rows."""

import zlib

import pytest

import corpus_pipeline as C

from .cases import DOCS, docs, labels

TOXIC = ["you are a total zorkbag and nobody likes you", "what a zorkbag this writer is, go away", "only a zorkbag would say such a thing"]
CLEAN = ["the weather in the north is mild today", "we walked along the river until evening", "this recipe needs flour and two eggs"]
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


@pytest.fixture()
def folder(spark, tmp_path):
    # Labelled rows, a benchmark passage, exact and near copies, and the rows of the edge cases.
    more = [(100 + i, f"{(TOXIC if i % 2 else CLEAN)[i // 2 % 3]} number {i} {zlib.crc32(str(i).encode())}", "en", "a", 60, 0.5, "x", 1) for i in range(120)]
    more += [(500, f"some words before {PASSAGE} and after", "en", "b", 90, 0.5, "x", 1), (501, "the cat sat on the mat by the door all day", "en", "b", 42, 0.5, "x", 1),
             (502, "the cat sat on the mat by the door all day", "en", "b", 42, 0.5, "x", 1)]
    path = str(tmp_path)
    docs(spark, more).write.parquet(f"{path}/documents.parquet")
    labels(spark, [(100 + i, 1, i % 2) for i in range(120)] + [(None, None, 1), (3, 1, 0)]).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_in_order(spark, folder):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "mix", "sharding"]
    left, kept = C.common.read_table(spark, folder, "documents"), {}
    columns = left.columns
    for name, stage in C.STAGES[:-1]:
        left = C.common.written(stage(spark, left, folder), name)
        assert left.columns == columns
        kept[name] = [r["doc_id"] for r in left.select("doc_id").collect()]
    clean = {100 + i for i in range(0, 120, 2)} | {2, 3, 4, 5, 6, 9, 500, 501, 502}
    assert clean <= set(kept["toxicity"])
    assert sum(i % 2 for i in kept["toxicity"] if i and 100 <= i < 220) <= 6
    assert len({501, 502} & set(kept["near_dedup"])) == 1 and len({5, 6} & set(kept["near_dedup"])) == 1 and kept["near_dedup"].count(9) <= 1
    assert 500 in kept["near_dedup"] and set(kept["near_dedup"]) - set(kept["decontamination"]) == {500}
    assert set(kept["mix"]) <= set(kept["decontamination"]) and all(kept["mix"].count(i) <= 2 for i in set(kept["mix"]))
    out = C.run(spark, folder).collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted(kept["mix"], key=str)
    assert all(0 <= r["shard"] < 24 and r["law"] == "bytes" for r in out)
    for shard in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_no_documents(spark, folder, tmp_path):
    nothing = spark.createDataFrame([], DOCS)
    for name, stage in C.STAGES[1:-1]:
        assert stage(spark, nothing, folder).count() == 0, name
    assert C.sharding(spark, nothing, folder).count() == 0
