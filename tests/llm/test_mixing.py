import collections

from pyspark.sql import functions as F

from emberline.llm import mixing as M

from .cases import docs, empty


def fill(sizes):
    """Targets by plain repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, open_to = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_to:
        unit = left / sum(weight[s] for s in open_to)
        full = {s for s in open_to if weight[s] * unit > 2 * sizes[s]}
        if not full:
            return goal | {s: weight[s] * unit for s in open_to}
        for s in full:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        open_to -= full
    return goal


def taken_of(rows):
    n = collections.Counter()
    for r in rows:
        n[r["source"]] += r["copies"] * r["size"]
    return n


def test_targets_and_copies(spark):
    rows = [(i, s, 5 + (i * 37) % 200) for i, s in enumerate(["hot"] * 400 + ["a", "b"] * 60 + [None] * 30 + ["tiny"] * 5)]
    found = M.copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal = fill(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * goal[r["source"]] and r["source_size"] == sizes[r["source"]]
        rate = r["target"] / r["source_size"]
        assert 0 <= r["copies"] <= 2 and int(rate) <= r["copies"] <= int(rate) + 1
    for s, n in taken_of(found).items():
        assert abs(n - goal[s]) <= 205
    again = M.copies(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long").repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in found)


def test_edge_rows(spark):
    d = docs(spark)
    sized = d.select("doc_id", "source", M.word_count(F.col("text")).alias("size"))
    counts = {r["doc_id"]: r["size"] for r in sized.collect()}
    assert counts[2] == counts[3] == counts[4] == 0 and counts[9] == 2 and counts[7] == 5
    found = M.copies(sized)
    assert found.count() == d.count()
    mixed = M.mix(d)
    assert mixed.columns == d.columns
    n = collections.Counter(r["doc_id"] for r in mixed.collect())
    want = collections.Counter()
    for r in found.collect():
        want[r["doc_id"]] += r["copies"]
    assert n == +want
    single = d.where("doc_id in (0, 1, 2, 5, 6, 8)")
    want = collections.Counter({r["doc_id"]: r["copies"] for r in M.copies(single.select("doc_id", "source", M.word_count(F.col("text")).alias("size"))).collect()})
    assert collections.Counter(r["doc_id"] for r in M.mix(single).collect()) == +want
    assert M.mix(empty(spark)).count() == 0 and M.copies(empty(spark).select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count() == 0
