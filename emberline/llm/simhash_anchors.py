"""SimHash near-duplicate detection by anchor-point covering.

Fingerprints of 64 bits link at Hamming distance ``max_bits`` (4) or less. Two
linked fingerprints differ in at most ``max_bits // 2`` bits in one of their
32-bit halves, so each half is one *view* with threshold 2. The anchors of a view
are the codewords of the covering code

    Golay(23,12,7) + Hamming(7,4,3) + all words of 2 bits

with 2^18 words and covering radius 3 + 1 + 0 = 4. Every fingerprint has a *home*:
the codeword its half decodes to, at distance 4 or less. It is also replicated to
every codeword within radius plus threshold (4 + 2 = 6) of its half. If the halves
of x and y differ in 2 bits or fewer, y is replicated to the home of x, so
comparing homes with replicas per anchor finds every link.

Scale. Copies share a fingerprint and are folded before anything is replicated,
so a group of copies is one row. Only (anchor, fingerprint) pairs are shuffled,
about 140 per distinct fingerprint. Anchors with more than ``home_block`` homes
are dealt over several salts: homes go to one salt, replicas to all, so no task
holds more than about ``home_block`` homes and replicas are streamed past them. A
task emits a spanning forest of the links it sees, never the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, fresh, has_unique_ids, small_batches, written

SHINGLE = 4
SEED = 42
MAX_BITS = 4

# Generator polynomial of the binary Golay code (x^11+x^10+x^6+x^5+x^4+x^2+1)
# and of the Hamming code of length 7 (x^3+x+1).
GOLAY_POLYNOMIAL = 0b110001110101
HAMMING_POLYNOMIAL = 0b1011
# Layout of a half: bits 0-22 Golay, bits 23-29 Hamming, bits 30-31 free.
GOLAY_BITS, HAMMING_BITS = 23, 7
RADIUS = 4


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 hashes of the word shingles of ``text``; 0 for a text without words.

    ``bytes.lower`` maps A-Z alone and ``bytes.split`` cuts at the six ASCII white
    space characters, which is the contract's word rule on UTF-8.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in
                       zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at:at + 65536]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def _syndromes(words: np.ndarray, polynomial: int, length: int) -> np.ndarray:
    """Remainders of GF(2) polynomials of ``length`` bits by a generator polynomial."""
    degree = polynomial.bit_length() - 1
    rest = words.astype(np.uint32).copy()
    for bit in range(length - 1, degree - 1, -1):
        rest ^= np.where((rest >> np.uint32(bit)) & 1, np.uint32(polynomial << (bit - degree)), np.uint32(0)).astype(np.uint32)
    return rest


def _patterns(polynomial: int, length: int, weight: int) -> list[list[list[int]]]:
    """``[syndrome][w]`` = error patterns of weight w (up to ``weight``) with that syndrome."""
    from itertools import combinations

    degree = polynomial.bit_length() - 1
    table: list[list[list[int]]] = [[[] for _ in range(weight + 1)] for _ in range(1 << degree)]
    for w in range(weight + 1):
        masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(length), w)], np.uint32)
        for s, e in zip(_syndromes(masks, polynomial, length).tolist(), masks.tolist(), strict=True):
            table[s][w].append(e)
    return table


class Anchors:
    """Homes and replicas of 32-bit halves in the covering code."""

    def __init__(self, threshold: int = MAX_BITS // 2):
        reach = RADIUS + threshold
        self.golay = _patterns(GOLAY_POLYNOMIAL, GOLAY_BITS, min(reach, GOLAY_BITS))
        self.hamming = _patterns(HAMMING_POLYNOMIAL, HAMMING_BITS, min(reach, HAMMING_BITS))
        self.reach = reach
        self.cache: dict[int, np.ndarray] = {}

    def syndrome(self, halves: np.ndarray) -> np.ndarray:
        low = halves & np.uint32((1 << GOLAY_BITS) - 1)
        mid = (halves >> np.uint32(GOLAY_BITS)) & np.uint32((1 << HAMMING_BITS) - 1)
        return (_syndromes(low, GOLAY_POLYNOMIAL, GOLAY_BITS) << np.uint32(3)) | _syndromes(mid, HAMMING_POLYNOMIAL, HAMMING_BITS)

    def errors(self, syndrome: int) -> np.ndarray:
        """Error patterns up to ``reach`` bits leading to codewords; the first is the home's."""
        if syndrome not in self.cache:
            found = []
            for wg, golay in enumerate(self.golay[syndrome >> 3]):
                for wh, hamming in enumerate(self.hamming[syndrome & 7]):
                    for free, wf in ((0, 0), (1, 1), (2, 1), (3, 2)):
                        if wg + wh + wf <= self.reach:
                            found += [(wg + wh + wf, g | h << GOLAY_BITS | free << 30) for g in golay for h in hamming]
            self.cache[syndrome] = np.array([e for _, e in sorted(found)], np.uint32)
        return self.cache[syndrome]

    def homes(self, halves: np.ndarray) -> np.ndarray:
        return halves ^ np.array([self.errors(s)[0] for s in self.syndrome(halves).tolist()], np.uint32)


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.view(np.uint64)
    return (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32)


def _keys(view: int, codewords: np.ndarray) -> np.ndarray:
    return codewords.astype(np.int64) | np.int64(view) << np.int64(32)


def _home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for view, half in enumerate(_halves(fps)):
            yield pa.RecordBatch.from_arrays([pa.array(_keys(view, anchors.homes(half)))], ["anchor"])


def _replicate(salts: dict[int, int]):
    """Rows (anchor, salt, replica, fp): each home once, and every replica in each salt of its anchor."""
    hot = np.array(sorted(salts), np.int64)
    parts = np.array([salts[k] for k in hot.tolist()], np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        names = ["anchor", "salt", "replica", "fp"]
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 2000):
                fps = every[at:at + 2000]
                out: list[tuple[np.ndarray, ...]] = []
                for view, half in enumerate(_halves(fps)):
                    errors = [anchors.errors(s) for s in anchors.syndrome(half).tolist()]
                    home = _keys(view, half ^ np.array([e[0] for e in errors], np.uint32))
                    count = np.fromiter(map(len, errors), np.int64, len(errors))
                    key = _keys(view, np.repeat(half, count) ^ np.concatenate(errors))
                    fp = np.repeat(fps, count)
                    n, m = _salt_counts(home, hot, parts), _salt_counts(key, hot, parts)
                    out.append((home, (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n,
                                np.zeros(len(home), bool), fps))
                    if len(hot):
                        first = np.cumsum(m) - m
                        salt = np.arange(m.sum()) - np.repeat(first, m)
                        key, fp = np.repeat(key, m), np.repeat(fp, m)
                    else:
                        salt = np.zeros(len(key), np.int64)
                    out.append((key, salt, np.ones(len(key), bool), fp))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3])], names)

    return rows


def _salt_counts(keys: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return np.where(hot[at] == keys, parts[at], 1)


class _Forest:
    """Links seen by a task, folded to a spanning forest whenever ``bound`` links have gathered."""

    def __init__(self, bound: int = 200_000):
        self.bound, self.parent = bound, {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def flush(self) -> pa.RecordBatch:
        nodes = list(self.parent)
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(x) for x in nodes], pa.int64())], ["a", "b"])
        self.parent = {}
        return out


def _compare(max_bits: int, cells: int = 1 << 21):
    """Compare the homes of each (anchor, salt) with its replicas; rows come sorted, homes first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        key, homes = None, np.empty(0, np.uint64)
        for batch in batches:
            anchor, salt, replica, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(fp):
                continue
            group = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])
            stops = np.r_[group[1:], len(fp)]
            bits = fp.view(np.uint64)
            cuts = np.cumsum(np.r_[0, ~replica])
            for start, stop in zip(group.tolist(), stops.tolist(), strict=True):
                if (this := (anchor[start], salt[start])) != key:
                    key, homes = this, bits[:0]
                own = int(cuts[stop] - cuts[start])
                if own:
                    homes = np.r_[homes, bits[start:start + own]]
                rest = bits[start + own:stop]
                if not len(homes) or not len(rest):
                    continue
                step = max(1, cells // len(homes))
                for at in range(0, len(rest), step):
                    part = rest[at:at + step]
                    near = np.bitwise_count(homes[:, None] ^ part[None, :]) <= max_bits
                    h, r = np.nonzero(near & (homes[:, None] != part[None, :]))
                    if len(h):
                        first = near.argmax(axis=0)
                        # A replica links to its first home; homes with a replica in common link to each other.
                        links = np.unique(np.c_[np.r_[homes[first[r]], homes[h]], np.r_[part[r], homes[first[r]]]], axis=0)
                        for a, b in links[links[:, 0] != links[:, 1]].view(np.int64).tolist():
                            forest.link(a, b)
                        if len(forest.parent) > forest.bound:
                            yield forest.flush()
        if forest.parent:
            yield forest.flush()

    return rows


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, home_block: int = 2048, salt_limit: int = 200_000) -> DataFrame:
    """Links ``(a, b)`` spanning the components of the distinct fingerprints ``fps(fp)`` at ``max_bits`` or fewer."""
    if max_bits // 2 != MAX_BITS // 2:
        raise ValueError("the anchors are built for thresholds of 4 or 5 bits")
    homes = fps.mapInArrow(_home_rows, "anchor long").groupBy("anchor").count().where(F.col("count") > home_block)
    hot = homes.select("anchor", F.ceil(F.col("count") / home_block).cast("int").alias("parts"))
    # At most two anchors in home_block fingerprints are hot. A list longer than salt_limit is not sent to the
    # tasks: the block is doubled instead, which halves the list and costs memory for that many more homes.
    while len(listed := hot.limit(salt_limit + 1).collect()) > salt_limit:
        home_block *= 2
        hot = hot.where(F.col("parts") > 1).select("anchor", F.ceil(F.col("parts") / 2).cast("int").alias("parts"))
    salts = {r["anchor"]: r["parts"] for r in listed if r["parts"] > 1}
    rows = fps.mapInArrow(_replicate(salts), "anchor long, salt int, replica boolean, fp long")
    dealt = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "replica")
    return dealt.mapInArrow(_compare(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, fp long, component_id)``.

    ``component_id`` is the smallest id reachable over links of ``max_bits`` or
    fewer, null if no document of the component has an id. Null and word-free texts
    have fingerprint 0 and link like any other; repeated rows each give a row; other
    columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    marked = written(docs.select(F.col(id_col), fingerprint_udf(F.col(text_col).cast("binary")).alias("fp")), "fingerprints")
    return marked.join(fingerprint_components(marked, id_col, max_bits), "fp").select(id_col, "fp", "component_id")


def fingerprint_components(marked: DataFrame, id_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, component_id)`` of every distinct fingerprint of ``marked(id_col, fp, ...)``."""
    spark = marked.sparkSession
    distinct = written(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    spread = max(spark.sparkContext.defaultParallelism, math.ceil(distinct.count() / 50_000))
    roots = components(fingerprint_links(distinct.select("fp").repartition(spread), max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return written(rooted.join(least, "root").select("fp", "component_id"), "components")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component kept: the smallest id (null last; ties by row order), same columns.

    Ids and fingerprints alone are written and compared; the dropped ids are taken
    out of ``docs``. Where ids are null or repeated, rows get a number of their own first.
    """
    small_batches(docs.sparkSession)
    code = fingerprint_udf(F.col(text_col).cast("binary"))
    rows, uid = docs, id_col
    lean = written(docs.select(F.col(id_col).alias("id"), code.alias("fp")), "fingerprints")
    if not has_unique_ids(lean, "id"):
        uid = fresh("uid_", docs.columns)
        rows = written(docs.select("*", F.monotonically_increasing_id().alias(uid)), "numbered")
        lean = written(rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(uid).alias("uid")).alias("id"),
                                   code.alias("fp")), "fingerprints")
    found = fingerprint_components(lean, "id", max_bits)
    dropped = lean.join(found, "fp").where(F.col("id") != F.col("component_id"))
    out = written(dropped.select((F.col("id") if uid == id_col else F.col("id.uid")).alias("dropped_")), "dropped")
    return rows.join(out, F.col(uid) == F.col("dropped_"), "left_anti").select(*docs.columns)


def op3_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    """Component of every document under 4 differing SimHash bits."""
    from .common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
