"""Document fingerprints from prefix polynomial hashes.

For each of three primes below 2^31, ``P[i]`` is the sum of ``c[j] * B^j`` over the
first i code points, modulo the prime. Two spans are equal, beyond 2^-90, if their
differences of prefixes, moved to a common power of B, are; so a span is compared in
constant time and the longest common extension of two positions found by binary
search. The fingerprint is the length and the last prefix of all three primes. The
likeness of two texts is the share of the longer one that their longest common
extensions from both ends cover.

Scale. A document meets the next one by id without a global sort of one task and
without joining texts: ids alone give range bounds, texts are dealt once by these
bounds, and the first document of each range is dealt to the range before it too.
Texts travel Zstandard-compressed, which keeps rows of the shuffle and its sort small.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import read_table, small_batches

#: Primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1000003, 1299709, 998244353)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64) for _ in PRIMES]


def powers(k: int, n: int) -> np.ndarray:
    """``BASES[k] ** (0 .. n-1)`` modulo the prime, kept and doubled as needed."""
    table, p = _POWERS[k], np.uint64(PRIMES[k])
    while len(table) < n:
        table = np.r_[table, table * np.uint64(pow(BASES[k], len(table), PRIMES[k])) % p]
    _POWERS[k] = table
    return table[:n]


class Prefixes:
    """Prefix arrays of one text; ``spliced`` builds those of a text made of two spans without its characters."""

    def __init__(self, text: str):
        self.text = text
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.sums = []
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            self.sums.append(np.r_[np.zeros(1, np.uint64), np.cumsum(c * powers(k, self.n) % p) % p].astype(np.uint32))

    @classmethod
    def spliced(cls, head: Prefixes, keep: int, tail: Prefixes, more: int) -> Prefixes:
        """The first ``keep`` characters of ``head`` and the first ``more`` of ``tail``."""
        out = cls.__new__(cls)
        out.text, out.n, out.sums = head.text[:keep] + tail.text[:more], keep + more, []
        for k, prime in enumerate(PRIMES):
            p, shift = np.uint64(prime), np.uint64(pow(BASES[k], keep, prime))
            moved = (tail.sums[k][1:more + 1].astype(np.uint64) * shift + head.sums[k][keep]) % p
            out.sums.append(np.r_[head.sums[k][:keep + 1], moved.astype(np.uint32)])
        return out

    def fingerprint(self) -> str:
        return f"{self.n:08x}" + "".join(f"{int(s[-1]):08x}" for s in self.sums)


def spans_equal(a: Prefixes, i: int, b: Prefixes, j: int, n: int) -> bool:
    """Whether ``a[i:i+n]`` equals ``b[j:j+n]``, by hash."""
    for k, p in enumerate(PRIMES):
        x = (int(a.sums[k][i + n]) - int(a.sums[k][i])) * pow(BASES[k], j, p)
        y = (int(b.sums[k][j + n]) - int(b.sums[k][j])) * pow(BASES[k], i, p)
        if (x - y) % p:
            return False
    return True


def extension(a: Prefixes, b: Prefixes, backwards: bool = False) -> int:
    """Length of the longest common beginning (or ending) of two texts, by binary search."""
    low, high = 0, min(a.n, b.n)
    while low < high:
        mid = (low + high + 1) // 2
        same = spans_equal(a, a.n - mid, b, b.n - mid, mid) if backwards else spans_equal(a, 0, b, 0, mid)
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def likeness(a: Prefixes, b: Prefixes) -> float:
    """Share of the longer text in the common beginning and ending; 1 for equal texts, two empty ones included."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    first = extension(a, b)
    last = min(extension(a, b, backwards=True), min(a.n, b.n) - first)
    return (first + last) / max(a.n, b.n)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, tail, id, hash); each row but a tail is compared with the next of its part."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, unpack = None, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        ids = batch.column(1)
        for part, doc_id, tail, text in zip(batch.column(0).to_pylist(), ids.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            now = Prefixes(unpack(text).decode("utf-8"))
            if held and held[0] == part:
                _, old_id, old = held
                half = old.n // 2
                edited = Prefixes.spliced(old, old.n - half, now, min(half, now.n))
                rows.append((old_id, old.n, hashlib.sha256(edited.text.encode("utf-8", "replace")).hexdigest(), old.fingerprint(),
                             edited.fingerprint(), likeness(old, edited), likeness(old, now)))
            held = None if tail else (part, doc_id, now)
        if rows:
            kinds[0] = ids.type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are ordered by id (null first), then by a hash of the text; rows equal
    in both follow each other in any order, which cannot be seen in the result. Null
    texts count as empty; a single row is its own next; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    code = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    lean = docs.select(F.col(id_col).alias("doc_id"), code.alias("code"), F.col(text_col).alias("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("code"))
    keys = lean.select(order.alias("k"))
    # The least key of each of a few ranges per shuffle partition; they are rows of the table.
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = keys.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).select("k.*").collect()
    bounds = sorted({(r["some"], r["id"], r["code"]) for r in firsts})
    sent = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf(StructType([StructField("place", IntegerType()), StructField("text", BinaryType())]))
    def placed(some: pd.Series, ids: pd.Series, codes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        """Twice the number of the range, plus one for a row that is the least of its range; and the packed text."""
        known, out, pack = sent.value, [], zstandard.ZstdCompressor(level=1).compress
        for k, text in zip(zip(some.tolist(), ids.tolist(), codes.tolist(), strict=True), texts, strict=True):
            at = bisect_right(known, k) - 1
            out.append((2 * at + (known[at] == k), pack(text)))
        return pd.DataFrame(out, columns=["place", "text"])

    place, n = F.col("p.place"), max(1, len(bounds))
    packed = placed("k.some", "k.id", "k.code", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    marked = lean.select("doc_id", "text", order.alias("k")).select("doc_id", "k", packed.alias("p"))
    own = F.struct(F.shiftright(place, 1).alias("part"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.shiftright(place, 1) - 1, F.lit(n)).alias("part"), F.lit(True).alias("tail"))
    dealt = marked.select("doc_id", F.col("p.text").alias("text"), "k", F.explode(F.when(place % 2 == 1, F.array(own, before)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("at.part", "doc_id", "at.tail", "text", "k").repartition("part").sortWithinPartitions("part", "tail", "k")
    schema = (f"doc_id {dict(lean.dtypes)['doc_id']}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return dealt.select("part", "doc_id", "tail", "text").mapInArrow(_compare, schema)


def op6_prefix_hashes(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and likenesses."""
    return fingerprints(read_table(spark, sf_dir, "documents"))
