"""Benchmark decontamination by winnowing.

Word k-grams are hashed and the smallest hash of every ``w`` consecutive k-grams is
kept (the last one on ties), in documents and in benchmark items alike. A shared
span of ``k + w - 1`` words shares all hashes of one such window, hence its kept
one: with k = 6 and w = 8 no shared span of 13 words is missed. Kept document
hashes are looked up among the kept item hashes, and each hit is extended word by
word along its diagonal as far as a shared window that holds it can reach, which also
discards hash collisions. Every window holds a hit, so the union is the whole shared
span. Equal surroundings of kept k-grams, of one item or of many, are extended once,
so runs of equal words and repeated phrases cost no more than what differs in them. An item of n < 13 words is one window; it is fingerprinted with
k = n, w = 1, which keeps every n-gram.

Scale. Documents are never shuffled: the items' index goes to the tasks. Its size is
checked: items are cut by hash into blocks of at most about ``block_bytes`` of text,
and beyond one block the documents are scanned once per block, each scan writing
only the documents that it hits. Words outside a block's vocabulary cannot be part
of a shared span, so k-grams with such a word are never kept.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh, read_table, small_batches, written

WINDOW = 13
K = 6
BLOCK_BYTES = 32 << 20
PLACES = 1 << 16
PAIRS = 1 << 16

#: Bytes that end a word become spaces, A-Z become a-z, all bytes of other code points stay.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                   for b in range(256))
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

HITS = StructType([StructField("n_words", LongType()), StructField("span_from", ArrayType(IntegerType())),
                   StructField("span_to", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram of word numbers; ``NEVER`` if it holds number 0 (an unknown word)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j:j + n]
        total = _mixed(total + part)
        known &= part != 0
    return np.where(known & (total != NEVER), total, np.where(known, np.uint64(0), NEVER))


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every ``w`` consecutive ones, the last on ties; never those of ``NEVER``."""
    if len(hashes) < w or not len(hashes):
        return np.empty(0, np.int64)
    if w == 1:
        kept = np.arange(len(hashes))
    else:
        views = np.lib.stride_tricks.sliding_window_view(hashes, w)
        kept = np.unique(np.arange(len(views)) + w - 1 - views[:, ::-1].argmin(axis=1))
    return kept[hashes[kept] != NEVER]


def _around(padded: np.ndarray, at: np.ndarray, k: int, length: int) -> np.ndarray:
    """Word numbers from ``length - k`` words before to ``length`` words after the start of each k-gram ``at``."""
    return padded[(at - (length - k))[:, None] + np.arange(2 * length - k)]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows, in order of their columns, and which of them each row equals."""
    order = np.lexsort(rows.T[::-1])
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    same = np.empty(len(rows), np.int64)
    same[order] = np.cumsum(new) - 1
    return order[new], same


class ItemIndex:
    """Kept fingerprints of one block of items, by window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K):
        self.names, self.vocabulary, self.window, self.shortest = [], {}, window, window
        gap = np.zeros(window, np.uint32)
        flat, start, by_length = [gap], window, {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words], np.uint64)
            length = min(window, len(words))
            self.shortest = min(self.shortest, length)
            hashes = gram_hashes(ids, self._k(length, window, k))
            at = winnow(hashes, length - self._k(length, window, k) + 1)
            by_length.setdefault(length, []).append((hashes[at], at + start, np.full(len(at), len(self.names))))
            self.names.append(name)
            flat += [ids.astype(np.uint32), gap]
            start += len(ids) + window
        #: The words of all items, each between as many zeros as a window has words.
        self.flat = np.concatenate(flat)
        self.tables = [self._table(length, self._k(length, window, k), *map(np.concatenate, zip(*parts, strict=True)))
                       for length, parts in sorted(by_length.items())]

    def _table(self, length: int, k: int, hashes: np.ndarray, places: np.ndarray, owner: np.ndarray):
        """Distinct surroundings in order of the hash: hash, place of one of them, and the items of all of them."""
        order = np.argsort(hashes, kind="stable")
        hashes, places, owner, low = hashes[order], places[order], owner[order], 0
        kept, pairs, n = [], [], 0
        while low < len(hashes):
            high = int(np.searchsorted(hashes, hashes[min(low + PLACES, len(hashes)) - 1], "right"))
            firsts, same = _distinct(np.column_stack([hashes[low:high], _around(self.flat, places[low:high], k, length)]))
            kept.append(low + firsts)
            pairs.append(np.unique(np.column_stack([same + n, owner[low:high]]), axis=0))
            low, n = high, n + len(firsts)
        kept, pairs = np.concatenate(kept), np.concatenate(pairs)
        return length, k, hashes[kept], places[kept], np.searchsorted(pairs[:, 0], np.arange(n + 1)), pairs[:, 1].copy()

    @staticmethod
    def _k(length: int, window: int, k: int) -> int:
        return k if length == window else length

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Disjoint sorted spans of hit words, and the items with occurring windows."""
        get = self.vocabulary.get
        ids = np.array([get(x, 0) for x in words], np.uint64)
        gaps = np.flatnonzero(ids == 0)
        if not len(ids) or np.diff(np.r_[-1, gaps, len(ids)]).max() - 1 < self.shortest:
            return [], []
        spans, found, padded = [], set(), np.pad(ids, self.window)
        for length, k, table, places, first, item in self.tables:
            hashes = gram_hashes(ids, k)
            kept = winnow(hashes, length - k + 1)
            kept = kept[table[np.minimum(np.searchsorted(table, hashes[kept]), len(table) - 1)] == hashes[kept]]
            used = np.zeros(len(table), bool)
            for at in (kept[j:j + PLACES] for j in range(0, len(kept), PLACES)):
                rows = np.column_stack([hashes[at], _around(padded, at + self.window, k, length)])
                own, same = _distinct(rows)
                before, after = self._extended(rows[own], table, places, length, k, used)
                ok = after[same] > 0
                spans.extend(zip((at - before[same])[ok].tolist(), (at + after[same])[ok].tolist(), strict=True))
            found.update(item[j] for e in np.flatnonzero(used).tolist() for j in range(first[e], first[e + 1]))
        merged: list[tuple[int, int]] = []
        for start, stop in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
            else:
                merged.append((start, stop))
        return merged, sorted({self.names[i] for i in found})

    def _extended(self, keys: np.ndarray, table: np.ndarray, places: np.ndarray, length: int, k: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words the longest shared span has before, and from the start of, each k-gram of ``keys`` (hash, surrounding
        words); 0 and 0 if none has ``length`` words. Marks entries ``used``; looks at ``PAIRS`` pairs at a time."""
        left, right = np.searchsorted(table, keys[:, 0], "left"), np.searchsorted(table, keys[:, 0], "right")
        before, after = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ends = np.cumsum(right - left)
        for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(low, min(low + PAIRS, int(ends[-1])))
            own = np.searchsorted(ends, pair, "right")
            entry = right[own] - (ends[own] - pair)
            words = keys[own, 1:]
            equal = (words == _around(self.flat, places[entry], k, length)) & (words != 0)
            back = np.logical_and.accumulate(equal[:, :length - k][:, ::-1], axis=1).sum(axis=1)
            ahead = np.logical_and.accumulate(equal[:, length - k:], axis=1).sum(axis=1)
            ok = (ahead >= k) & (back + ahead >= length)
            used[entry[ok]] = True
            np.maximum.at(before, own[ok], back[ok])
            np.maximum.at(after, own[ok], ahead[ok])
        return before, after


_BUILT: dict[str, ItemIndex] = {}


def _built(token: str, items: list[tuple[str, bytes]]) -> ItemIndex:
    """The index of ``items``, built once in a Python worker; only the last one is held."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = ItemIndex(items)
    return _BUILT[token]


def _hits_udf(spark, items: list[tuple[str, bytes]]):
    sent, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _BUILT.get(token) or _built(token, sent.value)
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text)
                spans, found = index.hits(words)
                rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], found))
            yield pd.DataFrame(rows, columns=HITS.names)

    return hits


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    rows = items.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield blocks, [(r["id"], bytes(r["text"])) for r in part.collect()]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES, out: str = "hits") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, disjoint spans ``[span_from, span_to)`` of hit words, items (ids as text).

    Null and empty texts have no words and no hits; null items are ignored, an item
    without id counts under the empty id; items of equal id count once; repeated
    documents each keep their row; other columns of ``docs`` pass through untouched.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col).cast("binary")
    blocks = _item_blocks(items, id_col, item_text, block_bytes)
    n, first = next(blocks)
    if n == 1:
        return docs.select("*", _hits_udf(spark, first)(text).alias(out))
    uid, b = fresh("uid_", [*docs.columns, out]), fresh("block_", [*docs.columns, out])
    marked = written(docs.select("*", F.monotonically_increasing_id().alias(uid)), "documents")
    parts = []
    for k, block in enumerate(_chain(first, blocks)):
        one = marked.select(uid, _hits_udf(spark, block)(text).alias(out))
        # The first scan keeps every document, for its words; later ones only what they hit.
        parts.append(written(one if not k else one.where(F.size(f"{out}.items") > 0), "hits"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(f"{out}.span_from", f"{out}.span_to"))))
    merged = every.groupBy(uid).agg(F.max(f"{out}.n_words").alias("n_words"), spans.alias("spans"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{out}.items")))).alias("items"))
    joined = merged.select(uid, "n_words", _merge_udf(F.col("spans.span_from"), F.col("spans.span_to")).alias("s"), "items").select(
        uid, F.struct("n_words", "s.span_from", "s.span_to", "items").alias(out))
    return marked.join(joined, uid).select(*docs.columns, out)


def _chain(first, blocks):
    yield first
    for _, rows in blocks:
        yield rows


@F.pandas_udf(StructType([StructField("span_from", ArrayType(IntegerType())), StructField("span_to", ArrayType(IntegerType()))]))
def _merge_udf(starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(starts, stops, strict=True):
        merged: list[list[int]] = []
        for start, stop in sorted(zip(a, b, strict=True)):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(stop, merged[-1][1])
            else:
                merged.append([start, stop])
        rows.append(([x for x, _ in merged], [y for _, y in merged]))
    return pd.DataFrame(rows, columns=["span_from", "span_to"])


def digest(hits: DataFrame, out: str = "hits") -> DataFrame:
    """The hit counts and the contamination rule (5 % of the words or more) from ``contamination``'s struct."""
    n_hit = F.aggregate(F.zip_with(f"{out}.span_from", f"{out}.span_to", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"),
                        lambda a, b: a + b)
    return hits.select("*", F.col(f"{out}.n_words").alias("n_words"), n_hit.alias("n_hit"),
                       F.size(f"{out}.items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort(f"{out}.items"), ",").cast("binary"), 256).alias("items_sha256"),
                       ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with the same columns."""
    out = fresh("hits", docs.columns)
    found = contamination(docs, items, out=out)
    spans = F.aggregate(F.zip_with(f"{out}.span_from", f"{out}.span_to", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"),
                        lambda a, b: a + b)
    clean = (spans == 0) | (spans * 20 < F.col(f"{out}.n_words"))
    return found.where(clean).select(*docs.columns)


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = digest(contamination(docs, read_table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
hit AS (SELECT doc_id, item_id, k, p FROM dw JOIN iw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
