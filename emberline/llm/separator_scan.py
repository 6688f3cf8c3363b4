"""Token counts by a separator scan over flat token files.

A flat token file is little-endian token numbers, documents one after the other,
each ended by the end-of-document number, without any index. Files are cut into
blocks of equal length that any task can read. A block is searched for separators
in one vectorised comparison; how many separators lie before a block and where the
last of them is come from a prefix scan over one row per block, which numbers the
documents and stitches those that span blocks.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, shared_path, small_batches, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256
DTYPE = "<u2"
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 25
#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{10000,}}")
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The byte-level tokenizer of a rank file, loaded once a process."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        system, name = FileSystem.from_uri(path)
        with system.open_input_stream(name) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encode(encoder, text: str) -> list[int]:
    """Token numbers of a text, the same as ``encode_ordinary`` gives.

    The tokenizer's pattern backtracks over runs of white space, and its stack does not hold
    the longest. A run starts a piece, which is the run without its last character if
    anything follows; so a long one is cut out there and encoded as the one piece that it is.
    """
    out, start = [], 0
    for run in LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[start:run.start()])
        out += encoder._core_bpe.encode_single_piece(text[run.start():stop].encode("utf-8"))
        start = stop
    return out + encoder.encode_ordinary(text[start:]) if start else encoder.encode_ordinary(text)


def _write_tokens(folder: str, tokenizer: str, eod: int, dtype: str, file_tokens: int):
    """Rows (file, ordinal, doc_id) of the flat files that a task writes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(tokenizer)
        path, out, size, ordinal = None, None, 0, 0
        for batch in batches:
            files, ordinals = [], []
            for text in batch.column(1).to_pylist():
                if out is None:
                    path, size, ordinal = f"{folder}/{uuid.uuid4().hex}.tokens", 0, 0
                    system, name = FileSystem.from_uri(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name)
                tokens = np.array([*encode(encoder, text or ""), eod], dtype)
                out.write(tokens.tobytes())
                files.append(path)
                ordinals.append(ordinal)
                size, ordinal = size + len(tokens), ordinal + 1
                if size >= file_tokens:
                    out.close()
                    out = None
            if files:
                yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(ordinals, pa.int64()), batch.column(0)], ["file", "ordinal", "doc_id"])
        if out:
            out.close()

    return rows


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, eod: int = EOD, dtype: str = DTYPE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` into flat files in the shared folder; rows ``(file, ordinal, doc_id)`` in file order.

    Null texts are documents without tokens. Files of lost attempts are not in the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lean = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"file string, ordinal long, doc_id {dict(lean.dtypes)['doc_id']}"
    return written(lean.mapInArrow(_write_tokens(shared_path(spark, "tokens"), tokenizer, eod, dtype, file_tokens), schema), "written")


def _blocks(dtype: str, block_tokens: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = FileSystem.from_uri(path)
                tokens, odd = divmod(system.get_file_info(name).size, width)
                if odd:
                    raise ValueError(f"{path} ends inside a token")
                n = math.ceil(tokens / block_tokens)
                first = np.arange(n, dtype=np.int64) * block_tokens
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(first), pa.array(np.minimum(block_tokens, tokens - first)),
                                                  pa.array(np.full(n, tokens, np.int64))], ["file", "first", "tokens", "file_tokens"])

    return rows


def _scan(dtype: str, eod: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for path, first, tokens, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    found = np.frombuffer(f.read_at(tokens * width, first * width), dtype)
                ends = np.flatnonzero(found == eod).astype(np.int64) + first
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first]), pa.array([tokens]), pa.array([total]), pa.array([ends])],
                                                 ["file", "first", "tokens", "file_tokens", "ends"])

    return rows


def scan(files: DataFrame, eod: int = EOD, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of flat token files ``files(file)``: file, ordinal, start (token offset), n_tokens without the separator.

    Tokens after the last separator are a document of their own if there are any; an empty file has no documents.
    """
    spark = files.sparkSession
    listed = files.select("file").distinct()
    blocks = written(listed.mapInArrow(_blocks(dtype, block_tokens), "file string, first long, tokens long, file_tokens long"), "blocks")
    n = max(1, min(blocks.count(), 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = written(blocks.repartition(n, "file", "first").mapInArrow(_scan(dtype, eod), "file string, first long, tokens long, file_tokens long, ends array<long>"), "ends")
    # The prefix scan: one row per block, in file order.
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    lean = found.select("file", "first", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"), "tokens", "file_tokens")
    scanned = lean.select(F.col("file").alias("scan_file"), F.col("first").alias("scan_first"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                          F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("carry"))
    joined = found.join(scanned, (F.col("file") == F.col("scan_file")) & (F.col("first") == F.col("scan_first")))
    here = F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("carry"))
    rest = (F.col("first") + F.col("tokens") == F.col("file_tokens")) & (here < F.col("file_tokens"))
    closed = F.when(rest, F.concat("ends", F.array("file_tokens"))).otherwise(F.col("ends"))
    starts = F.concat(F.array("carry"), F.transform("ends", lambda e: e + 1))
    docs = joined.select("file", "before", F.posexplode(F.arrays_zip(closed.alias("stop"), F.slice(starts, 1, F.size(closed)).alias("start"))).alias("k", "d"))
    return docs.select("file", (F.col("before") + F.col("k")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))


def token_counts(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, file, start. Null and empty texts have 0 tokens; other columns are not read."""
    ids = write_token_files(docs, **settings)
    found = scan(ids).withColumnsRenamed({"file": "scan_file", "ordinal": "scan_ordinal"})
    return ids.join(found, (F.col("file") == F.col("scan_file")) & (F.col("ordinal") == F.col("scan_ordinal"))).select("doc_id", "n_tokens", "file", "start")


def op5_separator_scan(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")
