"""Fill-in-middle over seekable compressed frames.

A text is stored as independent Zstandard frames of ``frame_units`` code points, each
with the number of units before it. A document is cut in three at two points that come
from a hash of its id and put together again with sentinels: prefix, suffix, middle
(``psm``) or suffix, prefix, middle (``spm``). Only the frames that a cut falls into are
decompressed, sliced and compressed again; all others go into the output as they are
stored, so an output is itself a seekable list of frames. Digests and the search for
sentinels stream the frames in order: one frame of a text is decompressed at a time.

Scale. Rows are independent: no shuffle, no join. The cuts are built-in expressions.
A very long document costs its compressed bytes and one frame.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, small_batches, written

FRAME_UNITS = 1 << 16
LEVEL = 3
#: Of 100 documents so many are cut; of 100 that are cut so many have the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

FRAMES = "array<struct<first: long, units: long, data: binary>>"
_FRAMES = pa.list_(pa.struct([("first", pa.int64()), ("units", pa.int64()), ("data", pa.binary())]))
#: Order of the parts by form.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


class Frames:
    """Independent frames of one text, in order, with the number of units before each."""

    def __init__(self, frames: list[dict] | None = None, level: int = LEVEL):
        self.rows = list(frames or [])
        self.level = level

    @property
    def units(self) -> int:
        return self.rows[-1]["first"] + self.rows[-1]["units"] if self.rows else 0

    def put(self, units: int, data: bytes) -> None:
        """A frame that is already compressed."""
        self.rows.append({"first": self.units, "units": units, "data": data})

    def write(self, text: str, frame_units: int = FRAME_UNITS) -> None:
        press = zstandard.ZstdCompressor(level=self.level)
        for at in range(0, len(text), frame_units):
            part = text[at:at + frame_units]
            self.put(len(part), press.compress(part.encode("utf-8")))

    def texts(self) -> Iterator[str]:
        for row in self.rows:
            yield _text(row)

    def copy(self, other: Frames, start: int, stop: int) -> None:
        """Append units ``start`` to ``stop`` of another text; frames within are taken over compressed, cut ones are sliced."""
        firsts = [r["first"] for r in other.rows]
        k = max(0, bisect_right(firsts, start) - 1)
        while start < stop:
            row = other.rows[k]
            end = min(stop, row["first"] + row["units"])
            if end - start == row["units"]:
                self.put(row["units"], row["data"])
            else:
                self.write(_text(row)[start - row["first"]:end - row["first"]])
            start, k = end, k + 1

    def find(self, mark: str, start: int) -> int:
        """Unit at which ``mark`` first occurs at or after ``start``; frame borders do not matter. -1 if it does not occur."""
        held, at = "", start
        for row in self.rows[max(0, bisect_right([r["first"] for r in self.rows], start) - 1):]:
            held += _text(row)[max(0, start - row["first"]):]
            here = held.find(mark)
            if here >= 0:
                return at + here
            keep = min(len(held), len(mark) - 1)
            at, held = at + len(held) - keep, held[len(held) - keep:]
        return -1

    def sha256(self) -> str:
        code = hashlib.sha256()
        reader = zstandard.ZstdDecompressor()
        for row in self.rows:
            code.update(reader.decompress(row["data"]))
        return code.hexdigest()


def _text(row: dict) -> str:
    return zstandard.ZstdDecompressor().decompress(row["data"]).decode("utf-8")


def assemble(text: Frames, form: str, first: int, second: int) -> Frames:
    """The output for the cuts ``first <= second``; plain is the text itself."""
    if form == "plain":
        return text
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, text.units)}
    out = Frames()
    for mark in ORDER[form]:
        out.write(mark)
        out.copy(text, *spans[mark])
    return out


def restore(output: Frames, form: str) -> Frames:
    """The text, from an output and its form alone."""
    if form == "plain":
        return output
    at, start = {}, 0
    for mark in ORDER[form]:
        at[mark] = output.find(mark, start)
        if at[mark] < start:
            raise ValueError(f"no {mark} in an output of form {form}")
        start = at[mark] + len(mark)
    ends = dict(zip(ORDER[form], [*[at[m] for m in ORDER[form][1:]], output.units], strict=True))
    text = Frames()
    for mark in (PREFIX, MIDDLE, SUFFIX):
        text.copy(output, at[mark] + len(mark), ends[mark])
    return text


def _store(frame_units: int, level: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, frames = [], []
            for text in batch.column(1).to_pylist():
                f = Frames(level=level)
                f.write(text or "", frame_units)
                units.append(f.units)
                frames.append(f.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.int64()), batch.column(2), pa.array(frames, _FRAMES)],
                                             ["doc_id", "n", "marked", "frames"])

    return rows


def store(docs: DataFrame, frame_units: int = FRAME_UNITS, level: int = LEVEL) -> DataFrame:
    """``docs(doc_id, text)`` as frames, written to the shared folder: doc_id, n (code points), marked (a sentinel occurs), frames.

    Null texts are empty, and empty texts have no frames. Ids may be null or repeated: every
    row is stored. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    lean = docs.select("doc_id", text.alias("text"), marked.alias("marked"))
    schema = f"doc_id {dict(lean.dtypes)['doc_id']}, n long, marked boolean, frames {FRAMES}"
    return written(lean.mapInArrow(_store(frame_units, level), schema), "frames")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned numbers of 32 bits: the first groups of eight digits of the SHA-256 of ``seed:doc_id`` (a null id is empty)."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(code, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def cuts(stored: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``stored`` with form and the units before the first and the second cut."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= cut_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    return stored.withColumns({"form": form, "cut1": F.least(a, b), "cut2": F.greatest(a, b)})


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        outputs = [assemble(Frames(frames), form, a, b).rows
                   for form, a, b, frames in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(outputs, _FRAMES)], [*batch.schema.names[:5], "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, frame_units: int = FRAME_UNITS, **rates) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output (a list of frames).

    ``texts`` and ``digests`` read outputs. Null and empty texts are plain and have an empty
    output; texts that hold a sentinel are plain; a null id draws like an empty one; equal rows
    give equal rows; very long texts are cut like any other; other columns are not read.
    """
    rows = cuts(store(docs, frame_units), seed, **rates)
    lean = rows.select("doc_id", "n", "form", "cut1", "cut2", "frames")
    schema = f"doc_id {dict(lean.dtypes)['doc_id']}, n long, form string, cut1 long, cut2 long, output {FRAMES}"
    cut = F.col("form") != "plain"
    return lean.mapInArrow(_assemble, schema).select("doc_id", "n", "form", F.when(cut, F.col("cut1")).alias("prefix_chars"),
                                                     F.when(cut, F.col("cut2") - F.col("cut1")).alias("middle_chars"), "output")


def _read(outputs: DataFrame, column: str, of, kind: pa.DataType) -> DataFrame:
    """``outputs`` with ``output`` replaced by what ``of(form, frames)`` gives."""
    rest = [c for c in outputs.columns if c != "output"]
    lean = outputs.select("form", "output", *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(form, Frames(frames)) for form, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(found, kind)], [*batch.schema.names[2:], "found"])

    types = dict(lean.dtypes)
    shape = "struct<output_sha256: string, restored_sha256: string>" if pa.types.is_struct(kind) else "string"
    schema = ", ".join([*[f"c{i} {types[f'c{i}']}" for i in range(len(rest))], f"found {shape}"])
    return lean.mapInArrow(rows, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("found").alias(column))


def texts(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the output as text."""
    return _read(outputs, "output", lambda form, frames: "".join(frames.texts()), pa.string())


def digests(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the SHA-256 of the output and of the text restored from it and its form."""
    kind = pa.struct([("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    found = _read(outputs, "digest", lambda form, frames: {"output_sha256": frames.sha256(), "restored_sha256": restore(frames, form).sha256()}, kind)
    return found.select(*[c for c in outputs.columns if c != "output"], "digest.output_sha256", "digest.restored_sha256")


def op12_seekable_fim(spark, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, with digests of the output and of the text restored from it."""
    return digests(fill_in_middle(read_table(spark, sf_dir, "documents")))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT_PERCENT} THEN 'plain'
             WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM e),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM c),
m AS (SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, p + 3, s - p - 3) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
    ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, s + 3, p - s - 3) END) AS restored_sha256
FROM m
"""
