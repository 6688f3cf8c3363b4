import base64
import hashlib
import struct

import numpy as np
import pytest
from pyarrow.fs import FileSystem

from emberline.llm import separator_scan as T
from emberline.llm import warc_dictionary as W
from emberline.llm.common import shared_path

from .cases import docs, empty

PAGES = "page_id long, url string, html string, payload string"


def pages(spark, n=60):
    rows = [(i, f"http://x/{i}", f"<html>{'body ' * (i % 9)}{i if i % 4 else 'same'}</html>", "clash") for i in range(10, 10 + n)]
    return spark.createDataFrame([*rows, (1, None, None, None), (2, "http://e\r\nX: 1", "", None), (3, "u", "é" * 200_000, None), (None, "u", "no id", None),
                                  (5, "u", "twin", None), (5, "u", "twin", None), (6, "u", "twin", None)], PAGES).coalesce(2)


@pytest.mark.parametrize("least", [0, 40])
def test_round_trip(spark, least):
    p = pages(spark)
    archives = W.write_archives(p, min_bytes=least, archive_bytes=4000)
    assert archives.count() > 2
    found = sorted(tuple(r)[:5] for r in W.read_archives(archives).na.fill("").collect())
    first, want = {}, []
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in p.collect()]
    for i, h in rows:
        first[h] = min(first.get(h, 1 << 60), 1 << 60 if i is None else i)
    for i, h in rows:
        revisit = len(h) >= least and first[h] not in (i, 1 << 60)
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        want.append(("" if i is None else str(i), len(h), digest, "revisit" if revisit else "response", str(first[h]) if revisit else ""))
    assert found == sorted(want)


def test_dictionary_leads_the_archive(spark):
    path = W.write_archives(pages(spark, 400).coalesce(1)).first()["path"]
    system, name = FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        magic, size = struct.unpack("<II", f.read(8))
        body = f.read()
    assert magic == W.DICTIONARY_MAGIC and 0 < size < len(body) and body[size:size + 4] == b"\x28\xb5\x2f\xfd"
    assert sum(1 for _ in W.read_archive(path)) == 407


def test_small_archives_have_a_dictionary_too(spark):
    few = spark.createDataFrame([("a b", "u", "x"), ("c\r\nWARC-Type: revisit", "u", "y" * 50), ("<é>", "u", "x")], "page_id string, url string, html string")
    archives = W.write_archives(few.coalesce(1))
    system, name = FileSystem.from_uri(archives.first()["path"])
    with system.open_input_stream(name) as f:
        magic, size = struct.unpack("<II", f.read(8))
    assert magic == W.DICTIONARY_MAGIC and size > 0
    found = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in W.read_archives(archives).collect())
    assert found == sorted([("a b", 1, "revisit", "<é>"), ("c\r\nWARC-Type: revisit", 50, "response", None), ("<é>", 1, "response", None)], key=lambda r: r[0])


def test_empty_pages(spark):
    assert W.read_archives(W.write_archives(pages(spark).limit(0))).count() == 0


def test_damage_is_found(spark):
    path = W.write_archives(pages(spark).coalesce(1)).first()["path"]
    system, name = FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        data = f.read()
    with system.open_output_stream(name) as f:
        f.write(data[:-3])
    with pytest.raises(ValueError):
        list(W.read_archive(path))


def test_token_counts(spark):
    d = docs(spark)
    encode = T.encoding(T.TOKENIZER).encode_ordinary
    want = sorted((str(r["doc_id"]), len(encode(r["text"] or ""))) for r in d.collect())
    got = T.token_counts(d, file_tokens=200).select("doc_id", "n_tokens").collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert T.token_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_documents_span_blocks(spark, block):
    rng = np.random.default_rng(block)
    folder, files = shared_path(spark, "tokens"), {}
    for k in range(6):
        tokens = rng.integers(0, 4, (0, 1, 10, 50, 200, 201)[k]).astype("<u2")   # 3 ends a document
        system, name = FileSystem.from_uri(f"{folder}/{k}")
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as f:
            f.write(tokens.tobytes())
        files[f"{folder}/{k}"] = tokens.tolist()
    want = []
    for path, tokens in files.items():
        start = n = 0
        for i, t in enumerate([*tokens, 3] if tokens and tokens[-1] != 3 else tokens):
            if t == 3:
                want.append((path, n, start, i - start))
                start, n = i + 1, n + 1
    got = T.scan(spark.createDataFrame([(p,) for p in files], "file string"), eod=3, block_tokens=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_runs_encode_as_in_the_whole_text():
    encoder = T.encoding(T.TOKENIZER)
    for mark in (" ", "\n", " ", " \t", "a", "!", "é"):
        for text in (f"{mark * 20_000}", f"x{mark * 20_000}y z", f"{mark * 20_000}.{mark * 15_000}", f"a {mark * 12_000} b"):
            assert T.encode(encoder, text) == encoder.encode_ordinary(text), (mark, text[:3])


def test_runs_of_millions(spark):
    marks = [" ", "a", "!"]
    rows = [(k, mark * n + end) for k, (mark, n, end) in enumerate((m, n, e) for m in marks for n in (1_000_000, 5_000_000) for e in ("", "b c"))]
    found = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    encoder = T.encoding(T.TOKENIZER)
    per = {m: len(encoder.encode_ordinary(m * 1000)) / 1000 for m in marks}
    for k, text in rows:
        n = len(text.removesuffix("b c"))
        assert abs(found[k] - per[text[0]] * n) <= 4, (k, found[k])
