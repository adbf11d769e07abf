"""Token files against the tokenizers library on whole texts, and blocks by exact round trips."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import queries, token_files
from skyweave.storage import fresh_folder

DATA = "/root/testdata/sf0.001"
PATH = queries.vocabulary("word_bpe_49k.json")


def brute(rows):
    """(doc_id, start, n_tokens, ids_crc32) in file order, by the library on whole texts."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, rows, **more):
    folder = fresh_folder(spark, "test")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("start", F.lit("x"))
    token_files.write(frame, folder, PATH, **more)
    return folder, [tuple(r) for r in token_files.digests(spark, folder).collect()]


def test_query(spark):
    got = sorted(tuple(r) for r in queries.op11_token_files(spark, DATA).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in queries.documents(spark, DATA).collect()])


ODD = ["", None, " ", "á b", " ́x", "don't  STOP now here\x1cthere\x85end", "<|endoftext|>x<|startoftext|> <|endoftext|", "ΑΣ ΣΑΣ İI", "1234567 ½ ²", "각 각", "日本語 テキスト\n\n\tتجربة", "\x00\x01 ​﻿", "ẹ́", "x" * 5000, "́" * 300 + " y", "🙂👨‍👩‍👧 ok's 'S 'll", 'Straße, ÉTÉ! ("naïve") (été):;" ((a)) "O\'Neil" ÷ a÷b ×É ß ẞ ÿŸ word\u0301 word.\u0338 (\u0301x "\u0338y']


def test_odd_texts_nulls_and_repeats(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "á b")]
    _, got = run(spark, rows)
    key = lambda r: r[1]
    want = brute(rows)
    assert [r[0] for r in sorted(got, key=key)] == [r[0] for r in want]
    assert sorted(got, key=key) == want


def test_long_text_is_encoded_by_pieces(spark):
    long = "Some Words, and more\nof them's " * 150_000
    assert len(long) > token_files.PORTION
    rows = [(5, "first"), (9, long), (7, long[:100])]
    _, got = run(spark, rows)
    assert sorted(got) == sorted(brute(rows))


def test_many_files_and_ranges_of_ids(spark):
    rows = [(k, f"word{k} " * (k % 40)) for k in range(300)]
    folder, got = run(spark, rows, file_ids=500)
    assert sorted(got) == sorted(brute(rows)) and token_files.files(spark, folder).count() > 10
    content = bytes(token_files.files(spark, folder).orderBy(F.col("length").desc()).first()["content"])
    own = token_files.TokenFile(content)
    every = own.ids(0, own.n_ids)
    for a, z in [(0, 1), (127, 129), (128, 256), (own.n_ids - 1, own.n_ids), (3, 3), (5, 300)]:
        assert own.ids(a, z).tolist() == every[a:z].tolist()
    with pytest.raises(ValueError, match="not the bytes"):
        token_files.TokenFile(content[:200] + bytes([content[200] ^ 1]) + content[201:])


def test_empty_table(spark):
    assert run(spark, [])[1] == []


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 32])
def test_blocks_give_back_their_ids(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 127, 128, 129, 5000):
        x = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        x[rng.random(n) < 0.05] = 2**32 - 1  # outliers
        index, body = token_files.pack(x)
        assert token_files.unpack(index, body)[:n].tolist() == x.tolist()


def test_a_file_is_packed_by_portions(monkeypatch):
    monkeypatch.setattr(token_files, "PACKED", 256)
    x = np.random.default_rng(4).integers(0, 50_000, 3000).astype(np.uint32)
    own = token_files.TokenFile(token_files.file_bytes(3, 4, [7, None, 9], [1000, 0, 2000], x))
    assert (own.part, own.seq, own.n_ids) == (3, 4, 3000) and own.ids(0, 3000).tolist() == x.tolist() and own.ids(900, 1300).tolist() == x[900:1300].tolist()


def test_outliers_are_patches():
    x = np.full(1280, 7, np.uint32) + np.arange(1280, dtype=np.uint32) % 8
    x[::128] = 40_000
    index, body = token_files.pack(x)
    assert index[1].tolist() == [3] * 10 and index[2].tolist() == [1] * 10 and len(body) == 10 * (48 + 5)
