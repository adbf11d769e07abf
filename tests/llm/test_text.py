"""Substring dedup and BPE against plain versions."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from skyweave.llm import bpe, substring_dedup

FILE = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["a", "bb", "the", "Ünï", "x,", " y", "z\x0bq"] + [f"w{k}" for k in range(30)]
    passages = [" ".join(r.choices(words, k=k)) for k in (12, 13, 14, 40, 90)]
    rows = []
    for k in range(n):
        parts = [" ".join(r.choices(words, k=r.randrange(0, 30))) if r.random() < 0.6 else r.choice(passages) for _ in range(r.randrange(0, 6))]
        rows.append((r.choice([k, k, 7, None]), r.choice([" ", "\n", " \t "]).join(parts)))
    return rows + [(99, None), (100, ""), (101, "q " * 3000), (102, "q " * 2000), (103, rows[3][1]), (103, rows[3][1])]


def test_substring_dedup(spark, monkeypatch):
    for seed, chunk in ((1, 1_000_000), (2, 200)):
        rows = corpus(seed)
        monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk)
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, raw string").repartition(3)
        got = sorted(map(tuple, substring_dedup.digests(substring_dedup.deduplicate(df)).collect()), key=repr)
        assert got == sorted(substring_dedup.brute(rows), key=repr)
        assert any(r[2] for r in got)
    assert substring_dedup.deduplicate(df.limit(0)).count() == 0


def test_heavy_minimisers_travel_by_two_words(spark, monkeypatch):
    """Whichever minimisers count as heavy, all or a few, the result is the same; windows of one go to many buckets."""
    import numpy as np

    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for split in (10**9, 3):
        monkeypatch.setattr(substring_dedup, "SPLIT", split)
        own = substring_dedup.heavy_minimisers(substring_dedup.text_rows(df).where("doc_id IS NOT NULL"), 13, 16)
        assert len(own) > (10 if split > 3 else 0)
        assert sorted(map(tuple, substring_dedup.digests(substring_dedup.deduplicate(df)).collect()), key=repr) == sorted(substring_dedup.brute(rows), key=repr)
    rank = np.arange(100, 400).astype(np.uint64)
    rank[::10] = 7  # one small word in every window
    starts = np.arange(288)
    plain, split = (substring_dedup.routes(rank, starts, 13, np.array(h, np.uint64)) for h in ([], [5, 7]))
    assert len(set(plain.tolist())) == 1 and len(set(split.tolist())) > 20


def test_windows_that_share_a_hash(monkeypatch):
    """Colliding hashes are told apart by the words."""
    import numpy as np

    text = b"a b c a b d"
    monkeypatch.setattr(substring_dedup, "roll", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    least = substring_dedup.least_owner(text, substring_dedup.word_hashes(text), np.array([0, 1, 3, 4]), np.array([9, 9, 4, 4]), 2)
    assert least.tolist() == [4, 9, 4, 4]


def thue_morse(n, first="a", second="b"):
    """Words whose sums of bytes times powers of an odd number are equal modulo 2**64."""
    one = [first if bin(k).count("1") % 2 == 0 else second for k in range(n)]
    return "".join(one), "".join(second if c == first else first for c in one)


def test_windows_of_colliding_words(spark):
    pad = " ".join(f"p{k}" for k in range(12))
    rows = []
    for n in (512, 1024, 2048, 4096):
        a, b = thue_morse(n)
        rows += [(n, f"{pad} {a}"), (n + 1, f"{pad} {b}"), (n + 2, f"{pad} {a} tail"), (n + 3, f"{b} {pad}"), (n + 4, f"x {b} {pad}")]
    got = sorted(map(tuple, substring_dedup.digests(substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))).collect()))
    assert got == sorted(substring_dedup.brute(rows))


def test_word_hashes(monkeypatch):
    from skyweave.llm import util

    r = random.Random(8)
    words = ["".join(r.choices("abcé日", k=r.randrange(1, 9))).encode() for _ in range(3000)] + [b"long" * 200]
    want = {}
    for run in (1 << 20, 64):
        monkeypatch.setattr(util, "RUN", run)
        begin, end, h = util.word_hashes(b" ".join(words))
        assert [b" ".join(words)[a:b] for a, b in zip(begin, end)] == words
        for w, x in zip(words, h.tolist()):
            assert want.setdefault(w, x) == x
    assert len(set(want.values())) == len(want) and len(util.word_hashes(b"")[0]) == 0


def texts():
    r = random.Random(5)
    letters = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "7", "½", "é", "é", "日本", "😀", " ", " ", "\x1c", "\x85", "ǅ", "٣", ".", "!!", "<|endoftext|>", "<|endo", "​", "ſ", "\x00"]
    return ["".join(r.choices(letters, k=r.randrange(0, 40))) for _ in range(400)] + ["", " ", "x" * 5000, "ab" * 999 + " " * 500, "<|endoftext|>", "!" * 300]


def test_bpe_is_the_librarys(spark):
    lib = Tokenizer.from_file(FILE)
    own = bpe.Codec(bpe.read_file(FILE))
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    for bad in ([250, 251], [95, 112, 0]):
        assert own.decode(bad) == lib.decode(bad, skip_special_tokens=False)
    rows = [(k, t) for k, t in enumerate(texts()[:50])] + [(None, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(bpe.round_trip(df, FILE)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(df.limit(0), FILE).count() == 0


def test_bpe_long_words_agree():
    own = bpe.Codec(bpe.read_file(FILE))
    r = random.Random(2)
    for _ in range(50):
        raw = bytes(r.choices(b"abetinhrs", k=r.randrange(2, 60)))
        assert own.word(raw) == own.long_word([own.single[b] for b in raw])
