"""Importance resampling against plain Python on whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skyweave.llm import importance, queries

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, percent=25, least=20, n=2, buckets=10_000, seed=7):
    s = Counter(b for _, t in docs for b in features(t, n, buckets)[1])
    t = Counter(b for x in target for b in features(x, n, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        n_words, own = features(text, n, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, docs, target, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    items = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance.resample(frame, items, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_query(spark):
    got = sorted((tuple(r) for r in queries.op12_importance_resampling(spark, DATA).collect()), key=str)
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, DATA).collect()]
    assert got == brute(docs, [r["text"] for r in queries.benchmark(spark, DATA).collect()])
    assert any(r[4] for r in got)


def test_odd_texts_nulls_ties_and_repeats(spark):
    long = "w" * 200 + " " + "é" * 90 + " A\x00B " + "z" * 64 + " " + "y" * 63 + "," + "x" * 65
    docs = [(0, None), (1, ""), (2, "one"), (3, "One,two"), (4, long), (5, "日本 語 12 a_b " * 30), (6, "plain words here " * 10), (6, "plain words here " * 10), (None, "no id at all " * 9), (9, "İI ß ſ K " * 9)]
    target = ["two plain words", None, "日本 語"]
    for n, buckets in ((1, 50), (2, 10_000), (4, 1 << 16)):
        assert run(spark, docs, target, n=n, buckets=buckets, percent=60, least=2) == brute(docs, target, n=n, buckets=buckets, percent=60, least=2)
    assert run(spark, docs, [], percent=100, least=0) == brute(docs, [], percent=100, least=0)


def test_slices_of_long_texts(spark, monkeypatch):
    """Runs across slices, portions and streams are those of the whole text."""
    text = ("alpha beta  gamma, delta " * 500).encode()
    kind = importance.Words()
    whole, each = importance.buckets_of(kind, text.translate(importance.LETTERS).split(), np.array([0]), np.array([0]), 3, 1000)
    monkeypatch.setattr(importance, "SLICE", 50)
    parts, before = [], []
    for some in importance.split(text):
        found, _ = importance.buckets_of(kind, before + some, np.array([0]), np.array([len(before)]), 3, 1000)
        parts.append(found)
        before = (before + some)[-2:]
    assert np.concatenate(parts).tolist() == whole.tolist() and each.tolist() == [len(whole)] and len(parts) > 100
    gains = np.arange(1000, dtype=np.int32) - 500
    monkeypatch.setattr(importance, "FEATURES", 7)
    sizes = np.array([0, 3, 0, 20, 4, 3, 1, 0])
    stream = whole[: sizes.sum()].astype("<u2")
    cuts = np.cumsum(sizes)
    assert importance.sums(stream, sizes, gains).tolist() == [int(gains[stream[b - m : b]].sum()) for b, m in zip(cuts, sizes)]


def test_empty_table_and_sample(spark):
    assert run(spark, [], ["a b"]) == []
    docs = [(k, f"target words number {k % 3} " * 8) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en"))
    items = spark.createDataFrame([(1, "number 2 number 2")], "item_id long, text string")
    want = {r[0] for r in brute(docs, ["number 2 number 2"]) if r[4]}
    got = importance.sample(frame, items)
    assert {r["doc_id"] for r in got.collect()} == want and len(want) == 10 and got.columns == ["doc_id", "text", "lang"]
