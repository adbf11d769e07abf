"""Decontamination against all windows; classifiers by held-out accuracy."""

import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from skyweave.llm import decontamination, quality, text_features, toxicity

DATA = "/root/testdata/sf0.01"


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(500)] + ["...", "--"]
    items = [(k, " ".join(r.choices(words, k=r.choice([3, 5, 8, 20, 20, 45])))) for k in range(25)] + [(30, None), (31, "!!"), (None, "odd one out of the ordinary words"), (5, "the same item twice over here"), (5, "the same item twice over here")]
    docs = [(900, None), (901, ""), (902, "w1"), (None, items[3][1]), (903, " ".join(r.choices(words, k=3000)) + " " + (items[9][1] or "").upper())]
    for k in range(120):
        parts = [" ".join(r.choices(words, k=r.randrange(0, 40)))]
        if r.random() < 0.6:
            w = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            parts += [" ".join(x + r.choice(["", ",", "."]) for x in w)]
        docs.append((k, r.choice([" ", "\n"]).join(parts + [" ".join(r.choices(words, k=r.randrange(0, 40)))])))
    return docs, items


@pytest.mark.parametrize("block", [20_000, 7])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    docs, items = corpus(3)
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, raw string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontamination.hits(d, b).collect()), key=repr)
    want = sorted(decontamination.brute(docs, items), key=repr)
    assert got == want and len(got) > 30
    dirty = {i for i, *_ in want}
    clean = decontamination.filter_clean(d, b)
    assert clean.columns == d.columns and sorted(map(repr, (r.doc_id for r in clean.collect()))) == sorted(repr(i) for i, _ in docs if i not in dirty)
    assert decontamination.hits(d.limit(0), b).count() == 0 and decontamination.hits(d, b.limit(0)).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    """An item less a few words is a whole document: all shingles that it has are the item's."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(r.choices(words, k=n))) for k, n in enumerate([59, 59, 40, 15, 7, 6, 5, 4])]
    docs = [(100 * k + 10 * a + b, " ".join(t.split()[a : len(t.split()) - b])) for k, t in items for a in range(4) for b in range(4)]
    docs += [(5000 + a, " ".join(items[0][1].split()[a:])) for a in range(4, 20)] + [(6000, None), (6001, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.first_word, x.n_words) for x in decontamination.hits(d, b).collect()}
    # A document of m of an item's n shingles has similarity m / n.
    want = {(i, k): (0, w) for i, t in docs for k, said in items if t and t in said and (w := len(t.split())) and (t == said or w >= 5 and 100 * (w - 4) >= 80 * (len(said.split()) - 4))}
    assert got == want and {(1, 0), (10, 0), (201, 2), (300, 3)} <= set(got) and (5019, 0) not in got
    assert sorted((x[0], x[1]) for x in decontamination.brute(docs, items)) == sorted(want)
    clean = {x.doc_id for x in decontamination.filter_clean(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_the_multi_index_finds_all_within_the_radius():
    """Against all distances; and few random fingerprints come back."""
    import numpy as np

    g = np.random.default_rng(3)
    index = decontamination.Index([(k, " ".join(f"w{x}" for x in g.integers(0, 10**6, 30))) for k in range(1500)], 5, 60, 80)
    flipped = index.prints[:300].copy()
    for row, n in enumerate(g.integers(0, 90, 300)):
        bits = np.unpackbits(flipped[row : row + 1].view(np.uint8))
        bits[g.choice(256, n, replace=False)] ^= 1
        flipped[row] = np.packbits(bits).view(np.uint64)
    asked = np.concatenate([flipped, g.integers(0, 1 << 63, (200, 4)).astype(np.uint64) * np.uint64(2)])
    want = {(k, i) for k in range(len(asked)) for i in np.flatnonzero(decontamination.distances(index.prints, asked[k]) <= 60).tolist()}
    assert {(k, int(i)) for k, items in index.near(30, asked) for i in items} == want and len(want) > 150
    window, _ = index.candidates(asked[300:364])
    assert len(window) < 0.2 * 64 * 1500
    assert sum(t + 1 for t in decontamination.limits(60)) == 61 and set(map(int, np.bitwise_count(decontamination.masks(2)))) == {0, 1, 2}


def test_passages_at_the_threshold_are_found():
    """Items with single words changed, of similarity 0.8 to 1: the fingerprints lose hardly any."""
    r = random.Random(8)
    items = [(k, " ".join(f"w{r.randrange(10**5)}" for _ in range(r.choice([30, 60, 90])))) for k in range(300)]
    index, docs = decontamination.Index(items, 5, decontamination.RADIUS, 80), []
    for k, text in items:
        w = text.split()
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(len(w))] = "other"
        docs.append((k, " ".join(["before"] * 40 + w + ["behind"] * 40)))
    want = {(d, i) for doc, item in zip(docs, items) for d, i, *_ in decontamination.brute([doc], [item])}
    got = {(d, i) for d, i, *_ in index.search([t.encode().split() for _, t in docs])}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 150


def test_a_large_index_is_asked_fast():
    """20,000 items: a text of 100 words costs no step a shingle of the items."""
    import time

    g = random.Random(9)
    index = decontamination.Index([(k, " ".join(f"w{g.randrange(10**5)}" for _ in range(g.choice([20, 40, 60])))) for k in range(20_000)], 5, decontamination.RADIUS, 80)
    text = [f"w{g.randrange(10**5)}".encode() for _ in range(100)]
    list(index.search([text]))
    began = time.process_time()
    for _ in range(5):
        assert not list(index.search([text]))
    assert (time.process_time() - began) / 5 < 0.1


def test_a_long_text_of_one_word(spark):
    """Windows of one bag are looked up once, and memory doesn't grow with the text."""
    items = [(1, "again " * 50), (2, "again " * 30 + "and " * 30)]
    docs = [(1, "again " * 200_000), (2, "again " * 200_000 + "and " * 40), (3, "and other words " * 60_000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word) for r in decontamination.hits(d, b).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (2, 2, 199_970)]


def labelled(data=DATA):
    text = dict(zip(*pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    known = pq.read_table(f"{data}/labels.parquet").to_pylist()
    return [(r["doc_id"], text[r["doc_id"]], r["quality"], r["toxic"]) for r in known]


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(got[d], q) for d, _, q, _ in labelled() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(got) == docs.count() and all(r.held_out for r, _ in held)
    assert sum(r.predicted == q for r, q in held) >= 0.95 * len(held)


def test_quality_is_blind_to_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels, 60), quality.fit(docs, other, 60)
    assert (a.weights == b.weights).all() and a.bias == b.bias


ODD = [(1, None, "x"), (2, "", "x"), (3, "word", None), (3, "word", None), (None, "q " * 50_000, "x"), (4, "x" * 200_000, "x")]


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    for rows in ([], [(1, 1, 0), (3, None, None), (99, 0, 1)], [(1, 0, 1), (3, 1, 0), (4, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = quality.classify(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        chain = toxicity.fit(docs, labels)
        got = toxicity.score(docs, chain).collect()
        assert len(got) == len(ODD) and all(0 <= r.p_toxic <= 1 for r in got)
        assert toxicity.filter_clean(docs, chain).columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0 and toxicity.score(docs.limit(0), chain).count() == 0


def features(raw: bytes, lower: bool = False):
    return text_features.sparse((raw.lower() if lower else raw).split(), 18, 3, 6)


def plain_features(text: str) -> Counter:
    """Hashed features of a text, one character n-gram at a time."""
    out, words, m = Counter(), text.split(), (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & m
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & m
        return x ^ x >> 32

    for w in words:
        out[zlib.crc32(w.encode()) & (1 << 18) - 1] += 1
        marked = f"<{w}>"
        for n in range(3, 7):
            for k in range(len(marked) - n + 1):
                h = 0
                for c in marked[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & m
                out[mix((h + n) & m) >> 46] += 1
    out[text_features.AGAIN] += sum(a == b for a, b in zip(words, words[1:]))
    return out


def test_scores_are_those_of_a_plain_scorer(spark):
    """Unfolded vectors and a chain that is walked one feature at a time, row by row."""
    import numpy as np

    rows = labelled()[:150]
    quality_sample = [(features(t.encode()), q) for _, t, q, _ in rows]
    vectors, layer, bias = quality.sgd([x for x, _ in quality_sample], [y for _, y in quality_sample], epochs=3)
    names = tuple(n for n, _ in toxicity.CHAIN)
    chain = toxicity.train([(features(t.encode(), True), int(x and q), int(x and not q), x) for _, t, q, x in rows], names)
    texts = [(k, t[:3000]) for k, (_, t, _, _) in enumerate(rows[:40])] + [(90, "Straße straße 日本語の文 ñandú x x x"), (91, ""), (92, None), (93, "ß")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.Model((vectors @ (layer[1] - layer[0]))[:, None].astype(np.float32), float(bias[1] - bias[0]))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    toxic = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    for k, t in texts:
        seen = plain_features(t or "")
        mean = sum((n * vectors[f] for f, n in seen.items()), np.zeros(vectors.shape[1])) / max(1, sum(seen.values()))
        out = layer @ mean + bias
        assert abs(np.exp(out[1]) / np.exp(out).sum() - scores[k]) < 1e-4
        seen, before = plain_features("".join(c.lower() if c < "\x80" else c for c in t or "")), []
        for j in range(len(names)):
            x = sum(n * float(chain.weights[f, j]) for f, n in seen.items()) / max(1, sum(seen.values())) + chain.bias[j]
            x += sum(np.log(p / (1 - p)) * chain.links[i, j] for i, p in enumerate(min(0.99, max(0.01, p)) for p in before))
            before.append(1 / (1 + np.exp(-x)))
        assert abs(before[-1] - toxic[k]) < 1e-4


def test_a_constant_category_in_a_chain():
    """Its probability is the same in training and in scores, first in the chain too."""
    import numpy as np

    rows = labelled()[:200]
    chain = toxicity.train([(features(t.encode(), True), 1, 0, x) for _, t, _, x in rows], ("always", "never", "toxic"))
    p = toxicity.probabilities(chain, toxicity.Scorer(chain.weights.astype(float), 18, 3, 6), [t.encode() for _, t, _, _ in rows])
    assert (p[:, 0] > 0.999).all() and (p[:, 1] < 0.001).all() and np.mean((p[:, 2] >= 0.5) == [r[3] for r in rows]) > 0.95


def test_the_sample_is_bounded_by_rows_alone(spark, monkeypatch):
    """Long texts take no other's place, whichever comes first; what is held on the driver changes nothing."""
    import numpy as np
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(20).orderBy(F.xxhash64("id"), "id").collect()]
    size = {ids[0]: 4_000_000, ids[7]: 50_000}  # 20 MB, first of all
    docs = spark.createDataFrame([(k, f"word{k} " * 5 + "long " * size.get(k, 1)) for k in range(20)] + [(3, "twice")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(77, 1), (78, None)], "doc_id long, y int")
    take = lambda: text_features.draw(docs, labels, ["y"], 15, quality.words, 18, 3, 6)
    texts, y = take()
    assert len(texts) == len(y) == 15 and [d for d, _ in texts.docs] == sorted(ids[:15]) and y == [(d % 2,) for d in sorted(ids[:15])]
    monkeypatch.setattr(text_features, "BATCH", 400)
    monkeypatch.setattr(text_features, "HELD", 1000)
    small, _ = take()
    assert len(small.begins) > 3 and len(small) == 15
    for k in (14, 3, 3, 9, 0):
        assert all((a == b).all() for a, b in zip(texts[k], small[k])) and len(small.held) < len(small.begins)
    a, b = (quality.trained(x, [k for (k,) in y], epochs=2) for x in (small, small))
    monkeypatch.setattr(text_features, "HELD", 10**9)
    c = quality.trained(small, [k for (k,) in y], epochs=2)
    assert (a.weights == b.weights).all() and (a.weights == c.weights).all()
    assert sorted(text_features.order(small, np.random.default_rng(1))) == list(range(15))


def test_toxicity_on_rows_it_did_not_see():
    rows = labelled("/root/testdata/sf0.1")
    names = tuple(n for n, _ in toxicity.CHAIN)
    form = lambda r: (features(r[1].encode(), True), int(r[3] and r[2]), int(r[3] and not r[2]), int(r[3]))
    inside, outside = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if not k % 4]
    chain = toxicity.train([form(r) for r in inside], names)
    scorer = toxicity.Scorer(chain.weights.astype(float), toxicity.BITS, toxicity.LOW, toxicity.HIGH)
    p = toxicity.probabilities(chain, scorer, [r[1].encode() for r in outside])[:, -1]
    y = [r[3] for r in outside]
    assert sum((x >= 0.5) == t for x, t in zip(p, y)) >= 0.97 * len(y)
    assert sum(x >= 0.5 for x, t in zip(p, y) if t) >= 0.9 * sum(y)
    assert chain.links[0, 2] > 0  # the last model uses the first one's probability
