"""Source divergence against plain Python on whole texts; tries by their own laws. (The SQL is compared in test_oracle.)"""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from skyweave.llm import divergence
from skyweave.llm.divergence import Trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, ranks=200):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)
        mine = [s for g, s in groups if g == lang]
        total = {s: sum(count[lang, s][t] for t in kept) for s in mine}
        p = lambda s, t: 1 + 10**9 * (count[lang, s][t] + 1) // (total[s] + v)
        q = lambda t: 1 + 10**9 * (sum(count[lang, s][t] for s in mine) + 1) // (sum(total.values()) + v)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(p(source, t), p(s, t)) for t in kept)) for s in mine if s != source]
        terms = [(t, f(p(source, t), q(t))) for t in kept if count[lang, source][t] and p(source, t) > q(t)]
        for part, rows in (("pair", pairs), ("term", terms)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(rows if part == "pair" else rows[:ranks])]
    return sorted(out)


def run(spark, docs, **more):
    frame = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("item", F.lit(1)).withColumn("value", F.lit("x")).withColumn("rank", F.lit(0))
    return sorted(tuple(r) for r in divergence.audit(frame, **more).select("lang", "source", "part", "item", "value", "rank").collect())


WORDS = "alpha Beta gamma delta épée ÉPÉE naïve 日本 日 𝄞 x xx xxx internationally internationalize internationalism".split()
DOCS = [("en", f"s{k % 4}", " ".join(WORDS[(k * j) % len(WORDS)] for j in range(k % 17))) for k in range(120)] + [
    ("de", "s1", "nur drei mal"), ("de", "s2", "nur drei mal"), ("de", "s2", "nur zwei"), ("de", "s3", None), ("fr", "a", "un"), ("fr", "b", ""),
    (None, None, "nul nul"), ("", "z", "nul"), (None, "", "nul"), ("xx", "only", "a a a b " * 3),
]


def test_all_parts(spark):
    assert run(spark, DOCS) == brute(DOCS)


def test_ranks_ties_and_repeats(spark):
    docs = [("en", f"s{k % 3}", f"tie{k % 7} tié{k % 5} Tie{k % 7}") for k in range(60)] * 2
    assert run(spark, docs, least=1, ranks=3) == brute(docs, 1, 3)


def test_many_small_tries_ranges_and_hot_prefix(spark, monkeypatch):
    """Tries cut into many ranges, one prefix in several of them, slices of a long text."""
    docs = DOCS + [("en", "s1", " ".join(f"internat{chr(97 + k % 26)}{chr(97 + k // 26)} z{chr(97 + k % 26)}" for k in range(400)))] * 3
    for name, value in (("LEAVES", 20), ("RANGE", 10), ("STEP", 1), ("SLICE", 64), ("WORDS", 100), ("COUNTERS", 50)):
        monkeypatch.setattr(divergence, name, value)
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_trie_bytes_cuts_and_merges():
    rng = np.random.default_rng(5)
    every = sorted({"".join(rng.choice(list("abé日"), rng.integers(1, 60))).encode() for _ in range(400)} | {b"a" * 40, b"a" * 45, b"a" * 45 + b"b"})
    leaf = rng.integers(0, len(every), 3000)
    group, count = rng.integers(0, 9, 3000), rng.integers(1, 100, 3000)
    whole = Trie.of(every, leaf, group, count, np.ones(3000, np.int64))
    assert whole.terms == every
    same = lambda a, b: a.terms == b.terms and all((getattr(a, c) == getattr(b, c)).all() for c in ("each", "group", "count", "docs"))
    assert same(Trie.from_bytes(whole.to_bytes()), whole)
    assert all(t[:d] == u[:d] and t[: d + 1] != u[: d + 1] for t, u, d in zip(every, every[1:], whole.depths()[1:].tolist()))
    cuts = divergence.prefixes([b"a", b"ab", b"ab", b"ab", "é".encode()])
    parts = whole.cut(cuts)
    assert sum(len(t.terms) for _, t in parts) == len(every) and same(Trie.merge([t for _, t in reversed(parts)]), whole)
    halves = [Trie.of(every, leaf[a::2], group[a::2], count[a::2], np.ones(1500, np.int64)) for a in (0, 1)]
    assert same(Trie.merge(halves), whole)


def test_shares_of_large_counts():
    big = 4 * 10**15
    for c, n in ((1, 3), (big - 1, big), (10**13, 3 * 10**13 + 7), (big, big)):
        assert int(divergence.share(np.array([c]), n)[0]) == 1 + 10**9 * c // n
