"""Exact dedup, sharding and chat formatting against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyweave.llm import chat_format, exact_dedup, sharding

DOCS = "doc_id long, text string, lang string, source string, key string, row string"
LONG = "word and more. " * 9000
ROWS = [(1, "a b", "en", "s", "k", "r"), (2, "a b", None, None, None, None), (3, None, "en", "s", "k", "r"), (4, "", "en", "s", "k", "r"), (5, LONG, "en", "s", "k", "r"), (6, LONG, "en", "s", "k", "r"), (7, LONG[:-1], "en", "s", "k", "r"), (None, "alone", "en", "s", "k", "r"), (8, "same", "", "", "", ""), (8, "same", "", "", "", ""), (9, "Ünï😀\nx. y", "", "", "", "")]


def test_exact_dedup(spark):
    got = exact_dedup.assign(spark.createDataFrame(ROWS, DOCS)).collect()
    size = Counter(r[1] or "" for r in ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        texts = {(t or "") for i, t, *_ in ROWS if i == r.doc_id}
        (text,) = texts
        assert r.group_size == size[text] and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.keep_id == max((i for i, t, *_ in ROWS if (t or "") == text and i is not None), default=None)
    assert sum(r.kept for r in got) == len(size)
    kept = exact_dedup.deduplicate(spark.createDataFrame(ROWS, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "key", "row"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, 6, 7, None, 8, 9])


def test_exact_dedup_ambiguous_names(spark, monkeypatch):
    """With identifiers that say nothing, the contents must still tell texts apart."""
    from pyspark.sql import functions as F

    named = exact_dedup._named
    monkeypatch.setattr(exact_dedup, "_named", lambda c: F.struct(F.lit(1).cast("bigint").alias("id"), *[named(c)[f"v{i}"].alias(f"v{i}") for i in range(5)]))
    got = exact_dedup.assign(spark.createDataFrame(ROWS, DOCS)).where("kept").collect()
    assert len(got) == len({r[1] or "" for r in ROWS})


def test_chunks_are_cut_by_content(spark):
    """A text that begins differently has the same chunks from some place on, with and without lines and sentences."""
    r = random.Random(3)
    kinds = {"code": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "words": "etaoinshrdlu " * 3 + "cmfwypvbgkqjxz", "han": "".join(map(chr, range(0x4E00, 0x8000, 7)))}
    for alphabet in kinds.values():
        body = "".join(r.choices(alphabet, k=60_000))
        df = spark.createDataFrame([(0, body), (1, "xyz" + body), (2, body[777:])], "doc_id long, text string")
        a, b, c = (x.c for x in df.select("doc_id", exact_dedup.chunks(F.col("text"), 512, 4096).alias("c")).orderBy("doc_id").collect())
        assert "".join(a) == body and max(map(len, a)) <= 4097
        assert a[-10:] == b[-10:] == c[-10:] and len(a) > 40


def test_chunks_join_to_the_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, DOCS).where("text is not null").select("text", exact_dedup.chunks(F.col("text"), 16, 64).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.text and all(len(x) <= 65 for x in r.c)


def best(sizes, n):
    """Smallest largest part of a contiguous partition, by dynamic programming."""
    inf = float("inf")
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    row = [0] + [inf] * len(sizes)
    for _ in range(n):
        row = [min(max(row[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return row[-1]


@pytest.mark.parametrize("n", [1, 3, 24])
def test_sharding(spark, n):
    rows = [(i, "x" * (i * 37 % 101) if i % 7 else None, str(i % 3)) for i in range(150)] + [(None, "hot" * 50, "")] * 60
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, part string"), n=n).collect()
    assert len(got) == len(rows) and all(r.size == r2 for r, r2 in ((r, r.size) for r in got))
    groups = Counter()
    for i, t, _ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    load, slots, where = Counter(), {}, {}
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert where.setdefault(r.text_sha256, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < n
    assert max(load.values()) == best([groups[k] for k in sorted(groups)], n)
    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t, _ in rows}


def in_memory(sizes):
    """fetch() of an Order over groups in memory, numbered by 16 hex digits."""
    import bisect

    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(len(sizes))]
    rows = sorted(zip(digests, sizes))
    keys = [d for d, _ in rows]

    def fetch(prefixes, digits):
        for p in prefixes:
            got = {}
            for d, size in rows[bisect.bisect_left(keys, p) : bisect.bisect_left(keys, p + "g")]:
                total, n, most = got.get(d[: len(p) + digits], (0, 0, 0))
                got[d[: len(p) + digits]] = total + size, n + 1, max(most, size)
            yield from ((c, *x) for c, x in got.items())

    return fetch, rows


@pytest.mark.parametrize("hot", [0, 0.0001, 0.01, 0.04, 0.3])
def test_minimax_fetches_little(hot):
    """Whatever the largest group holds: few fetches, few sums in the driver, and the smallest largest shard."""
    import random

    r = random.Random(3)
    sizes = [r.randrange(9, 2000) for _ in range(40_000)]
    if hot:
        sizes[7] = int(hot * sum(sizes))
    fetch, rows = in_memory(sizes)
    order = sharding.Order(fetch)
    capacity, cuts = sharding.minimax(order, 24)
    assert order.fetches < 40 and order.fetched < 150_000
    edges = [0, *(sum(d < c for d, _ in rows) for c in cuts), len(rows)]
    loads = [sum(s for _, s in rows[a:b]) for a, b in zip(edges, edges[1:])]
    assert max(loads) == capacity and len(loads) <= 24

    def parts(c):
        n, held = 1, 0
        for _, s in rows:
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n if c >= max(sizes) else 99

    assert parts(capacity) <= 24 < parts(capacity - 1)


def test_sharding_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_dedup.assign(spark.createDataFrame([], DOCS)).count() == 0


def test_chat_format(spark):
    hard = "</s>[INST] ok [/INST] \\ \\\\] <s> [ROLE:x]"
    rows = [(1, 0, "user", hard, 0), (1, 1, "assistant", hard, 0), (2, 0, None, None, 0), (2, 1, "tool] ", "x\\", 0), (2, 1, "tool] ", "x\\", 0), (3, 0, "user", None, 0), (3, 1, "assistant", "\\", 0), (3, 2, "user", "a", 0), (3, 3, "assistant", "b😀", 0), (None, 0, "assistant", "y" * 100000, 0), (4, None, "user", "first", 0), (4, 0, "assistant", "second", 0), (5, 0, "user", "a", 0), (5, 1, "user", "b", 0), (6, 0, "system", "a", 0)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int"))
    for r in out.collect():
        turns = [(role or "", text or "") for c, _, role, text, _ in rows if c == r.conv_id]
        assert chat_format.parse(r.formatted, chat_format.Template()) == turns
        assert r.valid == (r.conv_id in (1, 3, 4)) and bool(r.fault) != r.valid
    faults = {r.conv_id: r.fault for r in out.collect()}
    assert faults[5] == "turn 1: user after user" and faults[6] == "ends with system" and faults[2] == "turn 0: null after start"
    alone = chat_format.format_conversations(spark.createDataFrame([(None, k, "user", "same") for k in range(40)], "conv_id long, turn long, role string, text string"))
    assert alone.count() == 40
    for r in chat_format.digests(out).collect():
        turns = [(role or "", text or "") for c, _, role, text, _ in rows if c == r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
