"""Source divergence audit: how the term shares of a language's sources differ, from mergeable radix tries.

Tasks count the terms of whole documents in byte tries whose leaves hold a counter for each (language, source): the
occurrences, and the documents that hold the term.  A ``Trie`` lies in preorder, that is in the order of its terms'
UTF-8 bytes: each leaf has the depth at which its path leaves the one before, the label from there on, and its
counters.  Tries are cut at common prefix ranges, ranges meet in one task each, and their tries are merged; only then is
it known which terms a language keeps.  A last pass traverses the kept tries and streams, for each pair of sources, the
sum over terms, and for each source its best terms in the order of value and bytes, of which no task keeps more than the
ranks asked for.

Occurrences are summed in the tries before anything moves, so a frequent term or source is one counter a trie.  Ranges
are quantiles of the leaves' first bytes; a prefix that fills several ranges is dealt to them by a hash of the term,
which is right because sums and candidates of ranges only add up.  All arithmetic is on integers (64 bits suffice to
9e15 occurrences of a language).  The driver holds the (language, source) table with its totals, whose pairs are the
result, and the cuts, as many as ranges.

Cases: null text, lang and source count as empty strings; a group whose documents have no terms still meets the others
of its language; rows that repeat are documents of their own; a long text is split in slices and is one document; ties
go by the item's bytes; an empty table gives an empty table; columns besides text, lang and source are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.llm.util import expand, materialize
from skyweave.operators.layout import top_per_key

#: Lower-cased A-Z and bytes of other characters than ASCII stay; all others part terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, words that are counted together, leaves and counters of a task's trie about.
SLICE, WORDS, LEAVES, COUNTERS = 4_000_000, 400_000, 150_000, 1_000_000
#: Counters of a range about, before its tries are merged; every STEP-th leaf of a trie helps to choose the ranges.
RANGE, STEP = 250_000, 64
#: Scale of the shares.
SCALE = 1_000_000_000
#: Bytes of a term that prefix ranges look at.
PREFIX = 7


def prefixes(terms: list[bytes]) -> np.ndarray:
    """First bytes of each term as a number in the order of the bytes."""
    padded = b"".join([b"\0" + t[:PREFIX].ljust(PREFIX, b"\0") for t in terms])
    return np.frombuffer(padded, ">u8").astype(np.int64)


class Trie:
    """Terms in the order of their bytes, and for each its counters, sorted by group: (group, occurrences, documents)."""

    HEAD = struct.Struct("<2Q6B")

    def __init__(self, terms: list[bytes], each: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray):
        self.terms, self.each, self.group, self.count, self.docs = terms, each, group, count, docs

    @staticmethod
    def of(terms: list[bytes], leaf: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray) -> Trie:
        """From distinct terms in any order, and counters in any order whose leaves are numbers of terms; counters of one leaf and group add up."""
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        width = int(group.max(initial=0)) + 1
        key, count, docs = added(rank[leaf] * width + group, count, docs)
        return Trie([terms[k] for k in order], np.bincount(key // width, minlength=len(terms)), key % width, count, docs)

    @staticmethod
    def merge(tries: list[Trie]) -> Trie:
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        leaves = [np.repeat(np.fromiter(map(number.__getitem__, t.terms), np.int64, len(t.terms)), t.each) for t in tries]
        column = lambda name: np.concatenate([getattr(t, name) for t in tries])
        return Trie.of(list(number), np.concatenate(leaves), column("group"), column("count"), column("docs"))

    def some(self, leaves: np.ndarray) -> Trie:
        """The trie of some leaves, in order."""
        ends = np.cumsum(self.each)
        at = expand(ends[leaves] - self.each[leaves], self.each[leaves])
        return Trie([self.terms[k] for k in leaves.tolist()], self.each[leaves], self.group[at], self.count[at], self.docs[at])

    def cut(self, cuts: np.ndarray) -> list[tuple[int, Trie]]:
        """The trie's part in each prefix range that has leaves."""
        own = prefixes(self.terms)
        low, high = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
        for k in np.flatnonzero(high > low + 1).tolist():  # a prefix that fills several ranges
            low[k] += zlib.crc32(self.terms[k]) % int(high[k] - low[k])
        return [(r, self.some(np.flatnonzero(low == r))) for r in np.unique(low).tolist()]

    def depths(self) -> np.ndarray:
        """How many bytes each term shares with the one before."""
        if not self.terms:
            return np.zeros(0, np.int64)
        heads = np.array([t[:32] for t in self.terms], "S32").view(np.uint8).reshape(-1, 32)  # terms hold no zero bytes
        differ = np.concatenate([heads[1:] != heads[:-1], np.ones((len(heads) - 1, 1), bool)], axis=1)
        out = np.concatenate([[0], differ.argmax(1)])
        size = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
        for k in np.flatnonzero(out == 32).tolist():
            a, b = self.terms[k - 1], self.terms[k]
            while out[k] < min(len(a), len(b)) and a[out[k]] == b[out[k]]:
                out[k] += 1
        return out

    def to_bytes(self) -> bytes:
        depth = self.depths()
        labels = [t[d:] for t, d in zip(self.terms, depth.tolist())]
        size = np.fromiter(map(len, labels), np.int64, len(labels))
        text = b"".join(labels)
        columns = [c.astype(f"<u{narrow(c)}") for c in (depth, size, self.each, self.group, self.count, self.docs)]
        return self.HEAD.pack(len(labels), len(self.group), *(c.dtype.itemsize for c in columns)) + b"".join(c.tobytes() for c in columns) + text

    @staticmethod
    def from_bytes(raw: bytes) -> Trie:
        n, m, *widths = Trie.HEAD.unpack_from(raw)
        at, columns = Trie.HEAD.size, []
        for width, rows in zip(widths, (n, n, n, m, m, m)):
            columns.append(np.frombuffer(raw, f"<u{width}", rows, at).astype(np.int64))
            at += rows * width
        depth, size, each, group, count, docs = columns
        terms, term = [], b""
        for d, s in zip(depth.tolist(), size.tolist()):
            term = term[:d] + raw[at : at + s]
            at += s
            terms.append(term)
        return Trie(terms, each, group, count, docs)


def narrow(column: np.ndarray) -> int:
    """Bytes that hold each of a column's numbers."""
    most = int(column.max(initial=0))
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8


def added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begins], *(np.add.reduceat(v[order], begins) for v in values)


def words_of(raw: bytes):
    """Words of a text, some at a time."""
    text, at = raw.translate(LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(rows: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """trie, counters, heads (first bytes of some leaves): tries of the tasks' documents."""
    number_of = {g: k for k, g in enumerate(groups)}

    def work(batches):
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        waiting, runs = [], []  # (group, numbers of the words) of documents; (leaf * groups + group, occurrences, documents)
        words = counters = 0

        def settle():
            nonlocal words, counters
            if waiting:
                size = np.array([len(x) for _, x in waiting])
                ids, n = np.concatenate([x for _, x in waiting]), len(number)
                pair, times = np.unique(np.repeat(np.arange(len(size)), size) * n + ids, return_counts=True)
                of = np.array([g for g, _ in waiting])[pair // max(1, n)]
                runs.append(added(pair % max(1, n) * len(groups) + of, times, np.ones(len(pair), np.int64)))
                counters += len(runs[-1][0])
                waiting.clear()
            words = 0
            if counters > COUNTERS:
                runs[:] = [added(*map(np.concatenate, zip(*runs)))]
                counters = len(runs[0][0])

        def whole():
            nonlocal counters
            key, times, docs = map(np.concatenate, zip(*runs))
            own = Trie.of(list(number), key // len(groups), key % len(groups), times, docs)
            number.clear()
            runs.clear()
            counters = 0
            return pa.RecordBatch.from_arrays([pa.array([own.to_bytes()], pa.binary()), pa.array([len(own.group)], pa.int64()), pa.array([prefixes(own.terms[::STEP]).tolist()], pa.list_(pa.int64()))], names=["trie", "counters", "heads"])

        for b in batches:
            for lang, source, raw in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["raw"]):
                ids = [np.fromiter(map(number.__getitem__, some), np.int64, len(some)) for some in words_of(raw.as_py()) if some]
                if ids:
                    waiting.append((number_of[lang, source], np.concatenate(ids)))
                    words += len(waiting[-1][1])
                if words > WORDS:
                    settle()
                if len(number) > LEAVES or counters > COUNTERS:
                    settle()
                    yield whole()
        settle()
        if number:
            yield whole()

    return rows.mapInArrow(work, "trie binary, counters long, heads array<long>")


def cuts_of(tries: DataFrame) -> np.ndarray:
    """Where prefix ranges begin: quantiles of the leaves' first bytes."""
    parts = int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    total = tries.agg(F.sum("counters")).first()[0] or 0
    n = max(parts, -(-total // RANGE))
    if n < 2:
        return np.zeros(0, np.int64)
    found = tries.select(F.explode("heads").alias("h")).agg(F.percentile_approx("h", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("cuts")).first()["cuts"]
    return np.array(found or [], np.int64)


def merge_tries(tries: DataFrame, groups: list[tuple[str, str]], least: int) -> DataFrame:
    """trie, langs, kept, groups, totals: merged tries of prefix ranges with the terms that a language keeps, and how many they are."""
    cuts = cuts_of(tries)
    langs = np.unique([g[0] for g in groups], return_inverse=True)[1] if groups else np.zeros(0, np.int64)

    def deal(batches):
        for b in batches:
            for raw in b["trie"]:
                for r, own in Trie.from_bytes(raw.as_py()).cut(cuts):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([own.to_bytes()], pa.binary())], names=["range", "trie"])

    def kept(own: Trie):
        leaf, lang = np.repeat(np.arange(len(own.terms)), own.each), langs[own.group]
        n_langs = int(langs.max()) + 1
        key = leaf * n_langs + lang
        held = np.bincount(key, own.docs, len(own.terms) * n_langs) >= least
        here = held[key]
        each = np.bincount(leaf[here], minlength=len(own.terms))
        some = Trie(own.terms, each, own.group[here], own.count[here], own.docs[here])
        some = some.some(np.flatnonzero(each))
        if not some.terms:
            return None
        by_lang = held.reshape(-1, n_langs).sum(0)
        g, n = added(some.group, some.count)
        lists = [np.flatnonzero(by_lang), by_lang[np.flatnonzero(by_lang)], g, n]
        return pa.RecordBatch.from_arrays([pa.array([some.to_bytes()], pa.binary()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in lists)], names=["trie", "langs", "kept", "groups", "totals"])

    def work(batches):
        now, held_, size = None, [], 0
        for b in batches:
            for r, raw in zip(b["range"].to_pylist(), b["trie"]):
                if r != now and held_:
                    if (out := kept(Trie.merge(held_))) is not None:
                        yield out
                    held_, size = [], 0
                now = r
                held_.append(Trie.from_bytes(raw.as_py()))
                size += len(held_[-1].group)
                if size > 2 * COUNTERS:  # merged before the next one comes, so that a task holds the range's terms, not its tries
                    held_ = [Trie.merge(held_)]
                    size = len(held_[0].group) // 2
        if held_ and (out := kept(Trie.merge(held_))) is not None:
            yield out

    dealt = tries.select("trie").mapInArrow(deal, "range int, trie binary")
    placed = dealt.repartition(len(cuts) + 1, "range").sortWithinPartitions("range")
    return placed.mapInArrow(work, "trie binary, langs array<long>, kept array<long>, groups array<long>, totals array<long>")


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly: three digits at a time, so that nothing passes 64 bits."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(has: np.ndarray, p: np.ndarray, none: np.ndarray) -> np.ndarray:
    """sums[a, b] over terms of distance(p[:, a], p[:, b]); none: shares of sources without a term.

    Only terms that one of both sources has are looked at; for the others the distance is one number, times their count.
    """
    out = np.zeros((p.shape[1],) * 2, np.int64)
    for x in range(p.shape[1]):
        r = np.flatnonzero(has[:, x])
        if len(r):
            own, other = p[r, x][:, None], p[r]
            out[x] += distance(own, other).sum(0)
            out[:, x] += np.where(has[r], 0, distance(other, own)).sum(0)
    n, shared = has.sum(0), has.T.astype(np.float64) @ has
    neither = len(has) - (n[:, None] + n[None, :] - shared.astype(np.int64))
    return out + neither * distance(none[:, None], none[None, :])


def divergences(merged: DataFrame, groups: list[tuple[str, str]], totals: np.ndarray, vocabulary: dict[str, int], ranks: int) -> DataFrame:
    """part, a, b, item, value: of every task, sums over pairs (a, b) of groups, and best terms of each group a."""
    langs: dict[str, list[int]] = {}
    for k, (lang, _) in enumerate(groups):
        langs.setdefault(lang, []).append(k)
    # for each language with terms: its groups, a place for each group, N + V of the groups and of the language
    plans = []
    for lang, own in langs.items():
        if vocabulary.get(lang):
            place = np.full(len(groups), -1)
            place[own] = np.arange(len(own))
            plans.append((np.array(own), place, totals[own] + vocabulary[lang], int(totals[own].sum()) + vocabulary[lang]))

    def work(batches):
        sums = [np.zeros((len(own),) * 2, np.int64) for own, *_ in plans]
        best: dict[int, tuple[np.ndarray, list[bytes]]] = {}

        def take(trie: Trie, k: int):
            own, place, sizes, size = plans[k]
            at = place[trie.group]
            mine = np.flatnonzero(at >= 0)
            if not len(mine):
                return
            leaf = np.repeat(np.arange(len(trie.terms)), trie.each)[mine]
            leaves, row = np.unique(leaf, return_inverse=True)
            count = np.zeros((len(leaves), len(own)), np.int64)
            count[row, at[mine]] = trie.count[mine]
            has, none = count > 0, share(np.int64(1), sizes)
            p = np.broadcast_to(none, count.shape).copy()
            r, c = np.nonzero(has)
            p[r, c] = share(count[r, c] + 1, sizes[c])
            sums[k] += pair_sums(has, p, none)
            of_lang = share(count.sum(1) + 1, size)
            for x, g in enumerate(own.tolist()):
                more = np.flatnonzero(has[:, x] & (p[:, x] > of_lang))
                if len(more):
                    value = distance(p[more, x], of_lang[more])
                    first = np.argsort(-value, kind="stable")[:ranks]  # leaves lie in the order of their bytes
                    terms = [trie.terms[i] for i in leaves[more[first]].tolist()]
                    value, held_ = value[first], best.get(g)
                    if held_:
                        value, terms = np.concatenate([held_[0], value]), held_[1] + terms
                        order = sorted(range(len(terms)), key=lambda i: (-value[i], terms[i]))[:ranks]
                        value, terms = value[order], [terms[i] for i in order]
                    best[g] = value, terms

        for b in batches:
            for raw in b["trie"]:
                trie = Trie.from_bytes(raw.as_py())
                for k, (own, *_) in enumerate(plans):
                    step = max(1, 1_000_000 // len(own))
                    for begin in range(0, len(trie.terms), step):
                        take(trie.some(np.arange(begin, min(begin + step, len(trie.terms)))) if len(trie.terms) > step else trie, k)
        names = ["part", "a", "b", "item", "value"]
        for (own, *_), found in zip(plans, sums):
            for x, a in enumerate(own.tolist()):
                if found[x].any():
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(["pair"] * n), pa.array([a] * n, pa.int32()), pa.array(own.astype(np.int32)), pa.array([None] * n, pa.string()), pa.array(found[x])], names=names)
        for a, (value, terms) in best.items():
            n = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array(["term"] * n), pa.array([a] * n, pa.int32()), pa.array([None] * n, pa.int32()), pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()), pa.array(value)], names=names)

    return merged.select("trie").mapInArrow(work, "part string, a int, b int, item string, value long")


def audit(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    A language's terms are those of at least `least` of its documents.  Part 'pair': every other source of the language,
    by its divergence; part 'term': the terms that the source has more often than its language, the first `ranks`.
    """
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), blank("text").cast("binary").alias("raw"))
    groups = sorted(((r["lang"], r["source"]) for r in rows.select("lang", "source").distinct().collect()), key=lambda g: (g[0].encode(), g[1].encode()))
    merged = materialize(merge_tries(materialize(count_terms(rows, groups), "tries"), groups, least), "kept")
    each = lambda a, b: merged.select(F.explode(F.arrays_zip(a, b)).alias("x")).groupBy(F.col(f"x.{a}").alias("k")).agg(F.sum(f"x.{b}").alias("n")).collect()
    names = sorted({g[0] for g in groups})
    vocabulary = {names[r["k"]]: r["n"] for r in each("langs", "kept")}
    totals = np.zeros(len(groups), np.int64)
    for r in each("groups", "totals"):
        totals[r["k"]] = r["n"]
    found = materialize(divergences(merged, groups, totals, vocabulary, ranks), "found")
    table = spark.createDataFrame([(k, *g) for k, g in enumerate(groups)], "g int, lang string, source string")
    sums = found.where("part = 'pair'").groupBy("a", "b").agg(F.sum("value").alias("value"))
    a, b = table.select(F.col("g").alias("a"), "lang", "source"), table.select(F.col("g").alias("b"), F.col("lang").alias("_lang"), F.col("source").alias("item"))
    pairs = a.join(b, (F.col("lang") == F.col("_lang")) & (F.col("a") != F.col("b"))).join(sums, ["a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = top_per_key(found.where("part = 'term'").select("a", "item", "value"), "a", [F.col("value").desc(), F.col("item")], ranks)
    terms = terms.join(a, "a").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    of_group = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return pairs.unionByName(terms).withColumn("rank", F.row_number().over(of_group).cast("int"))
