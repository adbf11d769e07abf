"""Hashed word and character n-gram features, and word-level scoring of whole texts."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.util import held, materialize, mix64, roll

#: Words whose features a task keeps.
KEEP = 500_000


def ngrams(words: list[bytes], bits: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """owner, feature of each feature of each word: the word itself, and its n-grams of characters with marks for its ends."""
    text = b"".join([b"<" + w + b">" for w in words])
    raw = np.frombuffer(text, np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    letters = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before each byte
    if len(letters) == starts[-1]:  # else the text isn't valid UTF-8: bytes are its characters
        size, raw = starts[ends] - starts[ends - size], letters
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))  # characters from here to the end of the word
    raw, shift = raw.astype(np.uint64) + np.uint64(1), np.uint64(64 - bits)
    owners = [np.arange(len(words))]
    features = [np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & ((1 << bits) - 1)]
    for n in range(low, high + 1):
        if len(raw) >= n:
            here = np.flatnonzero(left[: len(raw) - n + 1] >= n)
            owners.append(owner[here])
            features.append((mix64(roll(raw, n)[here] + np.uint64(n)) >> shift).astype(np.int64))
    return np.concatenate(owners), np.concatenate(features)


#: Feature of a word that repeats the word before it (a word 2-gram whose two words are one).
AGAIN = 0


def sparse(words: list[bytes], bits: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their share of all its features."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    seen = Counter(words)
    owner, feature = ngrams(list(seen), bits, low, high)
    times = np.fromiter(seen.values(), np.float64, len(seen))[owner]
    again = sum(a == b for a, b in zip(words, words[1:]))
    ids, at = np.unique(np.append(feature, AGAIN), return_inverse=True)
    share = np.bincount(at, np.append(times, again))
    return ids.astype(np.int32), (share / share.sum()).astype(np.float32)


class Scorer:
    """Sums of per-feature weights over whole texts: weights is (features, outputs)."""

    def __init__(self, weights: np.ndarray, bits: int, low: int, high: int):
        self.weights, self.bits, self.low, self.high = weights, bits, low, high
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sums = np.zeros((1024, self.weights.shape[1]))
        self.counts = np.zeros(1024, np.int64)

    def learn(self, words: list[bytes]) -> None:
        first = len(self.number)
        while first + len(words) > len(self.counts):
            self.sums, self.counts = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        for begin in range(0, len(words), 20_000):
            some = words[begin : begin + 20_000]
            owner, feature = ngrams(some, self.bits, self.low, self.high)
            here = slice(first + begin, first + begin + len(some))
            self.counts[here] = np.bincount(owner, minlength=len(some))
            for k in range(self.weights.shape[1]):
                self.sums[here, k] = np.bincount(owner, self.weights[feature, k], len(some))
        self.number.update(zip(words, range(first, first + len(words))))

    def means(self, texts: list[list[bytes]]) -> np.ndarray:
        """Mean weight of each text's features, for each output; zeros for a text without words."""
        if len(self.number) > KEEP:
            self.clear()
        new = {w for t in texts for w in t if w not in self.number}
        if new:
            self.learn(list(new))
        out = np.zeros((len(texts), self.weights.shape[1]))
        for k, words in enumerate(texts):
            if words:
                at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
                again = int((at[1:] == at[:-1]).sum())
                out[k] = (self.sums[at].sum(0) + again * self.weights[AGAIN]) / (int(self.counts[at].sum()) + again)
        return out

    def batch(self, texts) -> np.ndarray:
        """means() of any number of texts (iterable of word lists), some at a time."""
        out, held, n = [np.zeros((0, self.weights.shape[1]))], [], 0
        for words in texts:
            held.append(words)
            n += len(words)
            if n > 200_000:
                out.append(self.means(held))
                held, n = [], 0
        return np.concatenate([*out, self.means(held)])


def scorer(key: int, weights: np.ndarray, bits: int, low: int, high: int) -> Scorer:
    """One scorer for each worker process and model (named by key), so that tasks share what it learnt."""
    return held(("scorer", key), lambda: Scorer(weights.astype(np.float64), bits, low, high))


class Sample:
    """Features of drawn documents, a sequence in the order of doc_id: (ids, share) as sparse() gives them.

    They lie in the shared folder and are loaded by batches of BATCH bytes (or one document) as they are asked for; at
    most `limit` bytes (HELD) stay, so the driver's memory doesn't grow with the texts.  Passes that go batch by batch read each
    batch once; `order` gives random orders of that kind, the same whatever is held.
    """

    def __init__(self, table: DataFrame, docs: list[tuple[int, int]]):
        """docs: doc_id and bytes of features, in order."""
        self.table, self.docs, self.held, self.batch_of, self.begins, self.limit = table, docs, {}, [], [], HELD
        size = 0
        for k, (_, n) in enumerate(docs):
            size += n
            if not k or size > BATCH:
                self.begins.append(k)
                size = n
            self.batch_of.append(len(self.begins) - 1)

    def __len__(self) -> int:
        return len(self.docs)

    def batch(self, b: int) -> range:
        return range(self.begins[b], self.begins[b + 1] if b + 1 < len(self.begins) else len(self.docs))

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.batch_of[k]
        if b not in self.held:
            rows = self.batch(b)
            new = sum(self.docs[i][1] for i in rows)
            while self.held and new + sum(self.docs[i][1] for x in self.held for i in self.batch(x)) > self.limit:
                del self.held[next(iter(self.held))]
            found = self.table.where(F.col("doc_id").between(self.docs[rows[0]][0], self.docs[rows[-1]][0])).collect()
            self.held[b] = [unpacked(bytes(r["packed"])) for r in sorted(found, key=lambda r: r["doc_id"])]
        return self.held[b][k - self.begins[b]]


def packed(ids: np.ndarray, share: np.ndarray) -> bytes:
    """Features of a text as they travel: differences of the ids and the shares, a fourth of their size."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(ids, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() + share.astype("<f4").tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = len(raw) // 8
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<i4").ravel()
    return np.cumsum(steps, dtype=np.int32), np.frombuffer(raw, "<f4", n, 4 * n).copy()


def order(texts, rng: np.random.Generator) -> list[int]:
    """A random order of the texts; of a Sample, batch after batch."""
    if not isinstance(texts, Sample):
        return rng.permutation(len(texts)).tolist()
    return [int(k) for b in rng.permutation(len(texts.begins)) for k in rng.permutation(np.array(texts.batch(b)))]


#: Bytes of features (a fourth of them travels) that are loaded in one go, and that stay loaded; files that hold a sample.
BATCH, HELD, FILES = 8_000_000, 192_000_000, 12


def draw(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int, words, bits: int, low: int, high: int) -> tuple[Sample, list[tuple]]:
    """Features of `rows` labelled documents, the first in the order of a hash of doc_id, and their labels (columns).

    words: splits the bytes of a whole text.  Tasks make the features; a text's length decides nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).where(F.col("doc_id").isNotNull() & F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)).eqNullSafe(0))
    there = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    some = there.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = materialize(some, "labelled")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))

    def work(batches):
        for b in batches:
            for doc, raw in zip(b["doc_id"].to_pylist(), b["raw"]):
                ids, part = sparse(words(raw.as_py()), bits, low, high)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([packed(ids, part)], pa.binary())], names=["doc_id", "n", "packed"])

    one = text.join(F.broadcast(some.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("raw").alias("raw"))
    table = materialize(one.coalesce(FILES).mapInArrow(work, "doc_id long, n long, packed binary"), "features")
    sizes = dict(table.select("doc_id", 8 * F.col("n")).collect())
    got = sorted((r for r in some.collect() if r["doc_id"] in sizes), key=lambda r: r["doc_id"])
    return Sample(table, [(r["doc_id"], sizes[r["doc_id"]]) for r in got]), [tuple(r[c] for c in columns) for r in got]
