"""Importance resampling towards a target: documents drawn by how their hashed n-grams differ from the target's.

Features are runs of 1 to ``n`` consecutive words, each hashed to a bucket by its CRC-32.  Counting is an external
sort-count: tasks write the buckets of whole documents as packed streams of 16-bit numbers with the documents' offsets,
streams are sorted and run-length encoded, and run lengths are summed by bucket.  That gives a gain for each bucket
(how much commoner it is in the target), and a second reading of the streams gathers the gains and sums them for each
document by ``np.add.reduceat``.  Texts are read and split once.

A document's score is its floored mean gain plus a Gumbel noise that its id fixes, so the highest scores are a sample
without replacement whose odds follow the gains.  Ranks come from one sort by ranges of (score, doc_id), in which even
repeated rows spread; nothing but counts by bucket (as many as there are buckets) and by task leaves the executors.

CRC-32 of a run is made from those of its words: appending bytes is a linear map of the checksum before, held as tables
for words of up to ``SHORT`` bytes, so a run costs a few vector steps.

Cases: a null text has no words, no features, weight 0 and no rank; a null doc_id hashes as the empty string and comes
first among equal scores; rows that repeat are documents of their own, with ranks of their own; long texts are read in
slices, their streams stay whole; a target without words has gains of its empty counts; an empty table gives an empty
table; columns besides doc_id (item_id) and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.llm.util import held, materialize

#: Lower-cased A-Z, digits and bytes of other characters than ASCII stay; all others part words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of an appended word that the tables know; words, and bytes of them, that a task keeps.
SHORT, KEEP, KEEP_BYTES = 64, 500_000, 64_000_000
#: Bytes of a text that are split at a time; words and features that are taken together.
SLICE, WORDS, FEATURES = 4_000_000, 400_000, 2_000_000


def append_tables(longest: int) -> np.ndarray:
    """tables[k, j, v]: what byte j with value v of a CRC-32 becomes when k bytes are appended; the four are combined by XOR."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for k in range(longest):
        out[k + 1] = (out[k] >> 8) ^ step[out[k] & 255]
    return out


class Words:
    """CRC-32 of words, and of words after a space, learnt as they come."""

    def __init__(self):
        self.tables = append_tables(SHORT + 1).reshape(-1)
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.alone, self.after, self.size, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; they hold until the next call of trim()."""
        known = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(islice(self.number, known, None))
        if new:
            self.alone = np.concatenate([self.alone, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
            self.after = np.concatenate([self.after, np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new))])
            size = np.fromiter(map(len, new), np.int64, len(new))
            self.size = np.concatenate([self.size, size])
            self.bytes += int(size.sum())
        return out

    def trim(self) -> None:
        if len(self.number) > KEEP or self.bytes > KEEP_BYTES:
            self.clear()

    def longer(self, run: np.ndarray, ids: np.ndarray, words: list[bytes]) -> np.ndarray:
        """CRC-32 of each run when a space and the word with this number follow it."""
        size = self.size[ids] + 1
        base = np.minimum(size, SHORT + 1) * 1024
        out = self.after[ids]
        for j in range(4):
            out = out ^ self.tables[base + (j * 256 + ((run >> np.uint32(8 * j)) & np.uint32(255)).astype(np.int64))]
        for k in np.flatnonzero(size > SHORT + 1).tolist():
            out[k] = zlib.crc32(b" " + words[k], int(run[k]))
        return out


def buckets_of(own: Words, words: list[bytes], begins: np.ndarray, skip: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs that end at each word of some segments, in order, and how many each segment has.

    begins: where segments begin; skip: words at a segment's begin that only precede others (they ended runs before).
    """
    ids = own.ids(words)
    size = np.diff(begins, append=len(words))
    place = np.arange(len(words)) - np.repeat(begins, size)
    out, here = np.zeros((len(words), n), np.uint16), np.zeros((len(words), n), bool)
    run = own.alone[ids]
    for k in range(n):
        if k:
            run = np.concatenate([run[:1], own.longer(run[:-1], ids[1:], words[1:])])
        out[:, k] = run % np.uint32(buckets)
        here[:, k] = place >= np.maximum(k, np.repeat(skip, size))
    each = np.concatenate([[0], np.cumsum(here.sum(1))])
    return out[here], each[begins + size] - each[begins]


def split(raw: bytes):
    """Words of a text, some at a time."""
    text, at = raw.translate(LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


STREAMS = "doc_ids array<long>, n_words array<long>, n_features array<long>, stream binary"


def streams(rows: DataFrame, key: str, n: int, buckets: int) -> DataFrame:
    """Packed streams of buckets (16-bit, little-endian) of whole documents, with their ids and their numbers of words and features."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")

    def work(batches):
        own = held(("runs", n), Words)
        docs, counts, features, parts = [], [], [], []
        waiting: list[tuple[int, list[bytes], int]] = []  # document, words, words that only precede

        def settle():
            if waiting:
                size = np.array([len(w) for _, w, _ in waiting])
                flat = [x for _, w, _ in waiting for x in w]
                found, each = buckets_of(own, flat, np.cumsum(size) - size, np.array([s for *_, s in waiting]), n, buckets)
                parts.append(found.astype("<u2").tobytes())
                for (doc, *_), m in zip(waiting, each.tolist()):
                    features[doc] += m
                waiting.clear()
                own.trim()

        def whole():
            settle()
            row = [[docs], [counts], [features], [b"".join(parts)]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.list_(pa.int64()),) * 3 + (pa.binary(),))], names=["doc_ids", "n_words", "n_features", "stream"])
            for c in (docs, counts, features, parts):
                c.clear()
            return out

        words = held_words = 0
        for b in batches:
            for doc, raw in zip(b[key].to_pylist(), b["raw"]):
                docs.append(doc)
                counts.append(0)
                features.append(0)
                before: list[bytes] = []
                for some in split(raw.as_py()):
                    if some:
                        waiting.append((len(docs) - 1, before + some, len(before)))
                        counts[-1] += len(some)
                        words += len(some)
                        before = (before + some)[-(n - 1) :] if n > 1 else []
                    if words > WORDS:
                        settle()
                        held_words, words = held_words + words, 0
                if (held_words + words) * n > FEATURES or len(docs) >= 100_000:
                    yield whole()
                    words = held_words = 0
        if docs:
            yield whole()

    texts = rows.select(F.col(key).cast("long").alias(key), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return texts.mapInArrow(work, STREAMS)


def counts(packed: DataFrame) -> dict[int, int]:
    """How often each bucket occurs in streams: each is sorted and run-length encoded, and run lengths are summed."""

    def work(batches):
        for b in batches:
            for raw in b["stream"]:
                x = np.sort(np.frombuffer(raw.as_buffer(), "<u2"), kind="stable")
                begins = np.flatnonzero(np.diff(x.astype(np.int32), prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(x[begins].astype(np.int32)), pa.array(np.diff(begins, append=len(x)))], names=["bucket", "n"])

    runs = packed.select("stream").mapInArrow(work, "bucket int, n long")
    return {r["bucket"]: r["n"] for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # as many as there are buckets


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    all_s, all_t = sum(source.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda b: float((target.get(b, 0) + 1) * all_s) / float((source.get(b, 0) + 1) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int32)


def sums(stream: np.ndarray, sizes: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sum of the gains of each document of a stream, gathered some documents (or a part of a long one) at a time."""
    ends = np.cumsum(sizes)
    out, k = np.zeros(len(sizes), np.int64), 0
    while k < len(sizes):
        begin = int(ends[k] - sizes[k])
        last = max(k + 1, int(np.searchsorted(ends, begin + FEATURES, side="right")))
        if sizes[k] > FEATURES:
            out[k] = sum(int(gains[stream[a : min(a + FEATURES, ends[k])]].sum(dtype=np.int64)) for a in range(begin, int(ends[k]), FEATURES))
            last = k + 1
        else:
            some = k + np.flatnonzero(sizes[k:last])
            if len(some):
                out[some] = np.add.reduceat(gains[stream[begin : int(ends[last - 1])]], ends[some] - sizes[some] - begin, dtype=np.int64)
        k = last
    return out


def weights(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features) of each document of streams."""

    def work(batches):
        for b in batches:
            for docs, n_words, sizes, raw in zip(b["doc_ids"], b["n_words"], b["n_features"], b["stream"]):
                size = sizes.values.to_numpy()
                total = sums(np.frombuffer(raw.as_buffer(), "<u2"), size, gains)
                yield pa.RecordBatch.from_arrays([docs.values, n_words.values, sizes.values, pa.array(total // np.maximum(size, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """floor(1000 x) of a standard Gumbel number that the document's id and the seed fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank 1, 2, ... in an order, by one sort into ranges; each begins where those before end."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked")  # task, place in it
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    begins = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    return placed.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn("rank", F.col("_begin") + place + 1).drop("_part", "_begin", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, key: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row for each document; rank is null where it isn't drawn.

    Of the documents with at least `least` words, `percent` per cent (rounded down) with the highest scores are drawn.
    """
    packed = materialize(streams(docs, "doc_id", n, buckets), "streams")
    gains = gains_of(counts(packed), counts(materialize(streams(target, key, n, buckets), "streams")), buckets)
    scored = materialize(weights(packed, gains).withColumn("score", F.col("weight") + noise(seed)), "scored")
    wide = F.col("n_words") >= least
    drawn = percent * scored.where(wide).count() // 100
    rows = scored.where(wide).withColumn("_row", F.monotonically_increasing_id())  # spreads repeated rows
    placed = ranked(rows, [F.col("score").desc(), F.col("doc_id").asc(), F.col("_row").asc()]).drop("_row")
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(~wide).withColumn("rank", F.lit(None).cast("long")))


def sample(docs: DataFrame, target: DataFrame, **more) -> DataFrame:
    """The drawn documents, all columns, in no order; rows that share a drawn doc_id come together."""
    drawn = resample(docs, target, **more).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn.withColumnRenamed("doc_id", "_drawn"), F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
