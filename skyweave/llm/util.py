"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyweave.storage import forget, materialize

#: Rows of a broadcast table of hot keys at most: a key is hot if it holds at least this share of all rows.
HOT_KEYS = 1000


def buckets_for(spark: SparkSession, times: int = 4) -> int:
    """How many buckets a keyed Python stage deals its blobs to: some for each shuffle partition of the session."""
    return max(16, times * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def plan_bytes(df: DataFrame) -> int:
    """What the optimiser knows of the bytes that a table's scan reads; an estimate that only chooses sizes."""
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(plan.apply(k).stats().sizeInBytes()) for k in range(plan.size())]
    return sum(s for s in sizes if s < 1 << 60)


def broadcast_bytes(spark: SparkSession) -> int:
    """Up to which size the session broadcasts a table of a join."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def text_rows(docs: DataFrame, *more) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null: empty) and a hash of the text, which tells rows with one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rk"), text.cast("binary").alias("raw"), *more)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive elements, in log2(w) vector steps."""
    have, out = 1, a
    while 2 * have <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that order and remainders of hashes look random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def roll(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each k consecutive elements."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, p = h[:m].copy(), np.uint64(base | 1)
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out *= p
            out += h[i : i + m]
    return out


#: What the operator that ran last in this worker process keeps between tasks.
_held: dict = {}


def held(key, make):
    """What make() gives, kept for later tasks of the same operator; one operator's at a time, as workers serve many."""
    if key not in _held:
        lean()
        _held[key] = make()
    return _held[key]


def lean() -> None:
    """Give back what other operators' tasks left in this worker process."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of text whose hashes are summed in one go, the multiplier of the weights of their places, and that of a second hash.
RUN, PLACE, OTHER = 1 << 20, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of a word that is hashed as a sum; in longer words sums modulo 2**64 can be equal by construction.
SUMMED = 128
_places: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def places(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k to n at least."""
    if base not in _places or len(_places[base][0]) <= n:
        size = max(n, RUN) + 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _places[base] = out[0], out[1]
    return _places[base]


def word_hashes(text: bytes, base: int = PLACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, end, hash of the words of a text whose words are joined by one space each.

    The hash of a word is the sum of its bytes, each times a power of base for its place: differences of running
    sums over the whole text, so it costs a few vector steps a byte and no Python step a word.  Words of more than
    SUMMED bytes are hashed by XXH3, with base as its seed.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    h, i = np.empty(len(begin), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + RUN, side="right")))
            low, high = int(begin[i]), int(end[j - 1])
            up, down = places(base, high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
            h[i:j] = (sums[end[i:j] - low] - sums[begin[i:j] - low]) * down[begin[i:j] - low]
            i = j
        h += (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in np.flatnonzero(end - begin > SUMMED).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[begin[k] : end[k]], base)
    return begin, end, mix64(h)


def word_ids(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """An exact number for each distinct token, and the distinct tokens in the order of their numbers."""
    seen: defaultdict = defaultdict()
    seen.default_factory = seen.__len__
    ids = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
    return ids, list(seen)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + c)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def join_hot(rows: DataFrame, table: DataFrame, key: str, n_rows: int, size: str) -> DataFrame:
    """Inner join of rows with a table of one row per key; table[size] is how many rows have the key.

    Keys that hold at least 1 / HOT_KEYS of the rows are HOT_KEYS at most: their rows meet a broadcast table and are
    not moved, so that no task gets the rows of a hot key.
    """
    hot = (F.col(size) > 1) & (F.col(size) * HOT_KEYS >= F.lit(max(n_rows, HOT_KEYS + 1)))
    few = table.where(hot)
    by_hot = rows.join(F.broadcast(few), key)
    by_key = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.where(~hot), key)
    return by_hot.unionByName(by_key)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, root for each vertex of the edges: root is the smallest vertex that v reaches.

    Alternating large and small stars: every round hangs the neighbours of a vertex on the smallest of them, so the
    graph flattens to stars in a few rounds.  Minima are partial aggregates and come back by joins, so a vertex of
    many edges isn't gathered in a task; each round is written to the shared folder.
    """
    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, and what tells whether a round changed them, seen on the way."""
        seen = Observation()
        out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "edges")
        return out, (seen.get["n"], seen.get["s"])

    now, state = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    while state[0] and state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, before, (now, state) = now, state, written(small)
        forget(old)  # the next round stands on what was just written
    roots = now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
