"""Benchmark decontamination: passages of documents that resemble a benchmark item.

Texts are lower-cased words without punctuation.  An item of L words is compared with windows of L consecutive words,
and a document of fewer words than that as a whole.
Each window has a SimHash of BITS bits: the signs of the sums of its shingles' hash bits, a shingle counting as often as
it occurs.  Fingerprints of items lie in a multi-index of blocks of 16 bits.  If two fingerprints differ in at most
`radius` bits, they differ in at most t bits in one of the blocks at least, for any t of the blocks with
sum(t + 1) > radius; so looking up each block's value with up to t bits flipped, and then the full distance, finds all
of them (`limits`).  Candidates are verified by the exact similarity of the two bags of shingles (sum of minima over sum
of maxima).

A window that shares no shingle with an item has similarity 0, so fingerprints are made only for windows that hold a
shingle of some item of their size, once for windows of one bag, and in pieces of PIECE windows, so that memory doesn't
grow with a text that repeats itself.

The benchmark is a query set: it goes to all tasks in blocks of about BLOCK items and BLOCK_BYTES bytes at most, one
pass over the documents each, so a task's memory doesn't grow with it.  A worker process makes a block's index once.

Cases: items without words match nothing; items of fewer words than a shingle are one shingle; null texts have no
words; null ids are kept as they are; repeated documents and items are each reported; very long texts are searched
whole, alone in their portion; `hits` ignores columns besides doc_id and text, and `filter_clean` keeps them; of windows
that tie the first is reported; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.substring_dedup import hashes
from skyweave.llm.util import expand, held, mix64, roll, word_ids

BLOCK, BLOCK_BYTES, SHINGLE, PERCENT = 20_000, 1 << 24, 5, 80
#: Bits of a fingerprint, and the distance that is searched: at similarity 0.8 the distance has mean 39 and deviation 6.
BITS, RADIUS = 256, 60
#: Windows of a text that are summed in one go, and windows that are looked up in one go.
PIECE, LOOKUP = 8192, 64
PUNCTUATION = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Words of documents that are hashed together.
CHUNK_WORDS = 1_000_000


def plain(word: bytes) -> bytes:
    return PUNCTUATION.sub(b"", word.lower())


def shingle_bag(words: list[bytes], n: int) -> Counter:
    return Counter(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(c, b[s]) for s, c in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def signs(shingles: np.ndarray) -> np.ndarray:
    """(n, BITS) of +1 and -1."""
    words = np.stack([mix64(shingles + np.uint64(k)) for k in range(BITS // 64)], 1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) of sums (n, BITS)."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def limits(radius: int, blocks: int = BITS // 16) -> list[int]:
    """Bits that are flipped in each block: sum(t + 1) = radius + 1, so a distance within the radius can't pass t in all."""
    low, more = divmod(radius + 1, blocks)
    return [low + (k < more) - 1 for k in range(blocks)]


def masks(t: int) -> np.ndarray:
    """All 16-bit numbers of at most t bits; none for t < 0."""
    all_ = np.arange(1 << 16, dtype=np.uint16)
    return all_[np.bitwise_count(all_) <= t] if t >= 0 else all_[:0]


class Index:
    """Items of one block, by size."""

    def __init__(self, items: list[tuple[int, str]], n: int, radius: int, percent: int):
        self.n, self.radius, self.percent = n, radius, percent
        self.ids, self.words, self.bags = [], [], []
        for item, text in items:
            if w := [p for x in (text or "").encode().split() if (p := plain(x))]:
                self.ids.append(item)
                self.words.append(w)
                self.bags.append(shingle_bag(w, n))
        # Shingle width of an item, and its size in words, say which windows it meets.
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            self.by_size[len(w)].append(k)
        self.prints, own = np.zeros((len(self.words), BITS // 64), np.uint64), {}
        for size, ks in self.by_size.items():
            width = min(n, size)
            for k in ks:
                ids, vocabulary = word_ids(self.words[k])
                s = mix64(roll(hashes(vocabulary)[ids], width))
                # In pieces too, as an item may be long.
                self.prints[k] = fingerprint(sum(signs(s[i : i + PIECE]).sum(0) for i in range(0, len(s), PIECE))[None])[0]
                own.setdefault(width, defaultdict(set))
                for x in s.tolist():
                    own[width][x].add(size)
        self.size = np.array([len(w) for w in self.words], np.int64)
        # A table for each block: the items in the order of their values, and where each value begins.
        values = self.prints.view(np.uint16)
        self.order = [np.argsort(values[:, j], kind="stable") for j in range(values.shape[1])]
        self.begin = [np.searchsorted(values[o, j], np.arange((1 << 16) + 1)).astype(np.int32) for j, o in enumerate(self.order)]
        self.flips = [masks(t) for t in limits(radius)]
        self.shingles = {w: np.array(sorted(x), np.uint64) for w, x in own.items()}
        # for each width the item sizes of its shingles, one after the other, and where each shingle's begin
        self.sizes = {w: np.array([z for s in sorted(x) for z in sorted(x[s])], np.int64) for w, x in own.items()}
        self.sizes_at = {w: np.cumsum([0, *(len(x[s]) for s in sorted(x))]) for w, x in own.items()}
        self.bits = {w: self.filter(x) for w, x in self.shingles.items()}

    @staticmethod
    def filter(shingles: np.ndarray) -> np.ndarray:
        """One bit per prefix of 22 bits, to pass over most shingles of documents at once."""
        out = np.zeros(1 << 22, bool)
        out[(shingles >> np.uint64(42)).astype(np.int64)] = True
        return out

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of distinct pairs that some block brings together."""
        found = []
        for j, (order, begin, flips) in enumerate(zip(self.order, self.begin, self.flips)):
            value = (prints.view(np.uint16)[:, j, None] ^ flips).astype(np.int64)
            many = begin[value + 1] - begin[value]
            window, at = np.nonzero(many)
            count = many[window, at].astype(np.int64)
            items = order[expand(begin[value[window, at]].astype(np.int64), count)]
            found.append(np.repeat(window, count) * len(self.size) + items)
        pair = np.unique(np.concatenate(found))
        return pair // len(self.size), pair % len(self.size)

    def near(self, size: int, prints: np.ndarray):
        """(window, items of this size within the radius) of each window that has any."""
        for i in range(0, len(prints), LOOKUP):
            some = prints[i : i + LOOKUP]
            window, item = self.candidates(some)
            good = self.size[item] == size
            window, item = window[good], item[good]
            good = distances(self.prints[item], some[window]) <= self.radius
            window, item = window[good], item[good]
            for a, b in zip(*(lambda c: (c, np.append(c[1:], len(window))))(np.flatnonzero(np.diff(window, prepend=-1)))):
                yield i + int(window[a]), item[a:b]

    @staticmethod
    def prints_of(s: np.ndarray, first: np.ndarray, m: int):
        """(starts, fingerprints) of windows of m shingles, some at a time: running sums over what a piece of them spans."""
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(first, first[i] + PIECE)))
            low, high = int(first[i]), int(first[j - 1]) + m
            total = np.zeros((1, BITS), np.int32)
            if j - i == 1:  # a window may be long: only its sum is kept
                for k in range(low, high, PIECE):
                    total = total + signs(s[k : min(high, k + PIECE)]).sum(0)
                yield first[i:j], fingerprint(total)
            else:
                # The sum of the first window in pieces, then what enters and leaves from one window to the next.
                for k in range(low, low + m, PIECE):
                    total = total + signs(s[k : min(low + m, k + PIECE)]).sum(0)
                steps = signs(s[low + m : high]) - signs(s[low : high - m])
                sums = np.concatenate([total, total + np.cumsum(steps, 0, dtype=np.int32)])
                yield first[i:j], fingerprint(sums[first[i:j] - low])
            i = j

    def search(self, texts: list[list[bytes]]):
        """(text, item, similarity, first word, words) for each item that resembles a window of a text: its best, first window."""
        tokens = [w for t in texts for w in t]
        if not tokens or not self.ids:
            return
        ids, vocabulary = word_ids(tokens)
        bare = [plain(w) for w in vocabulary]
        there = np.array([bool(w) for w in bare])[ids]
        h = hashes(bare)[ids][there]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[there]
        words = [bare[k] for k in ids[there].tolist()]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
        end = np.searchsorted(owner, np.arange(len(texts)), side="right")
        begin = np.searchsorted(owner, np.arange(len(texts)))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}

        def verify(x: int, length: int, ks: np.ndarray) -> None:
            bag = shingle_bag(words[x : x + length], self.n)
            for k in ks.tolist():
                alike = similarity(bag, self.bags[k])
                key = int(owner[x]), k
                if 100 * alike >= self.percent - 1e-9 and alike > best.get(key, (0.0, 0, 0))[0]:
                    best[key] = alike, int(place[x]), length

        for width, known in self.shingles.items():
            s = mix64(roll(h, width))
            if not len(s):
                continue
            maybe = np.flatnonzero(self.bits[width][(s >> np.uint64(42)).astype(np.int64)])
            at = np.searchsorted(known, s[maybe])
            hit = known[np.minimum(at, len(known) - 1)] == s[maybe]
            maybe, at = maybe[hit], at[hit]
            maybe_ok = owner[maybe] == owner[maybe + width - 1]
            maybe, at = maybe[maybe_ok], at[maybe_ok]
            starts: dict[int, np.ndarray] = {}
            whole: dict[int, set] = defaultdict(set)
            begins = self.sizes_at[width]
            many = begins[at + 1] - begins[at]
            met, of = self.sizes[width][expand(begins[at], many)], np.repeat(maybe, many)
            by = np.lexsort((of, met))
            met, of = met[by], of[by]
            cuts = np.flatnonzero(np.diff(met, prepend=-1))
            for size, x in zip(met[cuts].tolist(), np.split(of, cuts[1:])):
                room = end[owner[x]] - begin[owner[x]]
                # The smaller bag's share of the larger one bounds the similarity of a document shorter than the item.
                short = (room < size) & (100 * (room - width + 1) >= self.percent * (size - width + 1) - 1e-9)
                for d in np.unique(owner[x[short]]).tolist():
                    whole[d].add(size)
                x = x[room >= size]
                low, high = np.maximum(begin[owner[x]], x - size + width), np.minimum(x, end[owner[x]] - size)
                if len(x):  # each start once: what the hits before have begun is left out
                    low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)
                    starts[size] = expand(low, np.maximum(high - low + 1, 0))
            bags = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s))])  # sums tell equal bags
            for size, some in starts.items():
                first, m = some, size - width + 1
                # Windows of a document that hold the same bag have one fingerprint and one similarity: the first stands for them.
                key = np.stack([owner[first].astype(np.uint64), bags[first + m] - bags[first]], 1)
                first = np.sort(first[np.unique(key, axis=0, return_index=True)[1]]) if len(first) else first
                for x, prints in self.prints_of(s, first, m):
                    for k, ks in self.near(size, prints):
                        verify(int(x[k]), size, ks)
            for d, some in whole.items():
                x, length = int(begin[d]), int(end[d] - begin[d])
                own_print = next(self.prints_of(s, np.array([x]), length - width + 1))[1]
                for size in sorted(some):
                    for _, ks in self.near(size, own_print):
                        verify(x, length, ks)
        for (d, k), (alike, x, length) in sorted(best.items()):
            yield d, self.ids[k], alike, x, length


def index_of(key: str, items: list, n: int, radius: int, percent: int) -> Index:
    """One index for each worker process and block of items."""
    return held(("index", key, n, radius, percent), lambda: Index(items, n, radius, percent))


def blocks(benchmark: DataFrame):
    """The items, about BLOCK items and BLOCK_BYTES bytes at a time at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    seen = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-seen["n"] // BLOCK), -(-(seen["bytes"] or 0) // BLOCK_BYTES))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def portions(batch: pa.RecordBatch, column: str):
    """(begin, words of each text) of slices of a batch of about CHUNK_WORDS words."""
    texts, begin, held = [], 0, 0
    for k, x in enumerate(batch[column]):
        w = (x.as_py() or b"").split()
        if texts and held + len(w) > CHUNK_WORDS:
            yield begin, texts
            texts, begin, held = [], k, 0
        texts.append(w)
        held += len(w)
    if texts:
        yield begin, texts


def hits(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, radius: int = RADIUS, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: one row for each document and item that it resembles; n_words: words of the window; first_word counts words that hold more than punctuation."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    out = None
    for items in blocks(benchmark):
        sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def work(batches, sent=sent, key=key):
            index = index_of(key, sent.value, n, radius, percent)
            for b in batches:
                ids = b["doc_id"].to_pylist()
                for begin, texts in portions(b, "raw"):
                    found = [(ids[begin + d], *rest) for d, *rest in index.search(texts)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        own = rows.mapInArrow(work, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = own if out is None else out.unionByName(own)
    return out


def filter_clean(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, radius: int = RADIUS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that resemble no item, with their columns."""
    for items in blocks(benchmark):
        sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def work(batches, sent=sent, key=key):
            index = index_of(key, sent.value, n, radius, percent)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                raw = pa.RecordBatch.from_arrays([b["text"].cast(pa.binary())], names=["raw"])
                for begin, texts in portions(raw, "raw"):
                    for d, *_ in index.search(texts):
                        keep[begin + d] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def brute(docs: list[tuple], items: list[tuple], n: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """All windows against all items (for tests)."""
    out = []
    for doc, text in docs:
        w = [p for x in (text or "").encode().split() if (p := plain(x))]
        for item, said in items:
            v = [p for x in (said or "").encode().split() if (p := plain(x))]
            if v:
                bag = shingle_bag(v, n)
                alike = [similarity(shingle_bag(w[k : k + len(v)], n), bag) for k in range(max(1, len(w) - len(v) + 1))]
                if alike and 100 * max(alike) >= percent - 1e-9:
                    out.append((doc, item, max(alike), alike.index(max(alike)), min(len(v), len(w))))
    return out
