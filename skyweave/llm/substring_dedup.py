"""Substring deduplication by super-k-mers: words covered by a window that also starts in a document of smaller id.

A window is ``length`` consecutive words of one document (words: runs of bytes other than ASCII white space).  Each
window has a minimiser, the first of its words in an order that puts long words first and hashes among equals.
Consecutive windows that share it travel as one packed string (words joined by a space) to its bucket; equal windows
have equal minimisers, so a bucket holds all copies of its windows, and sorting them there finds those that start in
more than one document.  Windows of equal hash are told apart by their words, so the result is exact.  A minimiser that
owns more than an eighth of a bucket's share of the windows, by a bounded sample, isn't one bucket: its windows travel by
their second smallest word too, which equal windows share as well.

Before anything moves, each task sorts the windows of its own chunk of documents: a window that a smaller document of
the chunk also has is settled there, and only the chunk's smallest document sends it on.  However many documents hold
a passage, its bucket gets it once per chunk.  A bucket sends back spans of word positions, keyed by doc_id and a
hash of the text, and a second pass over the texts removes what they cover.

Cases: a null text has no words; texts shorter than a window lose nothing; a text longer than a chunk is a chunk of its
own and is compared whole; rows with a null doc_id are never compared
and keep all words; rows that repeat a doc_id are documents of the same id, so neither removes from the other;
windows are judged on the input; columns besides doc_id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.util import buckets_for, expand, lean, materialize, mix64, roll, sliding_min, text_rows, word_hashes

#: Words of a chunk at most (a longer document is a chunk of its own).
CHUNK_WORDS = 500_000
#: Documents by which heavy minimisers are known, and the part of a bucket's share of all windows that makes one heavy.
SAMPLE, SPLIT = 2000, 8


def hashes(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))


def least_owner(text: bytes, words: tuple, starts: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each window the smallest doc (a number per window) of those with the same words.

    text: words joined by one space each; words: word_hashes(text); starts: first word of each window.
    """
    out = doc.copy()
    if not len(starts):
        return out
    begin, end, h = words
    key = roll(h, length)[starts]
    order = np.argsort(key)
    key = key[order]
    # Members of runs of more than one window; all others are their own smallest.
    member = np.zeros(len(order), bool)
    member[1:] = key[1:] == key[:-1]
    new = member.copy()
    member[:-1] |= new[1:]
    new = ~new[member]
    member = order[member]
    if len(member):
        # Words are equal if the bytes from the first to the last of them are.
        run = same_bytes(text, zip(begin[starts[member]].tolist(), end[starts[member] + length - 1].tolist(), new.tolist()))
        least = np.full(int(run.max()) + 1, np.iinfo(doc.dtype).max, doc.dtype)
        np.minimum.at(least, run, doc[member])
        out[member] = least[run]
    return out


def same_bytes(text: bytes, spans) -> np.ndarray:
    """A number for each span (begin, end, is first of a run of equal hashes); equal if they are of one run and have the same bytes."""
    out, n, own, head, others = [], -1, 0, b"", {}
    for a, b, new in spans:
        if new:
            n += 1
            own, head, others = n, text[a:b], {}
            out.append(own)
        elif text[a:b] == head:
            out.append(own)
        else:  # another window of the same hash
            if (piece := text[a:b]) not in others:
                n += 1
                others[piece] = n
            out.append(others[piece])
    return np.array(out, np.int64)


def merge(doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, begin, end) that windows at these word positions cover; doc, at sorted."""
    if not len(doc):
        return doc, at, at
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)
    k = np.flatnonzero(new)
    last = np.append(k[1:], len(doc)) - 1
    return doc[k], at[k], at[last] + length


def pack_spans(ids: np.ndarray, rks: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """(doc_id, rk, spans as int32 pairs) for each document."""
    if not len(doc):
        return
    k = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, b in zip(k, np.append(k[1:], len(doc))):
        yield int(ids[doc[a]]), int(rks[doc[a]]), np.stack([begin[a:b], end[a:b]], 1).astype("<i4").tobytes()


def priorities(size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order in which words serve as minimisers: long words, which are rare, before short ones; by hash among them."""
    kind = np.searchsorted([4, 6, 8], size, side="right").astype(np.uint64)
    return (h >> np.uint64(2)) | ((np.uint64(3) - kind) << np.uint64(62))


def steps(x: np.ndarray, kind: str) -> bytes:
    """Differences of neighbours, bytes of one weight side by side: what packs well."""
    d = np.diff(x, prepend=0).astype(kind)
    return d.view(np.uint8).reshape(-1, d.itemsize).T.tobytes()


def unsteps(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = int(kind[-1])
    planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return np.cumsum(np.ascontiguousarray(planes).view(kind).ravel(), dtype=np.int64)


def routes(rank: np.ndarray, starts: np.ndarray, length: int, heavy: np.ndarray) -> np.ndarray:
    """A number for each window that equal windows share: of its minimiser, or of its two smallest words if that is heavy."""
    out = sliding_min(rank, length)[starts]
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, out), len(heavy) - 1)
        for some in np.array_split(np.flatnonzero(heavy[at] == out), max(1, len(out) // 100_000)):
            words = rank[starts[some][:, None] + np.arange(length)]
            second = np.where(words == out[some][:, None], np.uint64(2**64 - 1), words).min(1)
            out[some] = mix64(out[some] ^ mix64(second))
    return out


class Sender:
    """What a task sends for one chunk of documents."""

    def __init__(self, length: int, buckets: int, heavy: np.ndarray):
        self.length, self.buckets, self.heavy, self.zip = length, buckets, heavy, zstandard.ZstdCompressor(level=3)

    def pack(self, docs, rks, doc, at, count, text: bytes) -> bytes:
        """Super-k-mers of one bucket: which document, which word position, how many windows; then all their words."""
        head = np.array([len(docs), len(doc)], "<i8").tobytes() + docs.astype("<i8").tobytes() + rks.astype("<i8").tobytes()
        return self.zip.compress(head + steps(doc, "<i4") + steps(at, "<i4") + steps(count, "<i4") + text)

    def chunk(self, rows: list[tuple[int, int, bytes, int]]):
        """(bucket, doc_id, rk, payload): a blob of super-k-mers, or with bucket -1 the spans that are settled here."""
        length = self.length
        rows = sorted(r for r in rows if r[3])
        text = b" ".join([r[2] for r in rows])
        docs, rks, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3))
        begins = np.cumsum(n) - n
        each = np.maximum(n - length + 1, 0)
        starts = expand(begins, each)
        if not len(starts):
            return
        owner = np.repeat(np.arange(len(rows)), each)
        words = word_hashes(text)
        settled = docs[owner] > least_owner(text, words, starts, docs[owner], length)
        doc, at = owner[settled], starts[settled] - begins[owner[settled]]
        for i, r, spans in pack_spans(docs, rks, *merge(doc, at, length)):
            yield -1, i, r, spans
        starts, owner = starts[~settled], owner[~settled]
        least = routes(priorities(words[1] - words[0], words[2]), starts, length, self.heavy)
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        k = np.flatnonzero(new)
        count = np.diff(np.append(k, len(starts)))
        begin, owner, bucket = starts[k], owner[k], (mix64(least[k]) % np.uint64(self.buckets)).astype(np.int64)
        del starts, least
        order = np.argsort(bucket, kind="stable")
        begin, owner, count, bucket = begin[order], owner[order], count[order], bucket[order]
        low, high = words[0][begin].tolist(), words[1][begin + count + length - 2].tolist()
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(bucket))):
            strings = b" ".join([text[x:y] for x, y in zip(low[a:b], high[a:b])])
            known, doc = np.unique(owner[a:b], return_inverse=True)
            yield int(bucket[a]), None, None, self.pack(docs[known], rks[known], doc, begin[a:b] - begins[owner[a:b]], count[a:b], strings)


SENT = "bucket long, doc_id long, rk long, payload binary"
SENT_KIND = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("payload", pa.binary())])
SPANS = "doc_id long, rk long, payload binary"
SPANS_KIND = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("payload", pa.binary())])


def heavy_minimisers(rows: DataFrame, length: int, buckets: int) -> np.ndarray:
    """Minimisers that hold a share of the windows that a bucket should not, by a sample of about SAMPLE documents.

    They only decide by which words windows travel, so any list gives the same result; it has SPLIT * buckets numbers at most.
    """
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "rk"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def work(batches):
        for b in batches:
            for raw in b["raw"]:
                words = word_hashes(b" ".join(raw.as_py().split()))
                if len(words[0]) >= length:
                    least, times = np.unique(sliding_min(priorities(words[1] - words[0], words[2]), length), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(times)], names=["word", "n"])

    counts = drawn.select("raw").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = materialize(counts, "minimisers")
    all_ = found.agg(F.sum("n")).first()[0] or 0
    big = found.where(F.col("n") * SPLIT * buckets >= F.lit(max(all_, SPLIT * buckets))).select("word").collect()
    return np.sort(np.array([r["word"] for r in big], np.int64).view(np.uint64))


def send(length: int, buckets: int, heavy: np.ndarray):
    def work(batches):
        lean()
        sender, rows, words = Sender(length, buckets, heavy), [], 0

        def flush():
            out = list(sender.chunk(rows))
            rows.clear()
            for i in range(0, len(out), 2000):
                cols = list(zip(*out[i : i + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SENT_KIND)], schema=SENT_KIND)

        for b in batches:
            for doc, rk, raw in zip(b["doc_id"].to_pylist(), b["rk"].to_pylist(), b["raw"]):
                if doc is None:
                    continue
                w = raw.as_py().split()
                if rows and words + len(w) > CHUNK_WORDS:
                    yield from flush()
                    words = 0
                rows.append((doc, rk, b" ".join(w), len(w)))
                words += len(w)
        yield from flush()

    return work


def unpack(payload: bytes):
    raw = zstandard.ZstdDecompressor().decompress(payload)
    nd, nk = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    at = 16 + 16 * nd
    docs, rks = np.frombuffer(raw, "<i8", nd, 16), np.frombuffer(raw, "<i8", nd, 16 + 8 * nd)
    return docs, rks, *(unsteps(raw, "<i4", nk, at + 4 * nk * k) for k in range(3)), raw[at + 12 * nk :]


def settle(payloads: list[bytes], length: int):
    """Spans of a bucket: windows whose words also start in a document with a smaller id."""
    docs, rks, doc, at, count, texts, base = [], [], [], [], [], [], 0
    for p in payloads:
        d, r, owner, a, c, text = unpack(p)
        docs.append(d), rks.append(r), doc.append(owner + base), at.append(a), count.append(c), texts.append(text)
        base += len(d)
    text = b" ".join(texts)
    del texts
    docs, rks, doc, at, count = map(np.concatenate, (docs, rks, doc, at, count))
    words = count + length - 1
    starts = expand(np.cumsum(words) - words, count)
    ids_of = docs[np.repeat(doc, count)]
    found = ids_of > least_owner(text, word_hashes(text), starts, ids_of, length)
    owner, place = np.repeat(doc, count)[found], expand(at, count)[found]
    # One document may come in several blobs: number it once.
    order = np.lexsort((rks, docs))
    new = np.append(True, (docs[order][1:] != docs[order][:-1]) | (rks[order][1:] != rks[order][:-1]))
    number = np.empty(len(docs), np.int64)
    number[order] = np.cumsum(new) - 1
    owner, docs, rks = number[owner], docs[order][new], rks[order][new]
    order = np.lexsort((place, owner))
    yield from pack_spans(docs, rks, *merge(owner[order], place[order], length))


def receive(length: int):
    def work(batches):
        lean()

        def rows():
            held, bucket = [], None
            for b in batches:
                for k, doc, rk, payload in zip(b["bucket"].to_pylist(), b["doc_id"].to_pylist(), b["rk"].to_pylist(), b["payload"]):
                    if k < 0:
                        yield doc, rk, payload.as_py()
                        continue
                    if k != bucket and held:
                        yield from settle(held, length)
                        held = []
                    bucket = k
                    held.append(payload.as_py())
            if held:
                yield from settle(held, length)

        out = []
        for r in rows():
            out.append(r)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SPANS_KIND)], schema=SPANS_KIND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SPANS_KIND)], schema=SPANS_KIND)

    return work


def repeated_spans(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, rk (hash of the text), payload (pairs of little-endian int32: word spans to remove)."""
    buckets, rows = buckets_for(docs.sparkSession, 3), text_rows(docs).where("doc_id IS NOT NULL")
    sent = rows.mapInArrow(send(length, buckets, heavy_minimisers(rows, length, buckets)), SENT)
    # Spans that are settled already need no bucket: they spread by document.
    key = F.when(F.col("bucket") < 0, F.xxhash64("doc_id", "rk")).otherwise(F.xxhash64("bucket"))
    dealt = sent.withColumn("deal", key).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "deal").sortWithinPartitions("bucket")
    return dealt.select("bucket", "doc_id", "rk", "payload").mapInArrow(receive(length), SPANS)


KEPT = "doc_id long, n_words long, n_removed long, kept string"
KEPT_KIND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def remove(batches):
    for b in batches:
        out, held = [], 0
        for doc, raw, spans in zip(b["doc_id"].to_pylist(), b["raw"], b["spans"]):
            words = raw.as_py().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans.as_py() or ():
                pairs = np.frombuffer(s, "<i4")
                np.add.at(gone, pairs[0::2], 1)
                np.add.at(gone, pairs[1::2], -1)
            cover = np.cumsum(gone[:-1]) > 0
            n = int(cover.sum())
            kept = b" ".join(words if not n else [words[k] for k in np.flatnonzero(~cover).tolist()])
            out.append((doc, len(words), n, kept))
            held += len(kept)
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), KEPT_KIND)], schema=KEPT_KIND).cast(TEXT_KIND)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), KEPT_KIND)], schema=KEPT_KIND).cast(TEXT_KIND)


TEXT_KIND = pa.schema([(f.name, pa.string() if f.name == "kept" else f.type) for f in KEPT_KIND])


def deduplicate(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that stays, words joined by a space): one row for each input row."""
    spans = repeated_spans(docs, length).groupBy("doc_id", "rk").agg(F.collect_list("payload").alias("spans"))
    rows = text_rows(docs)
    # The spans of a partition fit a hash table, so the texts need no sort.
    both = rows.join(spans.hint("shuffle_hash"), ["doc_id", "rk"], "left").select("doc_id", "raw", "spans")
    return both.mapInArrow(remove, KEPT)


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int | None, str | None]], length: int = 13) -> list[tuple]:
    """The same by a plain table of all windows (for tests)."""
    least: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - length + 1):
                least[tuple(w[k : k + length])] = min(i, least.get(tuple(w[k : k + length]), i))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - length + 1) if i is not None and least[tuple(w[k : k + length])] < i for j in range(length)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
