"""Byte-level BPE: encode whole texts to token numbers and decode them again.

A word (piece of the pre-tokeniser's pattern) is a contiguous array of part boundaries with, beside each, the rank of
the merge of the part that begins there with its right neighbour.  Encoding scans the ranks for their minimum,
deletes the boundary behind it, refreshes the two ranks beside it, and ends when no merge is left.  That is quadratic
in the word, so words of more than ``SHORT`` bytes keep the same ranks in a heap instead.  Words repeat: each task
keeps the encodings of a bounded number of words.

Cases: a null text is empty and has no tokens; a long text is encoded whole, word by word; strings of the tokeniser's added tokens inside a text become those
tokens; ids that decode to no valid UTF-8 give U+FFFD; rows may repeat; columns besides doc_id and text are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.util import held

#: Fixed: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a word that is scanned, and words whose encodings a task keeps.
SHORT, KEEP = 64, 300_000
NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """Letter of each byte in the vocabulary file: itself if printable, else the next free letter from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Words(dict):
    """Encodings of words, made when they are first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word.encode())
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of a tokenizer.json that holds a byte-level BPE."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE")
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.table: dict[int, bytes] = {i: raw(s) for s, i in model["vocab"].items()}
        number = {b: i for i, b in self.table.items()}
        self.single = [number[bytes([b])] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        self.rank = {(number[a], number[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.joined = [number[a + b] for a, b in pairs]  # by rank
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with conditions")
        self.added = {s: (i,) for s, i in added.items()}
        self.table |= {i: s.encode() for s, i in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.kept = Words(self.word)

    def word(self, raw: bytes) -> tuple[int, ...]:
        parts = [self.single[b] for b in raw]
        if len(parts) > SHORT:
            return self.long_word(parts)
        rank = self.rank.get
        ranks = [rank(p, NONE) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NONE:
            k = ranks.index(low)
            parts[k] = left = self.joined[low]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank((left, parts[k + 1]), NONE)
            if k:
                ranks[k - 1] = rank((parts[k - 1], left), NONE)
        return tuple(parts)

    def long_word(self, parts: list[int]) -> tuple[int, ...]:
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := rank((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue
            parts[k], parts[j] = self.joined[low], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(p for p in parts if p >= 0)

    def encode(self, text: str) -> list[int]:
        if self.split and self.split.search(text):
            some = self.split.split(text)
            return [i for k, s in enumerate(some) for i in (self.added[s] if k % 2 else self.plain(s))]
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        out = list(chain.from_iterable(map(self.kept.__getitem__, self.pieces(text))))
        if len(self.kept) > KEEP:
            self.kept.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def codec(file: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return held(("codec", hash(file)), lambda: Codec(file))


#: Bytes of ids that a batch holds about.
BATCH = 2_000_000
KIND = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (text of the ids): one row for each input row. path: a tokenizer.json, read by the driver."""
    file = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def work(batches):
        own = codec(file.value)

        def batch(rows):
            flat = np.fromiter(chain.from_iterable(r[1] for r in rows), np.int32, sum(len(r[1]) for r in rows))
            ends = np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.array([r[2] for r in rows], pa.string())], schema=KIND)

        for b in batches:
            rows, held = [], 0
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = own.encode(text.as_py())
                rows.append((doc, ids, own.decode(ids)))
                held += len(ids)
                if held > BATCH:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
