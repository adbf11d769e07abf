"""Token ids in binary files: patched frame-of-reference blocks with an index of documents and blocks.

A table's texts are dealt to tasks by ranges of doc_id, encoded with a public tokenizer, ended by an end id, and written
as files of a bounded number of ids in ascending doc_id order.  A file holds, little-endian:

* a head (``HEAD``): magic, version, ids a block, place of the file in the order of all files, documents, ids, blocks,
  bytes of the body, CRC-32 of all that follows;
* the documents: a byte that tells whether doc_id is given, doc_id (8 bytes), number of ids (4 bytes), each as a column;
* the blocks: minimum (4 bytes), width (1), exceptions (1), start in the body (8), each as a column;
* the body: for each block of 128 ids the differences to the minimum, packed at the width that holds ``PERCENT`` per
  cent of them, then the places of the others (a byte each) and their bits above the width (4 bytes each).

The block index lets ``TokenFile.ids(begin, end)`` unpack only the blocks that it needs.  Files are written by Spark's
text writer, one row a file (so they end with a line feed) and committed with the job, and read by ``binaryFile``: any
store will do, and a lost executor costs its tasks only.

Text is encoded in pieces between blanks, each distinct piece once: this tokenizer drops white space and its pattern
never looks across it, so pieces give the ids of the whole text (``Encoder`` refuses tokenizers of other kinds).  A plain
word goes to the library's model at once, since its normaliser and pattern would leave it as it is.

Cases: a null text is empty and has the end id alone; rows without doc_id come first; rows with one doc_id follow each
other by a hash of the text and each keep their ids; a long text is encoded by pieces and lies whole in one file; added
tokens' strings in a text become these tokens, as in the library; columns besides doc_id and text are ignored; an
empty table gives a folder without files and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.llm.bpe import byte_letters, read_file
from skyweave.llm.util import expand, held, materialize

#: Ids a block, the share of a block's ids that its width holds, and ids a file holds about.
BLOCK, PERCENT, FILE_IDS = 128, 90, 4_000_000
#: magic, version, ids a block, part, file of the part, documents, ids, blocks, bytes of the body, checksum of what follows.
HEAD = struct.Struct("<4sHHIIIQIQI")
MAGIC = b"PFOR"
DOCUMENT = [("u1", 1), ("<i8", 8), ("<u4", 4)]
INDEX = [("<u4", 4), ("u1", 1), ("u1", 1), ("<u8", 8)]


def bits(x: np.ndarray) -> np.ndarray:
    """Bits that hold each number below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def squeeze(rows: np.ndarray, width: int) -> np.ndarray:
    """(m, BLOCK) numbers below 2**width as (m, bytes): number after number, lowest bits first."""
    columns = np.ascontiguousarray(rows.T.astype(np.uint64))
    out = np.zeros((width * BLOCK // 64, rows.shape[0]), np.uint64)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(rows.shape[0], -1)


def spread(packed: np.ndarray, width: int) -> np.ndarray:
    """What squeeze() took."""
    out = np.zeros((BLOCK, packed.shape[0]), np.uint64)
    words, mask = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T).astype(np.uint64) if width else None, np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= words[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return out.T


def pack(ids: np.ndarray, percent: int = PERCENT) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the block index, and the body, of ids (below 2**32)."""
    if not len(ids):
        return [np.zeros(0, kind) for kind, _ in INDEX], np.zeros(0, np.uint8)
    m = -(-len(ids) // BLOCK)
    x = np.full(m * BLOCK, ids[-1], np.uint32)
    x[: len(ids)] = ids
    x = x.reshape(m, BLOCK)
    least = x.min(1)
    x = x - least[:, None]
    k = -(-BLOCK * percent // 100) - 1
    width = bits(np.partition(x, k, axis=1)[:, k])
    above = (x.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    row, place = np.nonzero(above)
    patches = np.bincount(row, minlength=m)
    size = width * (BLOCK // 8) + 5 * patches
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            low = x[own] & np.uint32((1 << w) - 1)
            body[start[own][:, None] + np.arange(w * BLOCK // 8)] = squeeze(low, w)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    at = start[row] + width[row] * (BLOCK // 8)
    body[at + nth] = place
    body[(at + patches[row] + 4 * nth)[:, None] + np.arange(4)] = above[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return [least, width, patches, start], body


def unpack(index: list[np.ndarray], body: np.ndarray) -> np.ndarray:
    """Ids of the blocks of an index whose starts count from the body's begin; whole blocks."""
    least, width, patches, start = (c.astype(np.int64) for c in index)
    out = np.zeros((len(least), BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            out[own] = spread(body[start[own][:, None] + np.arange(w * BLOCK // 8)], w)
    row = np.repeat(np.arange(len(least)), patches)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    at = start[row] + width[row] * (BLOCK // 8)
    high = body[(at + patches[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    out[row, body[at + nth]] |= high.astype(np.uint64) << width[row].astype(np.uint64)
    return (out + least.astype(np.uint64)[:, None]).astype("<u4").reshape(-1)


#: Ids that are packed in one go, whole blocks.
PACKED = BLOCK << 13


def file_bytes(part: int, seq: int, docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    packed = [pack(ids[k : k + PACKED]) for k in range(0, max(1, len(ids)), PACKED)]
    bodies = [b for _, b in packed]
    begins = np.cumsum([0, *map(len, bodies)])
    for (index, _), begin in zip(packed, begins):
        index[3] = index[3] + begin
    index, body = [np.concatenate(c) for c in zip(*(i for i, _ in packed))], np.concatenate(bodies)
    columns = [[d is not None for d in docs], [d or 0 for d in docs], counts]
    rest = b"".join(np.asarray(c).astype(kind).tobytes() for c, (kind, _) in zip([*columns, *index], DOCUMENT + INDEX)) + body.tobytes()
    return HEAD.pack(MAGIC, 1, BLOCK, part, seq, len(docs), len(ids), len(index[0]), len(body), zlib.crc32(rest)) + rest


class TokenFile:
    """A file's documents and, by its block index, any range of its ids; a damaged file raises ValueError."""

    def __init__(self, content: bytes):
        magic, version, block, self.part, self.seq, n, self.n_ids, m, body, check = HEAD.unpack_from(content)
        size = HEAD.size + n * sum(b for _, b in DOCUMENT) + m * sum(b for _, b in INDEX) + body
        if (magic, version, block) != (MAGIC, 1, BLOCK) or len(content) < size or zlib.crc32(memoryview(content)[HEAD.size : size]) != check:
            raise ValueError(f"file {self.part}, {self.seq}: not the bytes that were written")
        at, columns = HEAD.size, []
        for rows, kinds in ((n, DOCUMENT), (m, INDEX)):
            for kind, width in kinds:
                columns.append(np.frombuffer(content, kind, rows, at))
                at += rows * width
        self.known, self.doc_ids, self.counts, *self.index = columns
        self.body = np.frombuffer(content, np.uint8, body, at)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end - 1 of the file, from the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, "<u4")
        a, b = begin // BLOCK, -(-end // BLOCK)
        starts = self.index[3]
        low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(self.body)
        some = [c[a:b] for c in self.index[:3]] + [starts[a:b] - np.uint64(low)]
        return unpack(some, self.body[low:high])[begin - a * BLOCK : end - a * BLOCK]


#: Bytes of texts that are encoded at a time, and pieces whose ids a task keeps.
PORTION, KEEP = 1 << 21, 450_000
#: A word of Latin letters, which normalising only lower-cases and the pattern leaves whole, between marks that it parts from it.
PLAIN = r"""^(?P<before>[("]*)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>[.,;:!?)"]*)$"""
#: Fixed: the pattern that PLAIN knows.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of pieces between blanks, by the tokenizers library, kept for pieces that come again."""

    def __init__(self, file: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(file)
        added = [t["content"] for t in spec["added_tokens"]]
        split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if not split or split[0]["behavior"] != "Removed" or not split[0]["invert"] or any(" " in a or "\n" in a for a in added) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("the tokenizer doesn't drop white space, so texts can't be encoded by pieces")
        self.own, self.end_id = Tokenizer.from_str(file), end_id
        self.own.no_truncation()
        self.own.no_padding()
        self.model = self.own.model
        self.letters = {b: c for c, b in byte_letters().items()}
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.direct = kinds == ["NFC", "Replace", "Lowercase"] and split[0]["pattern"].get("Regex") == WORDS
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.size, self.start, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.slots([""], False)  # number 0: nothing

    def word(self, word: str) -> list[int]:
        """Ids of a lower-case word of Latin letters, by the library's model alone."""
        text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(text)]

    def slots(self, pieces: list[str], words: bool) -> np.ndarray:
        """Numbers of pieces, whose ids are `size` ids of `flat` from `start` on; they hold until the next call of trim()."""
        known = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if new := list(islice(self.number, known, None)):
            found = list(map(self.word, new)) if words else [self.own.encode(p, add_special_tokens=False).ids for p in new]
            self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found))])
            self.start = np.cumsum(self.size) - self.size
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32)])
            self.held += sum(map(len, new))
        return out

    def trim(self) -> None:
        if len(self.number) > KEEP or self.held > 32 * KEEP:
            self.clear()

    def pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and how many each has.  A plain word is its own piece, apart from its marks and its case."""
        parts = np.zeros((len(distinct), 3), np.int64)
        found = pc.extract_regex(distinct, PLAIN) if self.direct else None
        plain = found.is_valid().to_numpy(zero_copy_only=False) if self.direct else np.zeros(len(distinct), bool)
        if plain.any():
            found = found.drop_null()
            for k, name in enumerate(("before", "word", "after")):
                own = pc.struct_field(found, name)
                own = (pc.utf8_lower(own) if name == "word" else own).dictionary_encode()
                parts[plain, k] = self.slots(own.dictionary.to_pylist(), name == "word")[own.indices.to_numpy(zero_copy_only=False)]
        parts[~plain, 1] = self.slots(distinct.filter(pa.array(~plain)).to_pylist(), False)
        return self.flat[expand(self.start[parts].ravel(), self.size[parts].ravel())], self.size[parts].sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (strings without nulls), each ended, and how many each has.  Arrow splits them and finds the distinct pieces."""
        lists = pc.split_pattern(pc.replace_substring(texts, pattern="\n", replacement=" "), pattern=" ")
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        flat, sizes = self.pieces(coded.dictionary)
        size = sizes[which]
        ids = flat[expand((np.cumsum(sizes) - sizes)[which], size)]
        self.trim()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        cuts = np.concatenate([[0], np.cumsum(size)])[ends]
        return np.insert(ids, cuts, self.end_id), np.diff(cuts, prepend=0) + 1

    def documents(self, batches):
        """doc_id, ids of each row of batches (doc_id, text), with the end id; about PORTION bytes at a time."""
        for b in batches:
            docs, texts = b["doc_id"].to_pylist(), b["text"]
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(docs):
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), PORTION, side="right")))
                if sizes[begin] > PORTION:  # a long text, by portions between blanks
                    ids = [self.encode(pa.array([p], pa.large_string()))[0][:-1] for p in portions(texts[begin].as_py())]
                    yield docs[begin], np.concatenate([*ids, np.array([self.end_id], np.uint32)])
                    end = begin + 1
                else:
                    ids, counts = self.encode(texts.slice(begin, end - begin).cast(pa.large_string()))
                    cuts = np.cumsum(counts).tolist()
                    yield from zip(docs[begin:end], (ids[x:z] for x, z in zip([0, *cuts], cuts)))
                begin = end


def portions(text: str):
    """A long text in parts that begin at a blank."""
    at = 0
    while at < len(text):
        end = at + PORTION // 4
        if end < len(text):
            end = min((k for k in (text.find(" ", end), text.find("\n", end)) if k >= 0), default=len(text))
        yield text[at:end]
        at = end


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS) -> None:
    """Encode the texts with a tokenizer.json, read by the driver, and write them to a new folder of any store."""
    file = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer))
    kind = pa.schema([("value", pa.binary())])

    def work(batches):
        own = held(("pieces", hash(file.value), end_id), lambda: Encoder(file.value, end_id))
        part, seq, n = TaskContext.get().partitionId(), 0, 0
        names, counts, ids = [], [], []

        def whole():
            raw = file_bytes(part, seq, names, counts, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], schema=kind)

        for doc, x in own.documents(batches):
            if names and n + len(x) > file_ids:
                yield whole()
                names, counts, ids = [], [], []
                seq, n = seq + 1, 0
            names.append(doc)
            counts.append(len(x))
            ids.append(x)
            n += len(x)
        if names:
            yield whole()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("rk", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "rk", "row"]  # rows of one doc_id and text are told apart only to spread them
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    content = placed.mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    content.write.option("maxRecordsPerFile", 1).text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")  # a task without rows leaves an empty one


#: Bytes of ids that a batch of read rows holds about.
BATCH = 8_000_000


def read(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, doc_id, begin (ids of the file before the document), n_tokens, ids (little-endian 32-bit numbers): a row for each document."""
    kind = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches):
        for b in batches:
            for content in b["content"]:
                own = TokenFile(content.as_buffer().to_pybytes())
                ends = np.cumsum(own.counts.astype(np.int64))
                begins, k = ends - own.counts, 0
                while k < len(ends):
                    last = max(k + 1, int(np.searchsorted(ends, begins[k] + BATCH // 4, side="right")))
                    ids, here = own.ids(int(begins[k]), int(ends[last - 1])), slice(k, last)
                    cuts = (ends[here] - begins[k]).tolist()
                    raw = [ids[a:z].tobytes() for a, z in zip([0, *cuts], cuts)]
                    doc = pa.array(own.doc_ids[here], pa.int64(), mask=own.known[here] == 0)
                    n = last - k
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own.part), pa.int64()), pa.array(np.full(n, own.seq), pa.int64()), doc, pa.array(begins[here]), pa.array(own.counts[here].astype(np.int64)), pa.array(raw, pa.binary())], schema=kind)
                    k = last

    return files(spark, folder).select("content").mapInArrow(work, "part long, seq long, doc_id long, begin long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """All rows of read(), with or without their ids, and start: ids of all documents before.

    Files are numbered inside their part; the sums of the parts before have one row for each task of the writer.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    of_file = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n_ids"))
    inside = of_file.withColumn("in_part", F.coalesce(F.sum("n_ids").over(before("part").orderBy("seq")), F.lit(0)))
    parts = of_file.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(F.lit(0)).orderBy("part")), F.lit(0)).alias("before"))
    bases = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("in_part")).alias("base"))
    return rows.join(bases, ["part", "seq"]).withColumn("start", F.col("base") + F.col("begin")).drop("base")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; sums are made where files are read, so that ids aren't moved."""
    rows = read(spark, folder).select("part", "seq", "doc_id", "begin", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(materialize(rows, "read")).select("doc_id", "start", "n_tokens", "ids_crc32")
