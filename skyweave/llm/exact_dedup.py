"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so: at least ``low`` characters, then up to the next line or sentence end, or
where none comes, to the next of some pairs of characters; ``high`` characters at most.  Each chunk is named by a 64-bit identifier; a chunk store (one row per identifier)
verifies that all chunks of one name have one SHA-256 content digest, and the texts that hold a chunk of an
ambiguous name carry the digests too.  Two texts are equal if their ordered identifier lists are equal, so only the
short recipes are moved and compared, never the texts.

Cases: a null text counts as empty, and the empty text has the empty recipe; a long text is a long recipe, of its
whole; of rows that repeat both doc_id and text one stays; rows with null doc_id stay only if all doc_ids of their group
are null; columns besides doc_id and text are ignored by `assign` and kept by `deduplicate`; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.llm.util import join_hot, materialize

#: Ends of chunks of texts without lines and sentences: pairs of characters that are neither rare nor frequent in codes, numbers and words, and a part of the Han characters.
ELSEWHERE = r"[aeiouAEIOU0-7+/ ][g-jG-J23]|[\x{4E00}-\x{4FFF}]"
#: Ambiguous identifiers that are broadcast at most (8 bytes each).
FEW = 100_000


def chunks(text: Column, low: int, high: int) -> Column:
    """The chunks of a text in order; joined, they are the text."""
    some = rf".{{{low},{high}}}?"
    pattern = rf"(?s){some}(?:\n|[.!?] |[。！？؟।])|{some}(?:{ELSEWHERE})|.{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _named(c: Column) -> Column:
    """Identifier of a chunk, and its SHA-256 as four numbers, which compare and aggregate without objects."""
    digest = F.sha2(c.cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"v{i}") for i in range(4)]
    rest = F.conv(F.substring(digest, 61, 4), 16, 10).cast("bigint").alias("v4")
    return F.struct(F.xxhash64(c).alias("id"), *parts, rest)


def recipes(docs: DataFrame, low: int = 512, high: int = 4096) -> DataFrame:
    """doc_id, text_sha256, recipe (array of struct id, v0..v4) and row (unique)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.transform(chunks(text, low, high), _named).alias("recipe"), F.monotonically_increasing_id().alias("row"))


def chunk_store(held: DataFrame) -> DataFrame:
    """One row per chunk identifier of recipes(): id, copies, and whether one content stands behind it."""
    one = held.select(F.explode("recipe").alias("c")).select("c.*")
    v = [f"v{i}" for i in range(5)]
    same = F.lit(True)
    for x in v:
        same = same & (F.col(f"lo_{x}") == F.col(f"hi_{x}"))
    ends = [f(x).alias(f"{n}_{x}") for x in v for n, f in (("lo", F.min), ("hi", F.max))]
    return one.groupBy("id").agg(F.count("*").alias("copies"), *ends).select("id", "copies", same.alias("verified"))


def ambiguous(held: DataFrame, unsure: DataFrame) -> DataFrame:
    """row, unsure: the rows of recipes() that hold one of these identifiers.

    There are hardly ever any.  A checked small number is broadcast, so that the copies of a frequent chunk aren't
    gathered by its identifier; beyond it rows with such chunks are joined by identifier.
    """
    n = unsure.count()
    if not n:
        return held.select("row", F.lit(True).alias("unsure")).limit(0)
    one = held.select("row", F.explode(F.array_distinct(F.transform("recipe", lambda c: c["id"]))).alias("id"))
    return one.join(F.broadcast(unsure) if n <= FEW else unsure, "id", "left_semi").select("row").distinct().withColumn("unsure", F.lit(True))


def assign(docs: DataFrame, low: int = 512, high: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row for each input row."""
    held = materialize(recipes(docs, low, high), "recipes")
    unsure = materialize(chunk_store(held).where(~F.col("verified")).select("id"), "unsure")
    marked = ambiguous(held, unsure)
    ids = F.transform("recipe", lambda c: c["id"])
    full = F.transform("recipe", lambda c: F.concat_ws(".", *[c[f"v{i}"].cast("string") for i in range(5)]))
    lists = held.join(marked, "row", "left").select("doc_id", "row", "text_sha256", F.size("recipe").alias("n_chunks"), ids.alias("ids"), F.when(F.col("unsure"), full).alias("contents"))
    # The list as a group key; its digest is the short key of the way back.
    lists = lists.withColumn("key", F.sha2(F.concat(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("|"), F.coalesce(F.array_join("contents", ","), F.lit(""))), 256))
    groups = lists.groupBy("key", "ids", "contents").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    groups = materialize(groups.select("key", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"), "groups")
    rows = held.count()
    out = lists.select("doc_id", "row", "text_sha256", "n_chunks", "key")
    return join_hot(out, groups, "key", rows, "group_size").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_chunks")


def deduplicate(docs: DataFrame, low: int = 512, high: int = 4096) -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts the one with the largest doc_id."""
    # One key column for the join and the window, so that the texts are moved once.
    name = lambda doc_id, sha: F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.lit(":"), sha).alias("__skyweave_key")
    stay = assign(docs, low, high).where("kept").select(name(F.col("doc_id"), F.col("text_sha256")))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    near = docs.select("*", name(F.col("doc_id"), sha)).join(stay, "__skyweave_key", "left_semi")
    one = Window.partitionBy("__skyweave_key").orderBy(F.lit(0))
    return near.withColumn("__skyweave_n", F.row_number().over(one)).where("__skyweave_n = 1").select(*[docs[c] for c in docs.columns])
