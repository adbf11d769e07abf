"""Shards of near equal bytes by a minimax contiguous partition (DataFrame functions only).

Groups of equal texts are atomic.  They are ordered by their SHA-256 digest, and cut into n contiguous shards so that
the largest shard is as small as it can be: binary search over the capacity, each candidate checked greedily (fill a
shard until the next group would pass the capacity), then the cuts of the smallest feasible one.

The check needs sums over ordered groups, not the groups.  The driver holds leaves of a tree over digest prefixes with
their sums: 4,096 at first, 256 more for a leaf only where a cut of a capacity that can't be decided yet falls in it.  A
check walks with an interval for each cut, from the least it can be to the most; a capacity is feasible if the least
suffices and infeasible if the most doesn't, and only between the two are leaves fetched, all that the walk met in one
job.  Capacities far from the smallest are decided by the first sums, near ones share their cuts, so both the number of
fetches and what they bring stay bounded at any size of the input and of its largest group.  The groups lie sorted by
digest, so that a fetch reads only the files and row groups that hold its prefixes.

Cases: a null text has 0 bytes and no checksum difference from the empty text; sizes are bytes plus 8, so empty texts
spread too; rows that repeat are rows of one group, each with its own slot, numbered in parts by row, so that copies spread; long texts count with all their bytes; with fewer groups than shards some shards
are empty; an empty table gives an empty table; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.llm.util import materialize

#: Hex digits of a digest that the first fetch reads, and later ones.
FIRST, DIGITS = 3, 2


class Order:
    """Running sums over the groups in the order of their digests, fetched where asked for.

    fetch(prefixes, digits): (child prefix, bytes, groups, largest group's bytes) of the children of these prefixes.
    """

    def __init__(self, fetch):
        self.fetch, self.fetches, self.fetched, self.most = fetch, 0, 0, 0
        self.leaves: list[tuple[str, int, int]] = []  # prefix, bytes, groups, in order
        self.begins: list[int] = []
        self.refine([None])

    def refine(self, which: list[int | None]) -> None:
        """Replace these leaves by their children; [None]: the first fetch."""
        first = which == [None]
        prefixes = [""] if first else [self.leaves[k][0] for k in which]
        got: dict[str, list] = {p: [] for p in prefixes}
        size = len(prefixes[0])
        for child, total, n, most in self.fetch(prefixes, FIRST if first else DIGITS):
            got[child[:size]].append((child, total, n))
            self.most = max(self.most, most)
            self.fetched += 1
        self.fetches += 1
        replaced = {} if first else {self.leaves[k][0]: sorted(got[self.leaves[k][0]]) for k in which}
        self.leaves = sorted(got[""]) if first else [x for leaf in self.leaves for x in replaced.get(leaf[0], (leaf,))]
        self.begins, self.total = [], 0
        for _, b, _ in self.leaves:
            self.begins.append(self.total)
            self.total += b

    def floor(self, limit: int) -> tuple[int, int, int]:
        """(least, most, leaf): bounds of the last group edge at or before the limit, and the leaf in which the limit falls."""
        if limit >= self.total:
            return self.total, self.total, len(self.leaves)
        k = bisect_right(self.begins, limit) - 1
        begin, n = self.begins[k], self.leaves[k][2]
        return begin, begin if n == 1 or limit == begin else limit, k


def walk(order: Order, n: int, capacity: int) -> tuple[int, int, list[int], list[int]]:
    """Bounds of what n shards of a capacity hold when they are filled greedily, the leaves in which the upper cuts fall, and undecided leaves."""
    low = high = 0
    cuts, open_ = [], []
    for _ in range(n):
        a, b = order.floor(low + capacity), order.floor(high + capacity)
        open_ += [k for least, most, k in (a, b) if least != most]
        low, high = a[0], b[1]
        cuts.append(b[2])
    return low, high, cuts, open_


def feasible(order: Order, n: int, capacity: int) -> bool:
    """Whether n shards of the capacity hold all groups; fetches what decides it."""
    while True:
        low, high, _, open_ = walk(order, n, capacity)
        if low >= order.total or high < order.total:
            return low >= order.total
        by_length: dict[int, list[int]] = {}
        for k in sorted(set(open_)):
            by_length.setdefault(len(order.leaves[k][0]), []).append(k)
        # Leaves of one length are fetched together, the coarsest first.
        order.refine(by_length[min(by_length)])


def minimax(order: Order, n: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and for each cut the prefix at which the next shard begins."""
    if not order.total:
        return 0, []
    even = -(-order.total // n)
    low, high = even, order.most + even  # greedy shards of `high` get at least `even` each
    while low < high:
        middle = (low + high) // 2
        if feasible(order, n, middle):
            high = middle
        else:
            low = middle + 1
    # The cuts themselves, exactly: no leaf of the walk may be open.
    while open_ := walk(order, n, low)[3]:
        length = min(len(order.leaves[k][0]) for k in open_)
        order.refine(sorted({k for k in open_ if len(order.leaves[k][0]) == length}))
    return low, [order.leaves[k][0] for k in walk(order, n, low)[2] if k < len(order.leaves)]


def fetch_from(groups: DataFrame):
    """fetch() of an Order over groups (text_sha256, bytes)."""

    def fetch(prefixes: list[str], digits: int):
        rows, length = groups, len(prefixes[0])
        if length:
            inside = F.lit(False)
            for p in prefixes:  # as ranges, which Parquet's statistics can prune by
                inside = inside | F.col("text_sha256").between(p, p + "g")
            rows = rows.where(inside)
        child = F.substring("text_sha256", 1, length + digits).alias("child")
        found = rows.groupBy(child).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most"))
        return [(r["child"], r["bytes"], r["n"], r["most"]) for r in found.collect()]

    return fetch


def shard(docs: DataFrame, n: int = 24, spread: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, text_sha256: one row for each input row.

    spread: parts of a shard that are numbered apart, so that no task holds a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("text_sha256").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups.repartitionByRange("text_sha256").sortWithinPartitions("text_sha256"), "groups")
    _, cuts = minimax(Order(fetch_from(groups)), n)
    at = F.lit(0)
    for cut in cuts:
        at = at + (F.col("text_sha256") >= F.lit(cut)).cast("int")
    placed = rows.withColumn("shard", at.cast("int")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(spread)).cast("int"))
    # At most n * spread rows: where the slots of each part of a shard begin.
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_sha256", "row")
    numbered = placed.withColumn("k", F.row_number().over(within)).join(F.broadcast(begins), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_sha256")
