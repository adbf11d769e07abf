"""Tables that lie along a Z-order curve, and boxes that read only the parts they meet.

``store`` writes points in the order of a 30-bit Z-order key of their cell, in folders of zones (the key's first bits),
so that near points share files and row groups.  ``within_box`` covers a box with a few ranges of the key: folders that
hold none of them are never listed, and Parquet's statistics skip files and row groups outside them.  What a box reads
grows with the box, not with the table.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.sky import clip, spread_bits
from skyweave.operators import gates

#: Bits of a key for each axis, ranges of a box about, and bits of a zone for each axis.
BITS, RANGES, ZONE = 10, 48, 2


def key_of(position: list[str], low: list[float], side: list[float]) -> Column:
    """Z-order key of the cell that holds a point; points outside the box of cells go to its edge."""
    out = F.lit(0).cast("long")
    for k, (c, lo, s) in enumerate(zip(position, low, side)):
        cell = clip(F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(s)).cast("double"), 0.0, float((1 << BITS) - 1))
        out = out.bitwiseOR(F.shiftleft(spread_bits(cell), k))
    return out


def store(points: DataFrame, folder: str, position: list[str], zone: int = ZONE) -> None:
    """Write points (any columns, three finite coordinates) to a new folder; points without a finite place abort.

    Rows are ranged by key, then by a hash of the place, so that points that crowd in one cell are not one task.
    """
    gates.require(len(position) == 3 and not {"_z", "_zone"} & set(points.columns), "three coordinates are due, and no columns _z and _zone")
    xs = [F.col(c).cast("double") for c in position]
    ends = points.agg(*[f(x).alias(f"{w}{k}") for k, x in enumerate(xs) for w, f in (("lo", F.min), ("hi", F.max))], F.count_if(~(F.abs(xs[0] + xs[1] + xs[2]) < float("inf")) | (xs[0] + xs[1] + xs[2]).isNull()).alias("odd")).first()
    gates.require(not ends["odd"], f"{ends['odd']} points have no finite place")
    low = [ends[f"lo{k}"] or 0.0 for k in range(3)]
    side = [max(((ends[f"hi{k}"] or 0.0) - lo) / (1 << BITS), 1e-12) for k, lo in enumerate(low)]
    placed = points.withColumn("_z", key_of(position, low, side)).withColumn("_zone", F.shiftright("_z", 3 * (BITS - zone)).cast("int"))
    spread = placed.repartitionByRange("_z", F.xxhash64(*position)).sortWithinPartitions("_zone", "_z")
    spread.write.mode("errorifexists").partitionBy("_zone").parquet(folder)
    note = json.dumps({"position": position, "low": low, "side": side, "zone": zone})
    points.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{folder}/_layout")


def cover(low: list[int], high: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges (first, last) of keys that hold all cells from low to high, both included: about `most`, the largest excess cut first."""
    def node(level: int, code: int, at: tuple[int, int, int]):
        width = 1 << (BITS - level)
        ends = [a + width - 1 for a in at]
        if any(e < lo or a > hi for a, e, lo, hi in zip(at, ends, low, high)):
            return None
        inside = 1
        for a, e, lo, hi in zip(at, ends, low, high):
            inside *= min(e, hi) - max(a, lo) + 1
        return inside - width**3, level, code, at  # minus the cells that aren't wanted

    open_, whole = [node(0, 0, (0, 0, 0))], []
    open_ = [x for x in open_ if x]
    while open_ and open_[0][0] < 0 and len(open_) + len(whole) < most:
        _, level, code, at = heapq.heappop(open_)
        width = 1 << (BITS - level - 1)
        for k in range(8):
            child = node(level + 1, code * 8 + k, tuple(a + width * (k >> j & 1) for j, a in enumerate(at)))
            if child:
                heapq.heappush(open_, child)
    out: list[tuple[int, int]] = []
    for first, last in sorted((code << 3 * (BITS - level), ((code + 1) << 3 * (BITS - level)) - 1) for _, level, code, _ in open_ + whole):
        if out and first == out[-1][1] + 1:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


class Laid:
    """A folder of store()."""

    def __init__(self, spark: SparkSession, folder: str):
        note = json.loads(gates.exactly_one(spark.read.text(f"{folder}/_layout"))["value"])
        self.spark, self.folder = spark, folder
        self.position, self.low, self.side, self.zone = (note[k] for k in ("position", "low", "side", "zone"))

    def points(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop("_z", "_zone")

    def within_box(self, low: list[float], high: list[float]) -> DataFrame:
        """The points with low <= coordinate <= high on each axis."""
        cell = lambda x, k: min((1 << BITS) - 1, max(0, int((x - self.low[k]) // self.side[k])))
        ranges = cover([cell(x, k) for k, x in enumerate(low)], [cell(x, k) for k, x in enumerate(high)])
        shift = 3 * (BITS - self.zone)
        zones = sorted({z for a, b in ranges for z in range(a >> shift, (b >> shift) + 1)})
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | F.col("_z").between(a, b)
        exact = [F.col(c).between(lo, hi) for c, lo, hi in zip(self.position, low, high)]
        return self.spark.read.parquet(self.folder).where(F.col("_zone").isin(zones) & inside & exact[0] & exact[1] & exact[2]).drop("_z", "_zone")
