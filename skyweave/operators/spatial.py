"""Distance joins on grid cells, nearest neighbours by a k-d tree, and the support audits that use them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.sky import chord_arcmin
from skyweave.operators import kdtree
from skyweave.operators.aggregates import exact_percentiles
from skyweave.operators.layout import even_odd
from skyweave.storage import materialize


def distance(a: list[str], b: list[str]) -> Column:
    return F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a[1:], b[1:])), (F.col(a[0]) - F.col(b[0])) * (F.col(a[0]) - F.col(b[0]))))


def cell_of(columns: list[str], side: float) -> Column:
    return F.struct(*[F.floor(F.col(c) / side).cast("long").alias(f"c{k}") for k, c in enumerate(columns)])


def around(columns: list[str], side: float, half: bool = False) -> Column:
    """The cells that touch a point's cell; half: only those not before it, so that each pair of cells meets once."""
    steps = [s for s in product((-1, 0, 1), repeat=len(columns)) if not half or s >= (0,) * len(columns)]
    return F.explode(F.array(*[F.struct(*[(F.floor(F.col(c) / side) + d).cast("long").alias(f"c{k}") for k, (c, d) in enumerate(zip(columns, s))]) for s in steps]))


def _renamed(df: DataFrame, key: str, position: list[str], prefix: str) -> DataFrame:
    return df.select(F.col(key).alias(f"{prefix}_id"), *[F.col(c).cast("double").alias(f"{prefix}{k}") for k, c in enumerate(position)])


#: Rows of a cell on each side that one task compares; a hot cell (a thousandth of a side's rows) is cut into at most TILES x TILES tiles.
TILE, TILES = 4096, 32


def cells_joined(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Equi-join of two sides on `cell`, in which no hot cell is one task.

    A cell that holds a thousandth of a side's rows, and more pairs than a tile, is a grid of tiles: the left rows are
    dealt to its rows and copied along them, the right ones to its columns.  There are two thousand such cells at most,
    so their table is broadcast.  Tables that a few tiles hold are joined as they are.
    """
    a, b = left.groupBy("cell").agg(F.count("*").alias("a")), right.groupBy("cell").agg(F.count("*").alias("b"))
    met = materialize(a.join(b, "cell"), "cells")
    seen = met.agg(F.max(F.col("a") * F.col("b")).alias("most"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if (seen["most"] or 0) <= TILE * TILE:
        return left.join(right, "cell")
    tiles = lambda n, all_: F.least(F.lit(TILES), F.ceil(F.col(n) / F.lit(float(max(TILE, all_ // 1000))))).cast("int")
    hot = met.where((F.col("a") * F.col("b") > TILE * TILE) & ((F.col("a") * 1000 >= seen["a"]) | (F.col("b") * 1000 >= seen["b"])))
    hot = F.broadcast(hot.select("cell", tiles("a", seen["a"]).alias("_a"), tiles("b", seen["b"]).alias("_b")))

    def dealt(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        n, copies = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        placed = side.join(hot, "cell", "left").withColumn(f"{own}_at", F.pmod(F.xxhash64(key), n).cast("int"))
        return placed.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_a", "_b")

    return dealt(left, left_id, "_a", "_b").join(dealt(right, right_id, "_b", "_a"), ["cell", "_a_at", "_b_at"]).drop("_a_at", "_b_at")


def within(queries: DataFrame, points: DataFrame, key: str, position: list[str], radius: float) -> DataFrame:
    """q_id, p_id, distance of all pairs with distance <= radius: an equi-join on cells of that side, hot cells in tiles."""
    q, p = _renamed(queries, key, position, "q"), _renamed(points, key, position, "p")
    qs, ps = [f"q{k}" for k in range(len(position))], [f"p{k}" for k in range(len(position))]
    both = cells_joined(q.withColumn("cell", around(qs, radius)), p.withColumn("cell", cell_of(ps, radius)), "q_id", "p_id")
    return both.select("q_id", "p_id", distance(qs, ps).alias("distance")).where(F.col("distance") <= radius)


def pairs_within(points: DataFrame, key: str, position: list[str], radius: float) -> DataFrame:
    """a, b, distance of all pairs a < b of one table with distance <= radius."""
    a, b = _renamed(points, key, position, "a"), _renamed(points, key, position, "b")
    xs, ys = [f"a{k}" for k in range(len(position))], [f"b{k}" for k in range(len(position))]
    left = a.withColumn("own", cell_of(xs, radius)).withColumn("cell", around(xs, radius, half=True))
    both = cells_joined(left, b.withColumn("cell", cell_of(ys, radius)), "a_id", "b_id").where((F.col("own") != F.col("cell")) | (F.col("a_id") < F.col("b_id")))
    low, high = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    return both.select(low.alias("a"), high.alias("b"), distance(xs, ys).alias("distance")).where(F.col("distance") <= radius)


def nearest(queries: DataFrame, points: DataFrame, key: str, position: list[str], k: int = 1) -> DataFrame:
    """q_id, rank, p_id, distance: the k nearest points of each query, exactly, by a k-d tree; ties by p_id.

    Keys of queries are unique.  Rows without a finite place are left out on both sides.
    """
    q, p = _renamed(queries, key, position, "q"), _renamed(points, key, position, "p")
    whole = lambda df, prefix: df.where(sum((F.abs(f"{prefix}{i}") for i in range(len(position))), F.lit(0.0)) < float("inf"))
    found = kdtree.nearest(whole(q, "q"), whole(p, "p"), k, len(position))
    out = found.select("q_id", F.posexplode("found").alias("rank", "f"))
    return out.select("q_id", (F.col("rank") + 1).alias("rank"), "f.p_id", "f.distance")


def support_radius(randoms: DataFrame, key: str, position: list[str], percentile: float = 0.99) -> tuple[DataFrame, float]:
    """Training half of the randoms, and the percentile of the other half's nearest distances to it."""
    halves = materialize(even_odd(randoms.select(key, *position), key), "halves")
    train, holdout = halves.where("is_train"), halves.where("NOT is_train")
    radius = exact_percentiles(nearest(holdout, train, key, position), "distance", [percentile]).get(0, [None])[0]
    return train, radius


def supported(candidates: DataFrame, randoms: DataFrame, key: str, position: list[str], percentile: float = 0.99) -> DataFrame:
    """candidates with support_radius and supported: whether a training random lies within the radius."""
    train, radius = support_radius(randoms, key, position, percentile)
    if radius is None:
        return candidates.withColumn("support_radius", F.lit(None).cast("double")).withColumn("supported", F.lit(False))
    near = nearest(candidates, train, key, position).where(F.col("distance") <= radius).select(F.col("q_id").alias(key), F.lit(True).alias("_near"))
    return candidates.join(near, key, "left").withColumn("support_radius", F.lit(radius)).withColumn("supported", F.coalesce("_near", F.lit(False))).drop("_near")


def angular_audit(candidates: DataFrame, randoms: DataFrame, key: str, unit: list[str], k: int = 8, percentile: float = 0.99) -> DataFrame:
    """key, nearest, kth, near, dense and the two thresholds in arc minutes, from the randoms' other half."""
    halves = materialize(even_odd(randoms.select(key, *unit), key), "halves")
    train = halves.where("is_train")

    def ends(rows: DataFrame) -> DataFrame:
        return nearest(rows, train, key, unit, k).groupBy("q_id").agg(F.min("distance").alias("nearest"), F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("kth"))

    held = materialize(ends(halves.where("NOT is_train")), "ends")
    one, many = (F.lit(exact_percentiles(held, c, [percentile]).get(0, [None])[0]).cast("double") for c in ("nearest", "kth"))
    return ends(candidates).select(F.col("q_id").alias(key), "nearest", "kth", (F.col("nearest") <= one).alias("near"), (F.col("kth") <= many).alias("dense"), chord_arcmin(one).alias("near_arcmin"), chord_arcmin(many).alias("dense_arcmin"))
