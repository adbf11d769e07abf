"""Nearest neighbours by a k-d tree over a sample: space is cut where the points are, not by a grid.

The driver builds a tree from a bounded sample (SAMPLE points a leaf, LEAVES leaves at most) and gets the leaves' counts
and boxes back.  A query is first searched in its own leaf, which bounds its k-th distance; a walk down the tree then
finds the other leaves whose boxes lie within that distance, and only these are searched.  A task's unit is a part of a
leaf's points (about LEAF) with a part of its queries (about QUERIES): a leaf that holds more, because the sample missed
them or because many points share one place, is split by hash, so neither a crowd of points nor a crowd of queries is
one unit.  Results are exact; ties go to the smaller p_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.storage import materialize

#: Points of a leaf and queries of a unit, about; leaves at most; points of the sample for each leaf.
LEAF, QUERIES, LEAVES, SAMPLE = 1024, 2048, 1 << 16, 16
#: Distances that a task holds at a time.
BLOCK = 1 << 20


class Tree:
    """A complete binary tree, nodes 1, 2, 3 ...: node i has children 2i and 2i + 1, and sends x < cut to the first."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(leaves - 1).bit_length())
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        parts = {1: sample}
        for node in range(1, 1 << self.depth):
            x = parts.pop(node)
            if len(x):
                self.axis[node] = a = int(np.argmax(x.max(0) - x.min(0)))
                self.cut[node] = np.partition(x[:, a], len(x) // 2)[len(x) // 2]
            left = x[:, self.axis[node]] < self.cut[node]
            parts[2 * node], parts[2 * node + 1] = x[left], x[~left]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf of each point, from 0."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def fill(self, leaf: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Counts and boxes of the leaves, and from them those of all nodes."""
        n, d = 1 << self.depth, low.shape[1]
        self.count = np.zeros(2 * n, np.int64)
        self.low, self.high = np.full((2 * n, d), np.inf), np.full((2 * n, d), -np.inf)
        self.count[n + leaf], self.low[n + leaf], self.high[n + leaf] = count, low, high
        for node in range(n - 1, 0, -1):
            a, b = 2 * node, 2 * node + 1
            self.count[node] = self.count[a] + self.count[b]
            self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])

    def near(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Distance of each point to a node's box; infinite to an empty one."""
        with np.errstate(invalid="ignore"):
            gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.sqrt((gap * gap).sum(1))

    def bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each point has k others at least: the far corner of its smallest node that holds as many."""
        node, out = self.leaf(x) + (1 << self.depth), np.full(len(x), np.inf)
        for _ in range(self.depth + 1):
            new = np.flatnonzero(np.isinf(out) & (self.count[node] >= k))
            far = np.maximum(np.abs(x[new] - self.low[node[new]]), np.abs(self.high[node[new]] - x[new]))
            out[new] = np.sqrt((far * far).sum(1))
            node = node >> 1
        return out

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of the leaves whose boxes lie within each point's radius."""
        who, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for level in range(self.depth + 1):
            keep = (self.near(x[who], node) <= radius[who] * (1 + 1e-9)) & (self.count[node] > 0)
            who, node = who[keep], node[keep]
            if level < self.depth:
                who, node = np.repeat(who, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
        return who, node - (1 << self.depth)


def coordinates(batch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy(), float) for c in names], 1) if batch.num_rows else np.zeros((0, len(names)))


def with_column(batch: pa.RecordBatch, rows: np.ndarray | None, name: str, values: np.ndarray) -> pa.RecordBatch:
    some = batch if rows is None else batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*some.columns, pa.array(values)], names=[*batch.schema.names, name])


def closest(q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the k nearest of p, whose order breaks ties, sorted by query, distance, point."""
    whos, whichs, fars = [], [], []
    step = max(1, BLOCK // max(1, len(p)))
    for begin in range(0, len(q), step):
        d = 0.0
        for j in range(q.shape[1]):  # summed in the order of the axes, as other distances are
            gap = q[begin : begin + step, j, None] - p[:, j]
            d = d + gap * gap
        d = np.sqrt(d)
        if len(p) > k:
            who, which = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
        else:
            who, which = (x.ravel() for x in np.indices(d.shape))
        far = d[who, which]
        order = np.lexsort((which, far, who))
        who, which, far = who[order], which[order], far[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        some = rank < k
        whos.append(who[some] + begin), whichs.append(which[some]), fars.append(far[some])
    return np.concatenate(whos), np.concatenate(whichs), np.concatenate(fars)


def nearest(queries: DataFrame, points: DataFrame, k: int, d: int) -> DataFrame:
    """q_id, found (array of (distance, p_id), the k nearest in order) of queries (q_id, q0 ...) among points (p_id, p0 ...), all finite."""
    qs, ps = [f"q{i}" for i in range(d)], [f"p{i}" for i in range(d)]
    points = materialize(points, "points")
    n = points.count()
    id_type = points.schema["p_id"].dataType
    kind = T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("p_id", id_type)]))
    if not n:
        return queries.select("q_id").limit(0).withColumn("found", F.array().cast(kind))
    leaves = min(LEAVES, -(-n // LEAF))
    share = min(1.0, SAMPLE * leaves / n)
    drawn = points.where(F.pmod(F.xxhash64("p_id", *ps), F.lit(1 << 30)) < int(share * (1 << 30))).select(*ps).toArrow()
    tree = Tree(coordinates(drawn, ps), leaves)

    def placed(df: DataFrame, columns: list[str]) -> DataFrame:
        def work(batches):
            for b in batches:
                yield with_column(b, None, "leaf", tree.leaf(coordinates(b, columns)))

        return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField("leaf", T.LongType())]))

    points = materialize(placed(points, ps), "leaves")
    stats = points.groupBy("leaf").agg(F.count("*").alias("n"), *[f(c).alias(f"{w}{i}") for i, c in enumerate(ps) for w, f in (("lo", F.min), ("hi", F.max))]).toArrow()
    at = lambda w: np.stack([stats[f"{w}{i}"].to_numpy() for i in range(d)], 1)
    tree.fill(stats["leaf"].to_numpy(), stats["n"].to_numpy(), at("lo"), at("hi"))
    parts = points.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(2.0 * LEAF)).cast("int").alias("parts"))  # at most LEAVES rows
    dealt_points = points.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("p_id", *ps), F.col("parts")).cast("int"))

    def searched(asked: DataFrame) -> DataFrame:
        """asked (q_id, q0 ..., leaf) with found: the nearest of the leaf's points, a row for each part of them."""
        asked = materialize(asked, "asked")
        chunks = asked.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(float(QUERIES))).cast("int").alias("chunks"))
        left = asked.join(F.broadcast(chunks), "leaf").withColumn("chunk", F.pmod(F.xxhash64("q_id", *qs), F.col("chunks")).cast("int")).drop("chunks")
        left = left.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = dealt_points.drop("parts").join(F.broadcast(chunks), "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        unit = ["leaf", "part", "chunk"]

        def work(q: pa.Table, p: pa.Table) -> pa.Table:
            p = p.sort_by("p_id")
            who, which, far = closest(coordinates(q, qs), coordinates(p, ps), k) if q.num_rows and p.num_rows else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
            pairs = pa.StructArray.from_arrays([pa.array(far), p["p_id"].combine_chunks().take(pa.array(which))], names=["distance", "p_id"])
            ends = np.searchsorted(who, np.arange(q.num_rows + 1)).astype(np.int32)
            return q.select(["q_id", *qs]).append_column("found", pa.ListArray.from_arrays(pa.array(ends), pairs))

        schema = T.StructType([*asked.select("q_id", *qs).schema.fields, T.StructField("found", kind)])
        return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(work, schema)

    def best(found: DataFrame, *more: str) -> DataFrame:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
        return found.groupBy("q_id", *more).agg(merged.alias("found"))

    def reach(batches):
        for b in batches:
            x = coordinates(b, qs)
            radius = np.fmin(b.column("kth").to_numpy(zero_copy_only=False).astype(float), tree.bound(x, k))
            who, leaf = tree.within(x, radius)
            other = leaf != tree.leaf(x)[who]
            yield with_column(b.drop_columns(["kth"]), who[other], "leaf", leaf[other])

    home = placed(queries, qs)
    first = materialize(best(searched(home.join(F.broadcast(parts.select("leaf")), "leaf")), *qs), "home")
    known = queries.select("q_id", *qs).join(first.select("q_id", F.get("found", F.lit(k - 1))["distance"].alias("kth")), "q_id", "left")
    asked = known.mapInArrow(reach, T.StructType([*queries.select("q_id", *qs).schema.fields, T.StructField("leaf", T.LongType())]))
    return best(first.select("q_id", "found").unionByName(searched(asked).select("q_id", "found")))
