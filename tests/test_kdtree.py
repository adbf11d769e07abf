"""Nearest neighbours by a k-d tree against all distances, with crowds of points and of queries."""

import numpy as np
import pytest

from skyweave.operators import kdtree, spatial


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, *map(float, r)) for k, r in enumerate(x)], "id long, x double, y double, z double").repartition(3)


def crowded(n, seed):
    g = np.random.default_rng(seed)
    return np.concatenate([g.normal(5, 1e-3, (n // 2, 3)), g.uniform(-100, 100, (n - n // 2, 3))])


def brute(q, p, k, first):
    d = np.sqrt(((q[:, None, 0] - p[:, 0]) ** 2 + (q[:, None, 1] - p[:, 1]) ** 2) + (q[:, None, 2] - p[:, 2]) ** 2)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {i: [(float(d[i, j]), first + int(j)) for j in o] for i, o in enumerate(order)}


@pytest.mark.parametrize("k", [1, 8])
@pytest.mark.parametrize("kind", ["crowd", "copies", "line", "few"])
def test_against_all_distances(spark, monkeypatch, kind, k):
    monkeypatch.setattr(kdtree, "LEAF", 16)
    monkeypatch.setattr(kdtree, "QUERIES", 30)
    g = np.random.default_rng(k)
    p = {"crowd": crowded(600, 1), "copies": np.concatenate([np.full((300, 3), 2.0), g.integers(0, 3, (100, 3)).astype(float)]), "line": np.stack([np.arange(200.0), np.zeros(200), np.zeros(200)], 1), "few": g.uniform(0, 1, (5, 3))}[kind]
    q = np.concatenate([p[:120], crowded(60, 2), g.uniform(-1e6, 1e6, (20, 3))])
    got = {}
    for r in spatial.nearest(frame(spark, q), frame(spark, p, 1000), "id", ["x", "y", "z"], k).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append((r.distance, r.p_id))
    assert got == brute(q, p, k, 1000)


def test_rows_without_a_place_are_left_out(spark):
    odd = spark.createDataFrame([(1, 0.0, 0.0, None), (2, float("nan"), 0.0, 0.0), (3, float("inf"), 0.0, 0.0), (4, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert [tuple(r) for r in spatial.nearest(odd, odd, "id", ["x", "y", "z"], 3).collect()] == [(4, 1, 4, 0.0)]
    assert spatial.nearest(odd, odd.where("id < 4"), "id", ["x", "y", "z"]).count() == 0 and spatial.nearest(odd.limit(0), odd, "id", ["x", "y", "z"]).count() == 0


def test_leaves_are_even_where_points_crowd():
    """Half of the points in a cluster: no leaf holds more than a few times its share, and a query meets few leaves."""
    x = crowded(200_000, 3)
    leaves = 256
    g = np.random.default_rng(5)
    tree = kdtree.Tree(x[g.choice(len(x), kdtree.SAMPLE * leaves, replace=False)], leaves)
    of = tree.leaf(x)
    held = np.bincount(of, minlength=leaves)
    assert held.max() < 4 * len(x) / leaves and held.min() > 0
    at = np.argsort(of, kind="stable")
    cuts = np.cumsum(held) - held
    low, high = np.minimum.reduceat(x[at], cuts), np.maximum.reduceat(x[at], cuts)
    tree.fill(np.arange(leaves), held, low, high)
    some = x[g.choice(len(x), 2000, replace=False)]
    bound = tree.bound(some, 8)
    assert (np.sqrt(((some[:50, None] - x) ** 2).sum(2)) <= bound[:50, None]).sum(1).min() >= 8
    nearest8 = np.array([np.partition(np.sqrt(((s - x) ** 2).sum(1)), 7)[7] for s in some[:200]])
    who, _ = tree.within(some[:200], nearest8)
    assert np.bincount(who, minlength=200).mean() < 6
