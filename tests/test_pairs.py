"""Pairs in crowded cells, statistics over pairs, and joins with interval tables, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import aggregates, joins, spatial
from skyweave.plans import audits


def crowd(spark, n, seed, first=0):
    """Half of the points in one cell."""
    g = random.Random(seed)
    rows = [(first + k, *(g.uniform(0.1, 0.9) if k % 2 else g.uniform(-9, 9) for _ in range(3)), g.gauss(0, 3)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double, v double").repartition(3)


def far(a, b):
    return ((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])) ** 0.5


@pytest.mark.parametrize("tile", [4096, 20, 3])
def test_pairs_of_crowded_cells(spark, monkeypatch, tile):
    monkeypatch.setattr(spatial, "TILE", tile)
    rows, df = crowd(spark, 160, 1)
    asked, q = crowd(spark, 60, 2, 1000)
    got = sorted((r.a, r.b) for r in spatial.pairs_within(df, "id", ["x", "y", "z"], 1.0).collect())
    assert got == sorted((a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if far(a, b) <= 1.0) and len(got) > 500
    got = sorted((r.q_id, r.p_id) for r in spatial.within(q, df, "id", ["x", "y", "z"], 1.0).collect())
    assert got == sorted((a[0], b[0]) for a in asked for b in rows if far(a, b) <= 1.0)


def test_a_hot_cell_is_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE", 100)
    rows = spark.range(2000).select(F.col("id"), F.lit("c").alias("cell"))
    both = spatial.cells_joined(rows.withColumnRenamed("id", "l"), rows.withColumnRenamed("id", "r"), "l", "r")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "_a_at" in plan and both.count() == 4_000_000
    tiles = both.select(F.pmod(F.xxhash64("l"), F.lit(20)).alias("a"), F.pmod(F.xxhash64("r"), F.lit(20)).alias("b")).groupBy("a", "b").count().agg(F.max("count"), F.count("*")).first()
    assert tiles[1] == 400 and tiles[0] < 4_000_000 / 200


@pytest.mark.parametrize("tile", [4096, 10])
def test_coherence_against_brute_force(spark, monkeypatch, tile):
    """All medians by passes, with half of the points in one cell."""
    monkeypatch.setattr(spatial, "TILE", tile)
    monkeypatch.setattr(aggregates, "SETTLED", 50)
    rows, df = crowd(spark, 150, 3)
    got = {r.radius: r for r in audits.coherence(df, "id", ["x", "y", "z"], "v", [0.3, 1.0, 0.6]).collect()}
    from skyweave.operators import layout

    control = {r.id: r.shuffled_v for r in layout.shuffled(df, "id", "v").collect()}
    for radius in (0.3, 0.6, 1.0):
        pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if far(a, b) <= radius]
        d, c = [abs(a[4] - b[4]) for a, b in pairs], [abs(control[a[0]] - control[b[0]]) for a, b in pairs]
        r = got[radius]
        assert r.pairs == len(pairs) and r.median_diff == pytest.approx(np.median(d)) and r.shuffled_median_diff == pytest.approx(np.median(c))
        assert r.smoothness == pytest.approx(np.median(d) / np.median(c))


def test_bins_by_ranks(spark):
    rows, df = crowd(spark, 300, 4)
    got = {r.bin: r for r in audits.by_bins(df.withColumn("w", F.col("v") + F.col("x")), "y", "v", "w", [("a", -9.0, 0.0), ("b", 0.0, 0.5), ("c", 50.0, 60.0)]).collect()}
    assert set(got) == {"a", "b"}
    for name, low, high in (("a", -9.0, 0.0), ("b", 0.0, 0.5)):
        d = [abs((r[4] + r[1]) - r[4]) for r in rows if low <= r[2] < high]
        assert got[name].rows == len(d) and got[name].median_diff == pytest.approx(np.median(d)) and got[name].p99_diff == pytest.approx(np.percentile(d, 99))


INF = float("inf")
BANDS = [(0, -INF, INF), (1, -INF, 0.0), (2, 3.0, INF), (3, 1.0, 1.0), (4, 2.0, 1.0), (5, None, 4.0), (6, 1.0, None), (7, float("nan"), 2.0), (8, 1e-9, 2e-9), (9, -1e300, 1e300), (10, 5e9, 6e9)]


def test_interval_tables(spark):
    g = random.Random(6)
    bands = BANDS + [(100 + k, a := g.uniform(-50, 50), a + g.choice([0.0, 1e-12, 0.1, 3.0, 40.0])) for k in range(400)]
    values = [(k, x) for k, x in enumerate([None, float("nan"), INF, -INF, 0.0, -0.0, 1e-9, 1.5e-9, 2e-9, 3.0, *(g.uniform(-60, 60) for _ in range(300)), *(b[1] for b in bands[20:60])])]
    rows, table = spark.createDataFrame(values, "id long, v double"), spark.createDataFrame(bands, "band long, low double, high double")
    got = sorted((r.id, r.band) for r in joins.in_intervals(rows, "v", table, "low", "high").collect())
    want = sorted((i, b) for i, v in values if v is not None and abs(v) < INF for b, lo, hi in bands if lo is not None and hi is not None and lo <= v < hi)
    assert got == want and len(got) > 3000
    assert joins.in_intervals(rows.where("id < 4"), "v", table, "low", "high").count() == 0 == joins.in_intervals(rows, "v", table.limit(0), "low", "high").count()
    with pytest.raises(ValueError, match="band"):
        joins.in_intervals(rows.withColumn("band", F.lit(1)), "v", table, "low", "high")


def test_interval_joins_have_no_nested_loop(spark):
    bands = spark.range(5000).select(F.col("id").alias("band"), (F.col("id") * 2.0).alias("low"), (F.col("id") * 2.0 + F.col("id") % 7).alias("high"))
    rows = spark.range(20_000).select("id", (F.col("id") / 2).alias("v"))
    out = joins.in_intervals(rows, "v", bands, "low", "high")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == sum(1 for k in range(20_000) for b in range(max(0, int(k / 4) - 4), int(k / 4) + 1) if 2 * b <= k / 2 < 2 * b + b % 7)
