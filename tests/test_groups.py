"""Percentiles of many groups, some of them hot, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import aggregates, gates

POINTS = [0.0, 0.01, 0.5, 0.9, 1.0]


def groups(seed=1):
    g = np.random.default_rng(seed)
    out = {f"g{k}": g.normal(k, 1 + k, g.integers(1, 60)) for k in range(40)}
    out["hot"] = np.concatenate([g.lognormal(0, 3, 3000), np.full(900, 7.0), -g.lognormal(0, 3, 100)])
    out["ties"] = g.integers(0, 3, 800).astype(float)
    out["same"] = np.full(500, 2.5)
    out["wide"] = np.concatenate([g.normal(0, 1e-9, 300), [-1e300, 1e300]])
    return out


def frame(spark, data):
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("g0", None), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("small", [20_000, 50, 0])
def test_percentiles_of_groups(spark, monkeypatch, small):
    monkeypatch.setattr(aggregates, "SMALL_GROUP", small)
    monkeypatch.setattr(aggregates, "GROUP_BINS", 16)
    data = groups() | {None: np.arange(300.0)}
    got = {r.k: (r.n, r.p) for r in aggregates.grouped_percentiles(frame(spark, data), "k", "v", POINTS).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        assert got[k][0] == len(v) and got[k][1] == pytest.approx(np.percentile(v, [100 * p for p in POINTS]), rel=1e-12, abs=1e-12)


def test_a_hot_group_is_no_buffer(spark, monkeypatch):
    """Large groups go by passes whose plans hold no percentile() of their rows."""
    monkeypatch.setattr(aggregates, "SMALL_GROUP", 100)
    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 200).cast("string"))).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    out = aggregates.grouped_percentiles(df, "k", "v", [0.5])
    want = {r.k: (r.n, [r.m]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.median("v").alias("m")).collect()}
    assert {r.k: (r.n, list(r.p)) for r in out.collect()} == want
    with pytest.raises(gates.GateError):
        aggregates.grouped_percentiles(df.withColumn("v", F.lit(float("inf"))), "k", "v", [0.5])
    assert aggregates.grouped_percentiles(df.limit(0), "k", "v", [0.5]).count() == 0


@pytest.mark.parametrize("small", [20_000, 50])
def test_robust_spread_of_hot_groups(spark, monkeypatch, small):
    monkeypatch.setattr(aggregates, "SMALL_GROUP", small)
    data = {k: v for k, v in groups(2).items() if k != "wide"}
    got = {r.k: r for r in aggregates.robust_spread(frame(spark, data).where("v IS NOT NULL"), "k", "v").collect()}
    for k, v in data.items():
        mid = np.median(v)
        assert (got[k].n, got[k].median_v) == (len(v), pytest.approx(mid)) and got[k].spread_v == pytest.approx(1.4826 * np.median(np.abs(v - mid)))
