"""Totals over intervals without pairs."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import joins
from skyweave.plans import queries


def totals():
    return {"n": (F.count("*"), F.sum), "s": (F.sum("w"), F.sum), "least": (F.min("w"), F.min)}


@pytest.mark.parametrize("count", [0, 1, 16, 17, 700])
def test_totals_against_brute_force(spark, count):
    rng, nan, inf = random.Random(count), float("nan"), float("inf")
    rows = [(round(rng.uniform(-3, 3), 2), rng.randrange(100)) for _ in range(count)] + [(None, 1), (nan, 1), (inf, 1)] + [(0.0, 5), (-0.0, 6)] * (count > 1)
    spans = [(k, *sorted((round(rng.uniform(-4, 4), 2), round(rng.uniform(-4, 4), 2)))) for k in range(120)]
    spans += [(200, -inf, inf), (201, 1.0, 1.0), (202, 2.0, -2.0), (203, None, 1.0), (204, nan, 1.0), (205, -1.0, inf), (206, -0.0, 0.01), (207, -1.0, 0.0), (208, -1.0, nan), (None, -1.0, 1.0), (None, -1.0, 1.0)]
    got = joins.interval_totals(spark.createDataFrame(rows, "v double, w long"), "v", spark.createDataFrame(spans, "id long, low double, high double"), "low", "high", totals())
    want = []
    for k, low, high in spans:
        hit = [w for v, w in rows if v is not None and abs(v) < inf and low is not None and high is not None and high == high and low <= v < high]
        if hit:
            want.append((k, len(hit), sum(hit), min(hit)))
    assert sorted(map(str, got.select("id", "n", "s", "least").collect())) == sorted(map(str, spark.createDataFrame(want, "id long, n long, s long, least long").collect()))


def test_range_join_makes_no_pairs(spark, tmp_path):
    """Each of 30,000 parts holds each of 60,000 prices: 1.8e9 pairs, which are not to be made."""
    price = 100 + F.col("id") / 1e5
    spark.range(60_000).select(F.col("id").alias("l_orderkey"), F.lit(2.0).alias("l_quantity"), (2 * price).alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(30_000).select(F.col("id").alias("p_partkey"), F.lit(100.5).alias("p_retailprice"), (F.lit(200) + F.col("id") % 7).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    joined = queries.QUERIES["q_range_join"](spark, str(tmp_path))
    assert joined.agg(F.count("*"), F.min("n"), F.max("n"), F.min("quantity"), F.max("first")).first() == (30_000, 60_000, 60_000, 120_000.0, 0)
