"""Percentiles by passes and nearest neighbours against numpy, on values and places that are hard for bins and cells."""

import numpy as np
import pytest

from skyweave.operators import aggregates, gates, kdtree, spatial


def test_percentiles_by_passes(spark, monkeypatch):
    r = np.random.default_rng(3)
    kinds = {"normal": r.normal(size=3000), "heavy": r.standard_cauchy(3000) * 1e6, "ties": r.integers(0, 3, 3000).astype(float), "one": np.full(500, 7.0), "few": np.array([1.0, 2.0]), "tight": 1 + r.integers(0, 5, 400) * 2.0**-52, "wide": np.array([-1.7e308, 1.7e308, 0.0] * 50), "small": r.integers(0, 9, 300) * 5e-324}
    rows = [(name, float(x)) for name, xs in kinds.items() for x in xs] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6).cache()
    points = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    for settled in (20_000, 50, 1):
        monkeypatch.setattr(aggregates, "SETTLED", settled)
        monkeypatch.setattr(aggregates, "BINS", 16 if settled < 100 else 2048)
        got = aggregates.exact_percentiles(df, "x", points, "g")
        assert sorted(got) == sorted(kinds)
        same = {x["g"]: x["p"] for x in df.groupBy("g").agg(aggregates.percentiles("x", points).alias("p")).collect()}
        for name in kinds:
            assert got[name] == pytest.approx(same[name], rel=1e-15, abs=0)
    normal = df.where("g = 'normal'")
    assert aggregates.exact_percentiles(normal, "x", [0.5])[0][0] == pytest.approx(np.median(kinds["normal"]), rel=1e-15)
    assert aggregates.exact_percentiles(normal.limit(0), "x", [0.5]) == {}
    with pytest.raises(gates.GateError, match="finite"):
        aggregates.exact_percentiles(spark.createDataFrame([(float("nan"),)], "x double"), "x", [0.5])
    monkeypatch.setattr(aggregates, "GROUPS", 3)
    with pytest.raises(gates.GateError, match="groups"):
        aggregates.exact_percentiles(df, "x", [0.5], "g")


@pytest.mark.parametrize("leaf", [1, 64, 4096])
def test_nearest_of_far_and_clustered_points(spark, monkeypatch, leaf):
    """Two clumps, equal points, queries far outside the box, and fewer points than neighbours."""
    monkeypatch.setattr(kdtree, "LEAF", leaf)
    r = np.random.default_rng(8)
    near = np.concatenate([r.normal(0, 0.01, (150, 3)), r.normal(50, 3, (100, 3)), np.zeros((20, 3)), r.uniform(0, 60, (40, 3))])
    asked = np.concatenate([near[::4], r.uniform(-500, 900, (40, 3)), [[0, 0, 0]]])
    frame = lambda x, first: spark.createDataFrame([(first + i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    for points, k in ((near, 1), (near, 8), (near[:5], 8)):
        got = spatial.nearest(frame(asked, 1000), frame(points, 0), "id", ["x", "y", "z"], k).collect()
        held = {}
        for row in got:
            held.setdefault(row.q_id, []).append((row["rank"], row.p_id, row.distance))
        assert len(held) == len(asked)
        for i, a in enumerate(asked):
            d = np.sqrt((((a - points) ** 2)[:, 0] + ((a - points) ** 2)[:, 1]) + ((a - points) ** 2)[:, 2])
            want = sorted((x, j) for j, x in enumerate(d))[:k]
            mine = sorted(held[1000 + i])
            assert [x[0] for x in mine] == list(range(1, len(want) + 1))
            assert [x[2] for x in mine] == pytest.approx([x for x, _ in want], abs=1e-12)
            assert [x[1] for x in mine] == [j for _, j in want]
