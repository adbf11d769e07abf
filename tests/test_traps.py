"""Traps of single precision, rounding, wrapping, ties and missing values, and the gates."""

import math

import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates, joins, layout, spatial
from skyweave.plans import audits, corrections, groups

NAN, INF = float("nan"), float("inf")


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_rounding_is_half_even(spark):
    assert one(spark, *[sky.quantise_position(F.lit(x), 1.0) for x in (0.5, 1.5, 2.5, -0.5, -1.5)]) == [0, 2, 2, 0, -2]


def test_bounds_compare_in_single_precision(spark):
    df = spark.createDataFrame([(2.1,), (2.0999,), (0.1,)], "z float")
    assert [r[0] for r in df.select(joins.interval32(F.col("z"), corrections.FIELDS)).collect()] == [None, "QSO", "BGS"]


def test_wrap(spark):
    assert one(spark, *[sky.wrap16(F.lit(x)) for x in (32767, 32768, -32769, 65536, -65535)]) == [32767, -32768, 32767, 0, 1]


def test_codes_of_odd_values(spark):
    mags = one(spark, *[sky.magnitude(F.lit(x)) for x in (0.0, -1.0, NAN, 1.0)])
    assert math.isnan(mags[0]) and math.isnan(mags[1]) and mags[3] == 22.5
    assert one(spark, sky.quantise_colour(F.lit(NAN), 85), sky.quantise_radius(F.lit(1e9)), sky.quantise_radius(F.lit(NAN)), sky.morphology_code(F.lit("REX ")), sky.morphology_code(F.lit("DUP"))) == [128, 255, 0, 1, 255]
    assert one(spark, *[sky.finite(F.lit(x)) for x in (NAN, INF, -INF, 1.0, None)]) == [False, False, False, True, False]


def test_flags(spark):
    flags = lambda dark, bright: one(spark, sky.target_flags(F.lit(dark).cast("bigint"), F.lit(bright).cast("bigint")))[0]
    assert [flags(0, 2), flags(7, 0), flags(0, 0), flags(0, 16)] == [3, 28, 32, 32]


def test_compression_example(spark):
    assert one(spark, sky.compressed_delta(F.lit(20.0), F.lit(0.5)), sky.compressed_delta(F.lit(9999.0), F.lit(0.08)), sky.compression(F.lit(100.0), F.lit(1.0))) == [-10.0, -300.0, 0.08]


def test_displacement_of_the_origin(spark):
    zero = [F.lit(0.0)] * 3
    assert one(spark, *sky.displace(zero, F.lit(5.0))) == [0.0, 0.0, 0.0]
    assert one(spark, *sky.displace([F.lit(3.0), F.lit(0.0), F.lit(4.0)], F.lit(-5.0))) == pytest.approx([0.0, 0.0, 0.0])
    for center in ((0.0, 0.0, 9.0), (1.0, 2.0, 3.0)):
        frame = sky.basis(center)
        for i, a in enumerate(frame):
            for j, b in enumerate(frame):
                assert sum(x * y for x, y in zip(a, b)) == pytest.approx(float(i == j))


def test_antipodes_and_same_place(spark):
    assert one(spark, sky.angular_separation(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)), sky.angular_separation(F.lit(0.0), F.lit(90.0), F.lit(7.0), F.lit(-90.0))) == pytest.approx([0.0, math.pi], abs=1e-7)


def test_comoving_distance(spark):
    d = sky.comoving_distances([0.0, 0.1, 1.0])
    assert d[0] == 0 and 420 < d[1] < 440 and 3350 < d[2] < 3450
    got = one(spark, *[sky.comoving_distance(F.lit(z), 1.0) for z in (0.1, 1.0)])
    assert got == pytest.approx(d[1:], rel=1e-5)


def test_dedup_ties_go_to_the_earliest_row(spark):
    df = spark.createDataFrame([(1, 5.0, 3), (1, 5.0, 2), (1, 4.0, 1), (2, None, 9), (3, 1.0, 7), (3, 1.0, 7)], "targetid long, weight double, row_index long")
    got = sorted(map(tuple, aggregates.keep_best(df, "targetid", F.col("weight"), -F.col("row_index")).collect()))
    assert got == [(1, 5.0, 2), (2, None, 9), (3, 1.0, 7)]


def test_conflicts_and_paired_nan(spark):
    df = spark.createDataFrame([(1, NAN, "a"), (1, NAN, "a"), (2, 1.0, "a"), (2, 2.0, "a"), (3, None, "b"), (3, None, "b"), (4, 1.0, "c"), (4, None, "c"), (5, NAN, "a"), (5, 1.0, "a")], "k long, x double, s string")
    assert sorted(r.k for r in aggregates.conflict_free(df, "k", ["x", "s"]).collect()) == [1, 3]


def test_override_replaces_misses(spark):
    value = lambda z, new: one(spark, joins.override_range(F.lit(7.0), F.lit(new).cast("double"), F.lit(z), 0.01, 0.4))[0]
    assert [value(0.2, None), value(0.2, 3.0), value(0.4, 3.0), value(0.01, None)] == [0.0, 3.0, 7.0, 0.0]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0, 1, 2, 3, 4, 10**6]] + [(NAN,), (INF,), (None,)], "x double")
    rows = {r.bin: r for r in aggregates.histogram(df, "x", 4).collect()}
    assert len(rows) == 6 and rows[-2].n == 2 and sum(r.n for r in rows.values()) == 7 and rows[3].high > 4
    empty = {r.bin: r.n for r in aggregates.histogram(df.limit(0), "x", 4).collect()}
    assert len(empty) == 6 and not any(empty.values())


def test_wilson_without_a_sample(spark):
    df = spark.createDataFrame([(0, 0), (5, 10)], "s long, n long")
    got = df.select(*aggregates.wilson(F.col("s"), F.col("n"), F.lit(1000))).collect()
    assert sorted(map(list, got)) == [[0.0, 0.0, 0.0], [500.0, 237.0, 763.0]]


def test_gates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (2, 2.0)], "k long, x double")
    with pytest.raises(gates.GateError):
        gates.unique(df, "k")
    with pytest.raises(gates.GateError):
        gates.unique_and_finite(df, "k", "x")
    with pytest.raises(gates.GateError):
        gates.within(df.where("x = 2"), "x", 1.5)
    with pytest.raises(gates.GateError):
        gates.exactly_one(df.where("k = 2"))
    with pytest.raises(gates.GateError):
        gates.row_count(df, 12)
    with pytest.raises(gates.GateError):
        gates.coverage(df, F.col("k") == 3)
    with pytest.raises(gates.GateError):
        gates.not_relaxed({"r": 0.9, "m": 0.2}, {"r": 0.995, "m": -0.1})
    with pytest.raises(gates.GateError):
        joins.disjoint_union(df, df.where("k = 1"), "k")
    with pytest.raises(gates.GateError):
        joins.one_to_one(df, df, "k")
    with pytest.raises(gates.GateError):
        gates.untouched(df.where("k = 1"), df.where("k = 1").withColumn("x", F.lit(3.0)), "k", ["x"])
    with pytest.raises(gates.GateError):
        gates.exclusive(a=True, b=True)
    gates.exclusive(a=True, b=False)
    gates.not_relaxed({"r": 0.999, "m": 0.1}, {"r": 0.995, "m": -0.1})
    gates.within(df.where("x = 2"), "x", 2.0)


def test_ordinal_ties_to_no_partitioning(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id AS other").repartition(7)
    assert all(r.k == r.ordinal for r in layout.ordinal(df, "k").collect())
    assert layout.ordinal(df.limit(0), "k").count() == 0
    assert sorted(r.n for r in layout.equal_split(df, "k", 7).groupBy("part").agg(F.count("*").alias("n")).collect()) == [142] + [143] * 6
    assert layout.even_picks(df, "k", 5000).count() == 1000


def test_nearest_is_exact(spark):
    import random

    r = random.Random(3)
    points = [(k, r.gauss(0, 1) * (0.01 if k % 3 else 5), r.random(), r.random()) for k in range(300)]
    df = spark.createDataFrame(points, "id long, x double, y double, z double")
    got = {(a.q_id, a.rank): a for a in spatial.nearest(df.where("id % 2 = 1"), df.where("id % 2 = 0"), "id", ["x", "y", "z"], 4).collect()}
    for q in points:
        if q[0] % 2:
            want = sorted((math.dist(q[1:], p[1:]), p[0]) for p in points if p[0] % 2 == 0)[:4]
            for k, (d, i) in enumerate(want, 1):
                assert got[q[0], k].p_id == i and got[q[0], k].distance == pytest.approx(d)
    assert spatial.nearest(df, df.limit(0), "id", ["x", "y", "z"]).count() == 0
    pairs = {(p.a, p.b) for p in spatial.pairs_within(df, "id", ["x", "y", "z"], 0.2).collect()}
    assert pairs == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 0.2}


def test_groups(spark):
    rows = [(1, k, k < 6, float(o), float(a)) for k, (o, a) in enumerate([(-40, 1), (-20, 2), (0, 3), (20, 4), (40, 5), (60, 6), (500, 7)])]
    rows += [(2, 100 + k, True, float(k), 1.0) for k in range(9)] + [(3, 200 + k, k < 4, float(k * 9), float(k)) for k in range(9)]
    stats, moved = groups.compress(spark.createDataFrame(rows, "igrp long, igal long, spec boolean, offset double, across double"))
    (s,) = stats.collect()
    assert s.igrp == 1 and s.spec == 6 and s.alpha == 0.08 or s.alpha == pytest.approx(s.sigma_perp / s.sigma_parallel)
    d = {m.igal: m.delta_mpc for m in moved.collect()}
    assert d[0] == pytest.approx((s.alpha - 1) * -40) and d[6] == -300.0 and d[100] == 0 and d[200] == 0


def test_corrections(spark):
    viewer = spark.createDataFrame([(0, 0, 1, 0.2), (0, 1, 2, 0.2), (1, 0, 3, 0.5), (1, 1, 4, 5.0), (1, 2, 5, 0.05)], "chunk int, pos_in_chunk long, targetid long, z float")
    fog = spark.createDataFrame([(1, 2.0)], "targetid long, delta_mpc double")
    rsd = spark.createDataFrame([("BGS", 1, 1.0), ("LRG", 1, 9.0), ("BGS", 2, 3.0), ("LRG", 3, 4.0)], "tracer string, targetid long, delta_mpc float")
    low = spark.createDataFrame([(1, 7.0), (5, 8.0)], "targetid long, delta_mpc double")
    got = {r.targetid: (r.fog_mpc, r.rsd_mpc, r.field, r.matched) for r in corrections.materialise(viewer, fog, rsd).collect()}
    assert got == {1: (2.0, 1.0, "BGS", True), 2: (0.0, 3.0, "BGS", True), 3: (0.0, 4.0, "LRG", True), 4: (0.0, 0.0, None, False), 5: (0.0, 0.0, None, False)}
    got = {r.targetid: (r.rsd_mpc, r.matched) for r in corrections.materialise(viewer, fog, rsd, low).collect()}
    assert got == {1: (7.0, True), 2: (0.0, False), 3: (4.0, True), 4: (0.0, False), 5: (8.0, True)}
    assert {r.chunk: r.rows for r in corrections.totals(corrections.materialise(viewer, fog, rsd)).collect()} == {0: 2, 1: 3, None: 5}
    with pytest.raises(gates.GateError):
        corrections.extend(rsd, rsd.limit(1))
    with pytest.raises(gates.GateError):
        corrections.materialise(viewer, fog.withColumn("delta_mpc", F.lit(999.0)), rsd)


def test_pairs_and_reports(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0), (2, 0.0, 3.0)], "targetid long, fog_mpc float, rsd_mpc float")
    cat = spark.createDataFrame([(0, 2), (1, 9), (2, 1), (3, 1)], "row_index long, targetid long")
    assert sorted(map(tuple, corrections.pairs(cat, rows).collect())) == [(0, 2, 0.0, 3.0), (1, 9, 0.0, 0.0), (2, 1, 1.0, 2.0), (3, 1, 1.0, 2.0)]
    with pytest.raises(gates.GateError):
        corrections.pairs(cat, rows.unionByName(rows.limit(1).withColumn("rsd_mpc", F.lit(5.0).cast("float"))))
    df = spark.createDataFrame([(0.05, 1.0, 2.0), (0.2, 0.0, 2.0), (0.3, 4.0, 4.0), (0.9, 1.0, 1.0)], "z double, a double, b double")
    got = {r.bin: (r.rows, r.both, r.median_diff) for r in audits.by_bins(df, "z", "a", "b", [("low", 0.0, 0.1), ("mid", 0.1, 0.4)]).collect()}
    assert got == {"low": (1, 1, 1.0), "mid": (2, 1, 1.0)}
    got = {r.shell: (r.before, r.after) for r in audits.shells(df, ["a", "a", "a"], {"after": ["b", "b", "b"]}, 2.0).collect()}
    assert sum(a for a, _ in got.values()) == sum(b for _, b in got.values()) == 4 and got[0] == (3, 1)


def test_shifts_of_several_fields_and_at_their_edges(spark):
    """Each point has the mesh of its own field; points outside the box have no row, none is cut short."""
    from itertools import product

    from skyweave.plans import field

    mesh = spark.createDataFrame([(f, i, j, k, s, 2 * s, float(i)) for f, s in (("a", 1.0), ("b", 5.0)) for i, j, k in product(range(4), repeat=3)], field.MESH)
    geometry = {f: {"low": [0.0, 0.0, 0.0], "shape": [4, 4, 4], "cell": 10.0} for f in "ab"}
    points = [(1, "a", 5.0, 5.0, 5.0), (2, "b", 5.0, 5.0, 5.0), (3, "a", 0.0, 29.9, 12.0), (4, "a", -0.1, 5.0, 5.0), (5, "b", 5.0, 30.0, 5.0), (6, "b", 5.0, 5.0, 99.0), (7, "c", 5.0, 5.0, 5.0)]
    got = field.shifts_at(spark.createDataFrame(points, "id long, field string, x double, y double, z double"), mesh, geometry, "id", ["x", "y", "z"]).collect()
    rows = sorted((r.id, r.field, round(r.sx, 9), round(r.sy, 9), round(r.sz, 9)) for r in got)
    assert rows == [(1, "a", 1.0, 2.0, 0.5), (2, "b", 5.0, 10.0, 0.5), (3, "a", 1.0, 2.0, 0.0)]
