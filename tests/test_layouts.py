"""Tables by Z-order and by identity: the same rows as plain ones, and less read."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import gates, identity, joins, zorder
from skyweave.plans import region


def scanned(df, metric="numFiles"):
    """What the scans of a plan that ran here say."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply(metric).value() for k in range(leaves.size()) if leaves.apply(k).metrics().contains(metric))


def cloud(spark, n=20_000):
    g = random.Random(4)
    crowd = lambda: g.gauss(80, 0.5) if g.random() < 0.5 else g.uniform(-100, 100)
    rows = [(k, crowd(), crowd(), crowd(), k % 7) for k in range(n)]
    return spark.createDataFrame(rows, "targetid long, x double, y double, z double, label int")


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("z")) + "/t"
    points = cloud(spark).repartition(4).cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    zorder.store(points, folder, ["x", "y", "z"])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return points, zorder.Laid(spark, folder)


def test_boxes_have_their_points(spark, laid):
    points, table = laid
    assert table.points().exceptAll(points).count() == 0 and table.points().count() == points.count()
    g = random.Random(2)
    for size in (1.0, 10.0, 90.0, 500.0):
        low = [g.uniform(-110, 90) for _ in range(3)]
        high = [x + size for x in low]
        want = points.where(" AND ".join(f"{c} BETWEEN {lo!r} AND {hi!r}" for c, lo, hi in zip("xyz", low, high)))
        assert sorted(table.within_box(low, high).collect()) == sorted(want.collect())
    assert table.within_box([300.0] * 3, [400.0] * 3).count() == 0 and table.within_box([5.0] * 3, [4.0] * 3).count() == 0


def test_what_is_read_falls_with_the_box(laid):
    _, table = laid
    files = [scanned(table.within_box([-90.0] * 3, [-90.0 + s] * 3)) for s in (5.0, 60.0, 190.0)]
    every = scanned(table.points())
    assert files[0] < files[1] < files[2] <= every and files[0] <= every / 8
    rows = scanned(table.within_box([79.9] * 3, [80.1] * 3), "numOutputRows")
    assert rows < 20_000 / 4  # row groups, though a quarter of the points crowd there


def test_covers_hold_the_box():
    g = random.Random(3)
    spread = lambda c: sum((c >> b & 1) << 3 * b for b in range(10))
    for _ in range(60):
        low = [g.randrange(1024) for _ in range(3)]
        high = [min(1023, x + g.choice([0, 1, 30, 600])) for x in low]
        ranges = zorder.cover(low, high, 48)
        assert len(ranges) <= 56 and all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
        for _ in range(50):
            z = sum(spread(g.randint(a, b)) << k for k, (a, b) in enumerate(zip(low, high)))
            assert any(a <= z <= b for a, b in ranges)
        assert sum(b - a + 1 for a, b in zorder.cover(low, high, 200)) <= sum(b - a + 1 for a, b in zorder.cover(low, high, 20))
    assert zorder.cover([0] * 3, [1023] * 3) == [(0, (1 << 30) - 1)]


def test_store_refuses(spark, tmp_path):
    odd = spark.createDataFrame([(1, 0.0, 0.0, float("nan"))], "targetid long, x double, y double, z double")
    for bad in (odd, odd.withColumn("z", F.lit(None).cast("double")), odd.withColumn("z", F.lit(0.0)).withColumn("_z", F.lit(1))):
        with pytest.raises(gates.GateError):
            zorder.store(bad, str(tmp_path / "a"), ["x", "y", "z"])
    same = spark.createDataFrame([(k, 1.0, 2.0, 3.0) for k in range(5)], "targetid long, x double, y double, z double")
    zorder.store(same, str(tmp_path / "b"), ["x", "y", "z"])
    assert zorder.Laid(spark, str(tmp_path / "b")).within_box([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]).count() == 5


def test_pruned_region_is_the_region(spark, laid, tmp_path):
    points, table = laid
    known = spark.table(identity.store(points.select("targetid", "x", "y", "z"), "targetid", str(tmp_path / "ids"), 8))
    for target in (11, 500, 19_999):
        delta = F.col("label") * 0.5
        got = region.pruned_box(table, known, "targetid", target, (20.0, 30.0, 15.0), delta)
        want = region.box(points.withColumn("delta", delta), "targetid", ["x", "y", "z"], target, (20.0, 30.0, 15.0))
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_identity_joins_without_exchange(spark, tmp_path):
    a = spark.range(5000).select(F.col("id").alias("targetid"), (F.col("id") * 2).alias("v"))
    b = spark.range(0, 9000, 3).select(F.col("id").alias("targetid"), F.lit(1.5).alias("w"))
    left, right = (spark.table(identity.store(t, "targetid", str(tmp_path / n), 8)) for n, t in (("a", a), ("b", b)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (joins.lookup(left, right, "targetid", "w"), joins.members(left, right, "targetid"), joins.with_multiplicity(left, right, "targetid"), left.join(right, "targetid", "full_outer")):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plain = joins.lookup(a, b, "targetid", "w")
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(joins.lookup(left, right, "targetid", "w").collect()) == sorted(plain.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_identity_reads_one_bucket(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 3999).alias("targetid"), F.col("id").alias("row_index"), (F.col("id") / 8).cast("float").alias("fog_mpc"), F.lit(0.5).cast("float").alias("rsd_mpc"))
    name = identity.store(rows, "targetid", str(tmp_path / "t"), 16)
    one = lambda table: scanned(identity.find(table, "targetid", 77), "numOutputRows")
    assert scanned(spark.table(name), "numOutputRows") == 4000 and one(spark.table(name)) < 400  # a bucket of 16
    again = identity.attach(spark, name + "_again", str(tmp_path / "t"), "targetid bigint, row_index bigint, fog_mpc float, rsd_mpc float", "targetid", 16)
    assert one(again) == one(spark.table(name)) and identity.find(again, "targetid", 77).first().row_index == 77
    other = spark.table(identity.store(rows.where("targetid > 3000"), "targetid", str(tmp_path / "u"), 4))
    assert identity.inspect({"A": other, "B": again}, 0) == [{"tracer": "B", "row": 0, "fogMpc": 0.0, "rsdMpc": 0.5, "combinedMpc": 0.5}, {"tracer": "B", "row": 3999, "fogMpc": 499.875, "rsdMpc": 0.5, "combinedMpc": 500.375}]
    assert identity.inspect({"A": other, "B": again}, 3500)[0]["tracer"] == "A"
    with pytest.raises(gates.GateError):
        identity.inspect({"A": other}, 5)
