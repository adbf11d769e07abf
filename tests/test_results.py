"""Results that have one right answer outside this library: names of files, report keys, statistics, distances."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates
from skyweave.plans import field, region
from skyweave.sources import text
from tests.test_sources import sky_points

NAMES = {
    "BGS_BRIGHT-21.5_NGC_clustering.dat.fits": ("BGS", "NGC", None, "data"),
    "LRG_SGC_17_clustering.ran.fits": ("LRG", "SGC", 17, "random"),
    "LRG+ELG_LOPnotqso_SGC_0_clustering.ran.fits": ("LRG_ELG", "SGC", 0, "random"),
    "ELG_LOPnotqso_NGC_clustering.dat.fits": ("ELG", "NGC", None, "data"),
    "QSO_NGC_3_clustering.ran.fits": ("QSO", "NGC", 3, "random"),
}


def test_names_of_all_five_tracers(spark, tmp_path):
    for n in (*NAMES, "MWS_NGC_clustering.dat.fits", "ELG_NGC_clustering.fits", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    found = {r.file: (r.tracer, r.region, r.random_index, r.kind) for r in text.local_files(spark, str(tmp_path)).collect()}
    assert found == NAMES
    assert [r.file for r in text.unknown_files(spark, str(tmp_path)).collect()] == ["MWS_NGC_clustering.dat.fits"]
    with pytest.raises(gates.GateError, match="MWS"):
        text.local_files(spark, str(tmp_path), strict=True)


def test_histograms_have_the_reports_keys(spark, tmp_path):
    _, df = sky_points(spark)
    for component in ("both", "rsd", "fog"):
        out = region.query(df, "targetid", ["x", "y", "z"], 7, 100.0, 100.0, 120.0, component=component)
        assert list(out["histograms"]) == ["Signed RSD displacement", "Absolute RSD displacement", f"Absolute applied displacement ({component})"]
        assert all(list(h) == ["binEdgesMpc", "counts", "zeroCount", "outsidePlottedP99Range"] and len(h["binEdgesMpc"]) == 41 and len(h["counts"]) == 40 for h in out["histograms"].values())
    region.write(out, str(tmp_path / "r"))
    assert json.loads((tmp_path / "r/histograms.json").read_text())["Signed RSD displacement"]["counts"] == out["histograms"]["Signed RSD displacement"]["counts"]
    rows = region.box(df.withColumn("applied", sky.applied(F.col("fog"), F.col("rsd"), "both")), "targetid", ["x", "y", "z"], 7, tuple(x / sky.MPC_TO_MLY for x in (100.0, 100.0, 120.0)), "applied").collect()
    rsd = np.array([r.rsd for r in rows])
    top = np.percentile(np.abs(rsd[rsd != 0]), 99)
    want = np.histogram(rsd[rsd != 0], np.linspace(-top, top, 41))[0].tolist()
    assert out["histograms"]["Signed RSD displacement"]["counts"] == want and out["histograms"]["Absolute RSD displacement"]["counts"] == np.histogram(np.abs(rsd[rsd != 0]), np.linspace(0, top, 41))[0].tolist()


def test_shift_statistics_against_numpy(spark):
    rng = np.random.default_rng(8)
    s, p = rng.normal(size=(500, 3)), rng.normal(size=(500, 3)) + 5
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(s, p)], "a double, b double, c double, x double, y double, z double")
    got = field.shift_statistics(df, ["a", "b", "c"], ["x", "y", "z"]).first()
    radial = (s * p).sum(1) / np.linalg.norm(p, axis=1)
    size = np.linalg.norm(s, axis=1)
    for name, x, ranks in (("size", size, (50, 75, 90, 95, 99, 100)), ("radial", abs(radial), (50, 75, 90, 95, 99, 100)), ("transverse", np.sqrt(size**2 - radial**2), (50, 90, 99, 100))):
        assert got[f"{name}_mean"] == pytest.approx(x.mean()) and [got[f"{name}_p{k}"] for k in ranks] == pytest.approx(np.percentile(x, ranks))


def test_agreement_has_percentiles_of_both_sides(spark):
    rng = np.random.default_rng(9)
    ref = rng.normal(size=300)
    got = ref + rng.normal(size=300) / 10
    r = aggregates.agreement(spark.createDataFrame([(float(a), float(b)) for a, b in zip(got, ref)], "g double, r double"), "g", "r").first()
    for name, x in (("ref", ref), ("got", got)):
        assert [r[f"{name}_p{k}"] for k in (1, 50, 99)] == pytest.approx(np.percentile(x, [1, 50, 99]))
    assert r.pearson == pytest.approx(np.corrcoef(got, ref)[0, 1])


def test_distance_table_has_the_catalogues_nodes(spark):
    z = np.linspace(0, 3.4, 2000)
    df = spark.createDataFrame([(float(x),) for x in z], "z double")
    got = np.array([r.d for r in df.select("z", sky.comoving_distance(F.col("z"), 3.4).alias("d")).orderBy("z").collect()])
    grid = np.linspace(0, 3.4 * 1.001, 16384)
    assert got == pytest.approx(np.interp(z, grid, sky.comoving_distances(grid.tolist())), rel=1e-12)
    plan = df.select(sky.comoving_distance(F.col("z"), 3.4).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # folded to one literal
