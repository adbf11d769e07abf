"""Round trips of the binary formats, text sources, streaming, and whole flows on a synthetic sky."""

import gzip
import io
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates, layout
from skyweave.plans import audits, catalogue, field, groups, region
from skyweave.sources import binary, text
from skyweave.streaming import match


def catalogue_file(path, version, n=25):
    r = np.random.default_rng(version)
    own = {"pos": r.integers(-32768, 32768, 3 * n), "zq": r.integers(0, 65536, n), "morph": r.integers(0, 256, n), "shape": r.integers(0, 256, n), "gr": r.integers(0, 256, n), "rz": r.integers(0, 256, n), "ra": r.random(n), "dec": r.random(n), "zwarn": r.integers(0, 9, n), "targetid": r.integers(1, 1 << 62, n)}
    with open(path, "wb") as f:
        f.write(binary.HEADER.pack(b"TEST", version, n, 9.5, 0.01, 2.5, *range(6)))
        for name, kind, _, v in binary.SECTIONS:
            if v <= version:
                f.write(np.asarray(own[name]).astype(kind).tobytes())
    return own


@pytest.mark.parametrize("version", [1, 2, 3])
def test_catalogue_source(spark, tmp_path, version):
    binary.register(spark)
    path = str(tmp_path / "c.bin")
    own = catalogue_file(path, version)
    rows = spark.read.format("sky_catalogue").option("rowsPerPartition", 7).load(path).orderBy("row_index").collect()
    assert [r.qy for r in rows] == own["pos"][1::3].tolist() and [r.zq for r in rows] == own["zq"].tolist()
    assert ("targetid" in rows[0]) == (version == 3) and binary.read_header(path)["zMax"] == 2.5
    if version == 3:
        assert [r.targetid for r in rows] == own["targetid"].tolist()
        again = str(tmp_path / "d.bin")
        head = binary.read_header(path)
        df = spark.read.format("sky_catalogue").load(path).repartition(3)
        df.write.format("sky_catalogue").mode("append").options(path=again, magic="TEST", count=25, bounds=",".join(map(str, head["bounds"])), **{k: head[k] for k in ("unitsPerMpc", "zMin", "zMax")}).save()
        assert open(again, "rb").read() == open(path, "rb").read()
        short = str(tmp_path / "e.bin")
        df.write.format("sky_catalogue").mode("append").options(path=short, version=2, magic="TEST", count=25, bounds=",".join(map(str, head["bounds"])), **{k: head[k] for k in ("unitsPerMpc", "zMin", "zMax")}).save()
        assert len(open(short, "rb").read()) == 48 + 12 * 25
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        binary.read_header(path)


def fits_file(path, rows):
    card = lambda k, v: f"{k:<8}= {v}".ljust(80).encode()
    pad = lambda b, c: b + c * (-len(b) % 2880)
    first = pad(b"".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), b"END".ljust(80)]), b" ")
    names = [("TARGETID", "K"), ("Z", "D"), ("SPECTYPE", "6A"), ("PRIMARY", "L"), ("RA", "1E"), ("VEC", "3I")]
    head = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", "33"), card("NAXIS2", str(len(rows))), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", "6")]
    for k, (n, f) in enumerate(names, 1):
        head += [card(f"TTYPE{k}", f"'{n}'"), card(f"TFORM{k}", f"'{f}' / form")]
    body = b"".join(struct.pack(">qd6scf3h", i, z, s.encode(), b"T" if p else b"F", ra, 1, 2, 3) for i, z, s, p, ra in rows)
    with open(path, "wb") as f:
        f.write(first + pad(b"".join([*head, b"END".ljust(80)]), b" ") + pad(body, b"\0"))


def test_fits_source(spark, tmp_path):
    binary.register(spark)
    rows = [(k + 1, k / 7, "QSO" if k % 2 else "GALAXY", bool(k % 3), float(k)) for k in range(11)]
    fits_file(tmp_path / "t.fits", rows)
    df = spark.read.format("fits_table").option("rowsPerPartition", 4).load(str(tmp_path / "t.fits"))
    assert df.columns == ["row_index", "targetid", "z", "spectype", "primary", "ra", "vec"] and df.first().vec == [1, 2, 3]
    assert [tuple(r)[1:-1] for r in df.orderBy("row_index").collect()] == rows


def points(spark, n=500, seed=5):
    r = np.random.default_rng(seed)
    rows = [(k, *map(int, r.integers(-32768, 32768, 3)), int(r.integers(0, 65536)), *map(int, r.integers(0, 256, 5)), float(np.float32(r.normal()))) for k in range(n)]
    return spark.createDataFrame(rows, "row_index long, qx int, qy int, qz int, zq int, type int, morph int, shape int, gr int, rz int, fog float")


def test_chunks_round_trip(spark, tmp_path):
    df = layout.ordered_chunks(points(spark), n=5).cache()
    sums = binary.write_files(binary.encode_chunks(df), str(tmp_path / "chunks")).collect()
    assert len(sums) == 5
    back = binary.decode_chunks(binary.files(spark, str(tmp_path / "chunks")))
    both = back.join(df.select("chunk", F.col("pos_in_chunk").cast("long"), F.col("qx").alias("a"), F.col("qy").alias("b"), F.col("qz").alias("c")), ["chunk", "pos_in_chunk"])
    assert both.count() == 500 and both.where("qx <> a OR qy <> b OR qz <> c").count() == 0
    binary.write_files(binary.encode_consolidated(df), str(tmp_path / "all")).collect()
    full = binary.decode_consolidated(binary.files(spark, str(tmp_path / "all")))
    keep = ["chunk", "pos_in_chunk", "type", "row_index", "qx", "qy", "qz", "zq", "morph", "shape", "gr", "rz"]
    assert full.select(*keep).exceptAll(df.select(*[F.col(c).cast(full.schema[c].dataType).alias(c) for c in keep])).count() == 0 and full.count() == 500
    binary.write_files(binary.encode_payload(df, "fog"), str(tmp_path / "fog")).collect()
    fog = binary.decode_payload(binary.files(spark, str(tmp_path / "fog")), "fog_back")
    assert fog.join(df.select("chunk", F.col("pos_in_chunk").cast("long"), "fog"), ["chunk", "pos_in_chunk"]).where("fog = fog_back").count() == 500
    a, b = gates.sequence_digest(df, "chunk", ["pos_in_chunk"], ["qx"]), gates.sequence_digest(df.repartition(7), "chunk", ["pos_in_chunk"], ["qx"])
    assert sorted(a.collect()) == sorted(b.collect())
    gates.digests(spark.read.format("binaryFile").load(str(tmp_path / "fog")), {s.name: s.sha256 for s in binary.write_files(binary.encode_payload(df, "fog"), str(tmp_path / "fog")).collect()})


def test_small_files(spark, tmp_path):
    ids = np.arange(5, dtype=np.uint64) + 10
    held = io.BytesIO()
    np.save(held, ids)
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids/targetid_003.npy.gz").write_bytes(gzip.compress(held.getvalue()))
    assert sorted(map(tuple, binary.decode_identities(binary.files(spark, str(tmp_path / "ids"))).collect())) == [(3, k, k + 10) for k in range(5)]
    (tmp_path / "caches").mkdir()
    np.savez(tmp_path / "caches/A_NGC_1.npz", targetid=ids, delta_mpc=np.ones(5, np.float32))
    assert binary.decode_caches(binary.files(spark, str(tmp_path / "caches"))).agg(F.sum("delta_mpc")).first()[0] == 5
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/p_001.bin").write_bytes(np.array([1, np.nan], "<f4").tobytes())
    with pytest.raises(Exception, match="finite"):
        binary.decode_payload(binary.files(spark, str(tmp_path / "bad"))).collect()


def test_text_sources(spark, tmp_path):
    for n in ("LRG_NGC_clustering.dat.fits", "LRG_NGC_0_clustering.ran.fits", "LRG_NGC_1_clustering.ran.fits", "other.txt"):
        (tmp_path / n).write_bytes(b"x")
    found = text.local_files(spark, str(tmp_path))
    assert found.count() == 3 and text.source_path(found, "LRG", "NGC", "random").endswith("LRG_NGC_0_clustering.ran.fits")
    sums = text.checksums(spark.createDataFrame([("a" * 64 + "  one.fits",), ("# note",), ("B" * 64 + " *./two.fits",)], "value string"))
    assert sorted(map(tuple, sums.collect())) == [("one.fits", "a" * 64), ("two.fits", "b" * 64)]
    assert [r.link for r in text.links(spark.createDataFrame([('<a href="x.fits">x</a> <a href="x.fits">',)], "html string"), "html", 'href="([^"]+)"').collect()] == ["x.fits"]
    (tmp_path / "p.csv").write_text("targetid,type,shape_r,flux_g,flux_r,flux_z\n1,PSF ,,1.5,2e1,-3\n")
    r = text.photometry_csv(spark, str(tmp_path / "p.csv")).first()
    assert r.type == "PSF" and math.isnan(r.shape_r) and (r.flux_g, r.flux_r, r.flux_z) == (1.5, 20.0, -3.0)
    old, new = (spark.createDataFrame(x, "tracer string, n int") for x in ([("A", 1), ("B", 2)], [("B", 3)]))
    assert sorted(map(tuple, text.merge_reports(old, new, ["tracer"]).collect())) == [("A", 1), ("B", 3)]
    a, b = (text.receipt(df, "tracer").first() for df in (old, old.repartition(3)))
    assert a == b and a.rows == 2
    assert text.as_json(new).first()[0] == '{"tracer":"B","n":3}'


def test_streaming_match_resumes(spark, tmp_path):
    catalogue = spark.createDataFrame([(k,) for k in range(0, 100, 2)] + [(4,)], "targetid long")
    known = match.known_keys(catalogue, "targetid", str(tmp_path / "known"), 4)
    run = lambda: match.match_new(spark, str(tmp_path / "in"), "targetid long", known, "targetid", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    for part in range(2):
        spark.range(part * 50, part * 50 + 50).toDF("targetid").write.mode("append").parquet(str(tmp_path / "in"))
        run()
        run()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 25 * (part + 1)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("source_hits")).first()[0] == 51


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    """The last commit is lost, as when a driver dies after writing: the batch comes again, and its rows are there once."""
    import os

    known = match.known_keys(spark.range(100).toDF("targetid"), "targetid", str(tmp_path / "known"), 4)
    run = lambda: match.match_new(spark, str(tmp_path / "in"), "targetid long", known, "targetid", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    for part in range(2):
        spark.range(part * 50, part * 50 + 50).toDF("targetid").write.mode("append").parquet(str(tmp_path / "in"))
        run()
    for name in ("1", ".1.crc"):
        if os.path.exists(tmp_path / "ck/commits" / name):
            os.remove(tmp_path / "ck/commits" / name)
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("targetid").distinct().count() == 100
    with pytest.raises(gates.GateError, match="checkpoint"):
        match.match_new(spark, str(tmp_path / "in"), "targetid long", known, "targetid", str(tmp_path / "out"), str(tmp_path / "other"))
    with pytest.raises(gates.GateError, match="known_keys"):
        match.match_new(spark, str(tmp_path / "in"), "targetid long", spark.range(3).toDF("targetid"), "targetid", str(tmp_path / "o"), str(tmp_path / "c"))


def zcat(spark, n=400):
    r = random.Random(9)
    rows = [(k, k + 1, r.choice([0.0, 359.999, 360.0, -1.0, r.random() * 360]), r.choice([90.0, 90.1, r.random() * 90]), r.choice([0.0045, 0.00449, float("nan"), r.random() * 2]), r.choice([0, 0, 0, 4]), r.choice(["GALAXY  ", "QSO", "STAR"]), r.choice(["TGT", "TGT", "SKY"]), r.random() < 0.9, *[r.choice([0, 1, 2, 4]) for _ in range(4)], *[r.choice([0, 1, 2, 8, 16]) for _ in range(4)]) for k in range(n)]
    return spark.createDataFrame(rows, "row_index long, targetid long, target_ra double, target_dec double, z double, zwarn long, spectype string, objtype string, zcat_primary boolean, " + ", ".join(f"{c}{m}_target long" for m in ("desi", "bgs") for c in ("", "sv1_", "sv2_", "sv3_")))


def test_catalogue_build(spark):
    rows = zcat(spark)
    picked = catalogue.select_primary(rows).collect()
    assert picked and all(r.z >= 0.0045 and 0 <= r.target_ra < 360 and abs(r.target_dec) <= 90 and r.zwarn == 0 for r in picked)
    built, parts = {}, []
    for kind in ("GALAXY", "QSO"):
        q, head = catalogue.build(rows, kind)
        assert q.agg(F.max(F.greatest(*[F.abs(c) for c in ("qx", "qy", "qz")]))).first()[0] == 32767 and head["count"] == q.count()
        flags = catalogue.target_flags(rows).select("targetid", "flags")
        parts.append((q.join(flags, "targetid"), head["unitsPerMpc"], kind == "QSO"))
        built[kind] = q
    chunked = catalogue.chunks(parts, min(u for _, u, _ in parts), 4)
    assert chunked.count() == len(picked) and chunked.where("(type & 64 <> 0) <> (class = 'QSO')").count() == 0
    catalogue.same_redshift_codes(built["QSO"], built["QSO"].withColumn("zq", F.col("zq") + 1))
    with pytest.raises(gates.GateError):
        catalogue.same_redshift_codes(built["QSO"], built["QSO"].withColumn("zq", F.col("zq") + 2))
    with pytest.raises(gates.GateError):
        catalogue.target_flags(rows, dark=["lost_target"])
    with pytest.raises(gates.GateError):
        catalogue.target_flags(rows.drop("bgs_target", "sv1_bgs_target", "sv2_bgs_target", "sv3_bgs_target"))
    for lost in (*catalogue.DARK, *catalogue.BRIGHT):
        with pytest.raises(gates.GateError if hasattr(gates, "GateError") else Exception, match=lost):
            catalogue.target_flags(rows.drop(lost))
    other = rows.withColumns({c: F.lit(7).cast("long") for c in ("mws_target", "scnd_target", "sv1_scnd_target", "cmx_target")})
    flags = lambda df: sorted((r.row_index, r.flags) for r in catalogue.target_flags(df).collect())
    assert flags(other) == flags(rows)


def test_photometry(spark):
    rows = spark.createDataFrame([(1, 255, 0, 128, 128), (2, 255, 0, 128, 128), (3, 1, 9, 9, 9), (4, 255, 0, 128, 128)], "targetid long, morph int, shape int, gr int, rz int")
    m = [(1, "REX ", 1.04, 1.0, 2.0, 4.0), (1, "REX ", 1.04, 1.0, 2.0, 4.0), (2, "PSF", 0.0, 1.0, 1.0, 1.0), (2, "DEV", 0.0, 1.0, 1.0, 1.0), (3, "PSF", 0.0, 1.0, 1.0, 1.0), (4, "DUP", 0.0, 1.0, 1.0, 1.0)]
    got = {r.targetid: tuple(r)[1:] for r in catalogue.photometry(rows, spark.createDataFrame(m, "targetid long, type string, shape_r double, flux_g double, flux_r double, flux_z double")).collect()}
    assert got[1][:2] == (1, 10) and got[1][2] == round((2.5 * math.log10(2) + 0.5) * 85) and got[2] == got[4] == (255, 0, 128, 128) and got[3] == (1, 9, 9, 9)


def test_clustering_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.4, 1.0, 2.0), (2, 1, 0.0, 0.0, 0.5, 1.0, 3.0), (3, 2, 0.0, 0.0, 0.8, 1.0, 1.0), (4, 3, 0.0, 0.0, 0.5, -1.0, 1.0), (5, 4, float("nan"), 0.0, 0.5, 1.0, 1.0)], "row_index long, targetid long, ra double, dec double, z double, weight double, weight_fkp double")
    got = catalogue.deduplicate_targets(catalogue.valid_clustering(df, 0.4, 0.8)).collect()
    assert [(r.row_index, r.weight) for r in got] == [(2, 3.0)]
    assert catalogue.valid_clustering(df.drop("weight_fkp"), 0.4, 0.8).count() == 2


def test_group_plan(spark):
    r = random.Random(2)
    gal = [(k, 150 + r.gauss(0, 0.01), 2 + r.gauss(0, 0.01), 0.1 + r.gauss(0, 0.003), 1, 9010, 5, k) for k in range(30)]
    galaxies = spark.createDataFrame(gal, "igal long, ra double, dec double, z double, zsrc int, release int, brickid int, objid int")
    cat = galaxies.select(sky.pack_target(F.col("objid"), F.col("brickid"), F.col("release")).alias("targetid")).where("targetid % 2 = 0")
    relation = spark.createDataFrame([(k, 1 if k < 25 else 2) for k in range(30)], "igal long, igrp long")
    table = spark.createDataFrame([(1, 25, 150.0, 2.0, 0.1), (2, 4, 150.0, 2.0, 0.1)], "igrp long, rich int, grp_ra double, grp_dec double, grp_z double")
    moved, stats = groups.plan(cat, galaxies, relation, table, 0.2)
    assert stats.count() == 1 and stats.first().elongation > 1.5 and moved.count() == 13 and moved.where("delta_mpc <> 0").count() == 13
    with pytest.raises(gates.GateError):
        groups.plan(cat, galaxies, relation, table.where("igrp = 1"), 0.2)


def sky_points(spark, n=300):
    r = random.Random(1)
    rows = [(k + 1, 100 + r.gauss(0, 10), 50 + r.gauss(0, 10), 20 + r.gauss(0, 10), r.choice([0.0, r.gauss(0, 3)]), r.gauss(0, 2)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "targetid long, x double, y double, z double, fog double, rsd double")


def test_region_query(spark, tmp_path):
    rows, df = sky_points(spark)
    out = region.query(df, "targetid", ["x", "y", "z"], 7, 100.0, 100.0, 120.0, "both")
    s = out["summary"]
    assert s["objectsInObservedBox"] == s["correctedPositionsStillInBox"] + s["correctedPositionsOutsideBox"] > 20
    center = [r for r in rows if r[0] == 7][0][1:4]
    frame, sides = sky.basis(center), [x / sky.MPC_TO_MLY for x in (100.0, 100.0, 120.0)]
    inside = [r for r in rows if all(abs(sum((p - c) * a for p, c, a in zip(r[1:4], center, axis))) <= d / 2 for axis, d in zip(frame, sides))]
    assert s["objectsInObservedBox"] == len(inside) and s["objectsWithNonzeroFoG"] == sum(r[4] != 0 for r in inside)
    both = np.abs([r[4] + r[5] for r in inside if r[4] + r[5]])
    assert s["absoluteAppliedDisplacementMpc"]["median"] == pytest.approx(np.median(both)) and s["absoluteAppliedDisplacementMpc"]["p95"] == pytest.approx(np.percentile(both, 95))
    top = out["largest"].collect()
    assert len(top) == 25 and top[0].targetid == max(inside, key=lambda r: abs(r[4] + r[5]))[0]
    assert len(out["histograms"]["Signed RSD displacement"]["binEdgesMpc"]) == 41 and len(out["histograms"]["Signed RSD displacement"]["counts"]) == 40
    region.write(out, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["comparison.svg", "histograms.json", "histograms.svg", "largest_displacements.csv", "summary.json"]
    with pytest.raises(gates.GateError):
        region.query(df, "targetid", ["x", "y", "z"], 9999, 1.0, 1.0, 1.0)


def test_field_of_a_linear_wave(spark):
    """A plane-wave overdensity: the solved displacement is the wave's, to linear order."""
    n, cell, size = 32, 10.0, 320.0
    x = np.arange(n) * cell
    k, amplitude = 2 * np.pi / size, 0.05
    low = [50_000.0, 0.0, 0.0]  # far away, so that the line of sight is the x axis
    data = np.broadcast_to((1 + amplitude * np.cos(k * x))[:, None, None], (n, n, n)).copy() * 100
    shift = field.solve(data, np.full((n, n, n), 100.0), low, cell, 1e-3, 1.0, 0.0001, 1)
    want = -0.0001 * amplitude / k * np.sin(k * x)
    assert np.abs(shift[0][:, 5, 5] - want).max() < 0.02 * np.abs(want).max()
    assert np.abs(shift[1]).max() < 0.05 * np.abs(want).max()


def test_field_queries_and_extension(spark):
    r = np.random.default_rng(4)
    place = lambda m: (r.normal(0, 30, (m, 3)) + [400, 100, 50]).tolist()
    frame = lambda rows, first: spark.createDataFrame([(first + k, *map(float, p), "N", 1.0) for k, p in enumerate(rows)], "targetid long, x double, y double, z double, field string, weight double")
    xyz = ["x", "y", "z"]
    data, randoms = frame(place(400), 1), frame(place(1500), 10_000)
    mesh, geometry = field.reconstruct(data, randoms, xyz, 10.0, 15.0, 1.5, 0.7)
    cache = field.shifts_at(data, mesh, geometry, "targetid", xyz).select("targetid", F.col("field").alias("region"), "delta_mpc")
    gates.unique_and_finite(cache, "targetid", "delta_mpc")
    assert cache.count() == 400 and field.same_mesh(geometry, geometry) and not field.same_mesh(geometry, {})
    rows = data.drop("field", "weight")
    moved, report = audits.extend(rows, cache.where("targetid % 2 = 0"), {"N": randoms.select("targetid", *xyz)}, mesh, geometry, "targetid", xyz)
    assert report["pearson"] > 0.995 and 100 < moved.count() <= 200
    same = moved.join(cache.withColumnRenamed("delta_mpc", "ref"), "targetid")
    assert same.where("abs(delta_mpc - ref) > 1e-9").count() == 0
    with pytest.raises(gates.GateError):
        audits.extend(rows, cache, {}, mesh, geometry, "targetid", xyz, min_correlation=0.5)
    held = audits.cross_fit(data, randoms, "targetid", xyz, cell=10.0, smoothing=15.0, bias=1.5, growth=0.7).first()
    assert held["count"] > 20 and held["pearson"] > 0.3
    near = audits.coherence(cache.join(rows, "targetid"), "targetid", xyz, "delta_mpc", [5.0, 15.0]).collect()
    assert len(near) == 2 and min(near, key=lambda b: b.radius).smoothness < 1
    flags = rows.select("targetid", (F.col("x") > 400).alias("flagged"))
    assert audits.two_realisations(flags, flags, "targetid").first().agreement == 1.0


def test_statistics_agree_with_numpy(spark):
    _, df = sky_points(spark)
    got = aggregates.agreement(df, "fog", "rsd").first()
    rows = df.toPandas()
    assert got.pearson == pytest.approx(np.corrcoef(rows.fog, rows.rsd)[0, 1]) and got.p99_diff == pytest.approx(np.percentile(np.abs(rows.fog - rows.rsd), 99))
    s = aggregates.robust_spread(df.withColumn("g", F.lit(1)), "g", "rsd").first()
    assert s.spread_rsd == pytest.approx(1.4826 * np.median(np.abs(rows.rsd - np.median(rows.rsd))))
