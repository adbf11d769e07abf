"""Sinks: row vectors, chunk files of one column, pairs, caches, flags; scaled FITS columns; column pruning; refusals."""

import gzip
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import gates, layout
from skyweave.plans import catalogue, corrections, region
from skyweave.sources import binary, text
from tests.test_sources import catalogue_file, points, sky_points


def scaled_fits(path, n=9):
    card = lambda k, v: f"{k:<8}= {v}".ljust(80).encode()
    pad = lambda b, c: b + c * (-len(b) % 2880)
    first = pad(b"".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), b"END".ljust(80)]), b" ")
    columns = [("U16", "I", {"TZERO": "32768"}), ("U32", "J", {"TZERO": "2147483648"}), ("U64", "K", {"TZERO": "9223372036854775808"}), ("S8", "B", {"TZERO": "-128"}), ("HALF", "I", {"TSCAL": "0.5", "TZERO": "1.5D0", "TNULL": "-99"}), ("NUL", "J", {"TNULL": "-1"}), ("FLUX", "2E", {}), ("BITS", "11X", {}), ("TARGETID", "K", {}), ("RA", "D", {}), ("DEC", "D", {}), ("Z", "D", {})]
    form = ">hiqBhi2f2sqddd"
    head = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(struct.calcsize(form))), card("NAXIS2", str(n)), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", str(len(columns)))]
    for k, (name, code, more) in enumerate(columns, 1):
        head += [card(f"TTYPE{k}", f"'{name}'"), card(f"TFORM{k}", f"'{code}'"), *[card(f"{c}{k}", v) for c, v in more.items()]]
    body = b"".join(struct.pack(form, k - 32768, k - (1 << 31), k - (1 << 63), k, -99 if k == 3 else k, -1 if k == 4 else k, k, k / 2, b"\0\1", k + 1, k / 3, -k, k / 10) for k in range(n))
    with open(path, "wb") as f:
        f.write(first + pad(b"".join([*head, b"END".ljust(80)]), b" ") + pad(body, b"\0"))


def test_scaled_and_vector_columns(spark, tmp_path):
    binary.register(spark)
    path = str(tmp_path / "s.fits")
    scaled_fits(path)
    rows = spark.read.format("fits_table").option("rowsPerPartition", 4).load(path).orderBy("row_index").collect()
    assert "bits" not in rows[0] and len(rows) == 9
    for k, r in enumerate(rows):
        assert (r.u16, r.u32, int(r.u64), r.s8) == (k, k, k, k - 128)
        assert r.half == (None if k == 3 else 0.5 * k + 1.5) and r.nul == (None if k == 4 else k) and r.flux == [k, k / 2]
    some = spark.read.format("fits_table").option("columns", "z, flux").load(path)
    assert some.columns == ["z", "flux"] and sorted(r.z for r in some.collect()) == [k / 10 for k in range(9)]
    assert spark.read.format("fits_table").schema("u32 bigint").load(path).agg(F.sum("u32")).first()[0] == 36
    assert binary.clustering(spark, path).columns == ["row_index", "targetid", "ra", "dec", "z"]
    with pytest.raises(Exception, match="bits"):
        spark.read.format("fits_table").option("columns", "bits").load(path).collect()


def test_catalogue_columns_and_refusals(spark, tmp_path):
    binary.register(spark)
    path = str(tmp_path / "c.bin")
    own = catalogue_file(path, 3)
    one = spark.read.format("sky_catalogue").option("columns", "targetid,qz").option("rowsPerPartition", 4).load(path)
    assert one.columns == ["targetid", "qz"] and sorted(r.targetid for r in one.collect()) == sorted(own["targetid"].tolist())
    head = binary.read_header(path)
    options = {"magic": "TEST", "count": 25, "bounds": ",".join(map(str, head["bounds"])), **{k: head[k] for k in ("unitsPerMpc", "zMin", "zMax")}}
    df = spark.read.format("sky_catalogue").load(path)
    before = open(path, "rb").read()
    with pytest.raises(Exception, match="FileExistsError"):
        df.write.format("sky_catalogue").mode("append").options(path=path, **options).save()
    short = str(tmp_path / "short.bin")
    for rows in (df.where("row_index < 24"), df.withColumn("row_index", F.col("row_index") + 1)):
        with pytest.raises(Exception):
            rows.write.format("sky_catalogue").mode("append").options(path=short, **options).save()
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["c.bin"]
    df.write.format("sky_catalogue").mode("overwrite").options(path=str(tmp_path / "d.bin"), **options).save()
    assert open(tmp_path / "d.bin", "rb").read() == before


@pytest.mark.parametrize("index", [[1, 1, 1], [0, 1], [0, 0, 2], [0, 1, 2, 2], [0, 1, 3], [-1, 0, 1, 2], [0, 1, None]])
def test_wrong_rows_are_not_committed(spark, tmp_path, index):
    """Repeated rows, missing ones and rows beyond the file leave no file, whether they meet in a task or not."""
    binary.register(spark)
    rows = spark.createDataFrame([(k, 9) for k in index], "row_index long, flags int")
    path = str(tmp_path / "f.bin")
    for parts in (1, 3):
        with pytest.raises(Exception):
            rows.repartition(parts).write.format("row_vector").mode("append").options(path=path, values="flags", type="u1", count=3).save()
    assert os.listdir(tmp_path) == []


def test_placed_rows_in_any_order(spark, tmp_path, monkeypatch):
    binary.register(spark)
    options = {"values": "a,b", "type": "<i2", "count": 5000}
    rows = spark.range(5000).select(F.col("id").alias("row_index"), (F.col("id") - 2500).cast("int").alias("a"), F.lit(7).alias("b"))
    mixed = rows.orderBy(F.rand(3))
    binary.place_rows(mixed, "row_vector", str(tmp_path / "a"), **options)
    mixed.repartition(7).write.format("row_vector").mode("append").options(path=str(tmp_path / "b"), **options).save()
    want = np.stack([np.arange(5000) - 2500, np.full(5000, 7)], 1).astype("<i2").tobytes()
    assert open(tmp_path / "a", "rb").read() == want and open(tmp_path / "b", "rb").read() == want
    for value, match in ((40_000, "doesn't"), (None, "nulls")):
        with pytest.raises(Exception, match=match):
            rows.withColumn("a", F.lit(value).cast("int")).write.format("row_vector").mode("append").options(path=str(tmp_path / "c"), **options).save()
    own = binary.PlacedWriter(str(tmp_path / "d"), b"", [(["a"], "u1")], 4, False)
    own.commit([binary.Done([(2, 4)]), None, binary.Done([(0, 2)])])
    with pytest.raises(ValueError, match="ranges"):
        monkeypatch.setattr(binary, "RANGES", 2)
        own.part = str(tmp_path / "e")
        open(own.part, "wb").close()
        own.count = 100
        own.write([binary.pa.RecordBatch.from_pydict({"row_index": [0, 5, 9, 20], "a": [1, 1, 1, 1]})])


def test_column_files(spark, tmp_path):
    df = layout.ordered_chunks(points(spark, 300), n=4).withColumn("targetid", F.col("row_index") * 7 + 1).cache()
    counts = {r.chunk: r["count"] for r in df.groupBy("chunk").count().collect()}
    binary.write_files(binary.encode_types(df), str(tmp_path / "t")).collect()
    binary.write_files(binary.encode_identities(df), str(tmp_path / "i")).collect()
    types = binary.decode_types(binary.files(spark, str(tmp_path / "t")), counts)
    ids = binary.decode_identities(binary.files(spark, str(tmp_path / "i")), counts)
    want = df.select("chunk", F.col("pos_in_chunk").cast("long"), "type")
    assert types.exceptAll(want).count() == 0 and types.count() == 300
    assert ids.exceptAll(df.select("chunk", F.col("pos_in_chunk").cast("long"), "targetid")).count() == 0
    for decode, folder in ((binary.decode_types, "t"), (binary.decode_identities, "i")):
        with pytest.raises(Exception, match="are due"):
            decode(binary.files(spark, str(tmp_path / folder)), {**counts, 1: 5}).collect()
    (tmp_path / "x").mkdir()
    np.save(tmp_path / "x/targetid_000.npy", np.arange(3, dtype=np.int32))
    with pytest.raises(Exception, match="int32"):
        binary.decode_identities(binary.files(spark, str(tmp_path / "x"))).collect()


def test_pairs_file(spark, tmp_path):
    binary.register(spark)
    rows = [(k, 3 * k + 1, float(k % 3), -0.5 * k) for k in range(1000)]
    df = spark.createDataFrame(rows, "row_index long, targetid long, fog_mpc float, rsd_mpc float").repartition(5)
    path = str(tmp_path / "correction_A.bin")
    report = corrections.write_pairs(df, path)
    assert (report["rows"], report["fogNonzero"], report["rsdNonzero"]) == (1000, 666, 999) and os.listdir(tmp_path) == ["correction_A.bin"]
    assert np.frombuffer(gzip.decompress(open(path, "rb").read()), "<f4").reshape(-1, 2).tolist() == [[r[2], r[3]] for r in rows]
    with pytest.raises(FileExistsError):
        corrections.write_pairs(df, path)
    twice = df.withColumn("targetid", F.when(F.col("row_index") < 2, 1).otherwise(F.col("targetid")))
    odd = df.withColumn("rsd_mpc", F.lit(float("nan")).cast("float"))
    for bad in (twice, odd):
        with pytest.raises(gates.GateError):
            corrections.write_pairs(bad, str(tmp_path / "b.bin"))


def test_cache_and_payload_folders(spark, tmp_path):
    df = spark.createDataFrame([(t, r, k, k / 2) for t in ("A", "B") for r in ("N", "S") for k in range(50)], "tracer string, region string, targetid long, delta_mpc float")
    folder = str(tmp_path / "cache")
    corrections.write_cache(df, folder)
    back = corrections.read_cache(spark, folder)
    assert back.select(*df.columns).exceptAll(df).count() == 0 and back.count() == 200
    assert "tracer=A" in back.where("tracer = 'A'").inputFiles()[0] or back.where("tracer = 'A'").count() == 100
    with pytest.raises(Exception, match="exist"):
        corrections.write_cache(df, folder)
    with pytest.raises(gates.GateError):
        corrections.write_cache(df.unionAll(df.limit(1)), str(tmp_path / "other"))
    rows = spark.createDataFrame([(k % 2, k // 2, 1.0, 2.0) for k in range(20)], "chunk int, pos_in_chunk long, fog_mpc float, rsd_mpc float")
    assert corrections.write_payloads(rows, str(tmp_path / "p"), extended=True).count() == 4
    with pytest.raises(gates.GateError, match="empty"):
        corrections.write_payloads(rows, str(tmp_path / "p"), extended=True)
    gates.vacant(spark, str(tmp_path / "nothing"))


def test_flags_file(spark, tmp_path):
    binary.register(spark)
    rows = spark.createDataFrame([(k, 10 + k, k % 4) for k in range(40)], "row_index long, targetid long, flags int")
    path = str(tmp_path / "A.target-flags.bin")
    counts = {r.bit: r.n for r in catalogue.write_flags(rows, rows.select("row_index", "targetid"), path).collect()}
    assert counts == {0: 20, 1: 20, 2: 0, 3: 0, 4: 0, 5: 0} and open(path, "rb").read() == bytes(k % 4 for k in range(40))
    with pytest.raises(gates.GateError):
        catalogue.write_flags(rows, rows.select("row_index", (F.col("targetid") + 1).alias("targetid")), str(tmp_path / "b"))


def test_viewer_and_identities(spark):
    rows = spark.createDataFrame([("GALAXY", 100, -200, 300, 0), ("QSO", 100, 0, 50, 65535)], "class string, qx int, qy int, qz int, zq int")
    heads = {"GALAXY": {"unitsPerMpc": 10.0, "zMin": 0.1, "zMax": 1.1}, "QSO": {"unitsPerMpc": 5.0, "zMin": 1.0, "zMax": 3.0}}
    g, q = (r for r in catalogue.viewer(rows, heads, 5.0).orderBy("class").collect())
    assert (g.qx, g.qy, g.qz, g.x, g.z3) == (50, -100, 150, 10.0, 30.0) and g.z == pytest.approx(0.1)
    assert (q.qx, q.x, q.z3) == (100, 20.0, 10.0) and q.z == pytest.approx(3.0)
    with pytest.raises(gates.GateError):
        catalogue.viewer(rows, {"QSO": heads["QSO"]}, 5.0)
    chunks = spark.createDataFrame([(1, 0, 10, 20, 30), (65, 1, 10, 20, 30)], "type int, row_index long, qx int, qy int, qz int")
    assert sorted((r.type, r.x, r.z3) for r in catalogue.decoded(chunks, (10.0, 5.0)).collect()) == [(1, 1.0, 3.0), (65, 2.0, 6.0)]
    ids = spark.createDataFrame([(0, 70), (1, 71)], "row_index long, targetid long")
    assert sorted((r.type, r.targetid) for r in catalogue.identified(chunks, ids, ids.withColumn("targetid", F.col("targetid") + 10)).collect()) == [(1, 70), (65, 81)]
    with pytest.raises(gates.GateError, match="out of range"):
        catalogue.identified(chunks, ids, ids.where("row_index = 0"))


def test_colours_and_region_keys(spark, tmp_path):
    shades = spark.range(1).select(*[sky.component_colour(F.lit(f), F.lit(x), 2.0, c) for f, x, c in ((0.0, 2.0, "both"), (1.0, -1.0, "rsd"), (1.0, 0.0, "both"), (1.0, 0.0, "rsd"), (0.0, 5.0, "fog"))]).first()
    assert list(shades) == ["#ff4050", "#506ee8", "#f59e0b", "#73869b", "#73869b"]
    _, df = sky_points(spark)
    out = region.query(df.withColumn("chunk", F.lit(3)), "targetid", ["x", "y", "z"], 7, 100.0, 100.0, 120.0)
    s = out["summary"]
    assert s["centerChunk"] == 3 and len(s["centerObservedMpc"]) == 3 and s["histogramData"] == "histograms.json"
    region.write(out, str(tmp_path / "r"))
    assert json.loads((tmp_path / "r/summary.json").read_text())["selection"] and 'stroke="red"' in (tmp_path / "r/comparison.svg").read_text()


def test_stamps(spark, tmp_path):
    from datetime import UTC, datetime

    (tmp_path / "LRG_NGC_clustering.dat.fits").write_bytes(b"xyz")
    r = text.sources_report(text.local_files(spark, str(tmp_path)), "A").first()
    assert r.total_bytes == 3 and r.files[0].tracer == "LRG" and abs((datetime.fromisoformat(r.generated_at) - datetime.now(UTC)).total_seconds()) < 600
