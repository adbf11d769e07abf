"""Files made by many tasks, and digests of files that are never held whole."""

import gzip
import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import gates, layout
from skyweave.plans import bundle
from skyweave.sources import binary, files
from tests.test_sources import points


def in_order(df, chunk, *columns):
    return [tuple(r[c] for c in columns) for r in df.where(F.col("chunk") == chunk).orderBy("pos_in_chunk").collect()]


@pytest.mark.parametrize("part", [1, 7, 64, 100_000])
def test_members_make_the_files_of_the_format(spark, tmp_path, part):
    """Read by gzip and struct alone, byte by byte what one writer would have written."""
    df = layout.ordered_chunks(points(spark, 200), n=3).withColumn("targetid", F.col("row_index") * 7 + 1).cache()
    sizes = {r.chunk: r["count"] for r in df.groupBy("chunk").count().collect()}
    folder = str(tmp_path / "f")
    for members in (binary.encode_chunks(df, part=part), binary.encode_consolidated(df, part=part), binary.encode_payload(df, "fog", part=part), binary.encode_identities(df, part=part)):
        sums = {r.name: (r.bytes, r.sha256) for r in binary.write_files(members, folder).collect()}
        assert all((os.path.getsize(f"{folder}/{n}"), hashlib.sha256(open(f"{folder}/{n}", "rb").read()).hexdigest()) == x for n, x in sums.items()) and len(sums) == 3
    assert len(os.listdir(folder)) == 12
    for k, n in sizes.items():
        q = np.array(in_order(df, k, "qx", "qy", "qz"))
        planes = np.diff(q, axis=0, prepend=0).astype("<i2").T.tobytes()
        assert gzip.open(f"{folder}/chunk_{k:03d}.bin.gz").read() == planes
        assert gzip.open(f"{folder}/payload_{k:03d}.bin").read() == np.array(in_order(df, k, "fog"), "<f4").tobytes()
        assert np.load(f"{folder}/targetid_{k:03d}.npy").tolist() == [x for (x,) in in_order(df, k, "targetid")]
        raw = gzip.open(f"{folder}/catalog_{k:03d}.bin.gz").read()
        _, version, m, *offsets, total = struct.unpack_from(binary.CONSOLIDATED, raw)
        assert (version, m, total) == (1, n, len(raw)) and all(o % 4 == 0 for o in offsets)
        assert raw[offsets[2] : offsets[2] + 6 * n] == planes and raw[offsets[3] : offsets[3] + 2 * n] == np.array(in_order(df, k, "zq"), "<u2").tobytes()
        assert raw[offsets[4] :] == np.array(in_order(df, k, "morph", "shape", "gr", "rz"), "u1").T.tobytes()
    back = binary.decode_consolidated(binary.files(spark, folder).where("name LIKE 'catalog%'"), sizes)
    assert back.count() == 200


def test_many_tasks_make_one_file(spark, tmp_path):
    df = spark.range(5000).select(F.lit(0).alias("chunk"), F.col("id").alias("pos_in_chunk"), (F.col("id") / 3).cast("float").alias("fog")).repartition(4)
    members = binary.encode_payload(df, "fog", part=500)
    assert members.select("part").distinct().count() == 10
    binary.write_files(members, str(tmp_path / "f"))
    assert gzip.open(str(tmp_path / "f/payload_000.bin")).read() == (np.arange(5000) / 3).astype("<f4").tobytes()


def test_files_that_exist(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([(0, k, float(x)) for k in range(5)], "chunk int, pos_in_chunk long, fog float")
    folder = str(tmp_path / "f")
    first = binary.write_files(binary.encode_payload(rows(1), "fog"), folder).collect()
    assert binary.write_files(binary.encode_payload(rows(1), "fog"), folder).collect() == first
    before = open(f"{folder}/payload_000.bin", "rb").read()
    with pytest.raises(FileExistsError):
        binary.write_files(binary.encode_payload(rows(2), "fog"), folder)
    assert os.listdir(folder) == ["payload_000.bin"] and open(f"{folder}/payload_000.bin", "rb").read() == before
    gap = rows(1).where("pos_in_chunk <> 2")
    with pytest.raises(Exception, match="consecutive"):
        binary.write_files(binary.encode_payload(gap, "fog"), str(tmp_path / "g"))
    assert not os.listdir(tmp_path / "g")


def test_digests_of_files_beyond_the_limit(spark, tmp_path):
    """Where binaryFile refuses a file for its size, digests stream it."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    held = {"a b.bin": os.urandom(300_000), "sub/c.bin": b"", "d%20.bin": os.urandom(5)}
    for n, raw in held.items():
        (tmp_path / "in" / n).write_bytes(raw)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        with pytest.raises(Exception, match="(?i)length|exceed"):
            spark.read.format("binaryFile").load(str(tmp_path / "in")).select("content").collect()
        want = {n.rsplit("/", 1)[-1]: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in held.items()}
        found = bundle.inventory(spark, str(tmp_path / "in"))
        assert {r.name: (r.bytes, r.sha256) for r in found.collect()} == want
        gates.digests(files.listing(spark, str(tmp_path / "in")), {n: sha for n, (_, sha) in want.items()})
        bundle.verify(spark, str(tmp_path / "in"), spark.createDataFrame([(n, *x) for n, x in want.items()], "name string, bytes long, sha256 string"))
        with pytest.raises(gates.GateError, match="a b.bin"):
            gates.digests(files.listing(spark, str(tmp_path / "in")), {"a b.bin": "0" * 64})
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
