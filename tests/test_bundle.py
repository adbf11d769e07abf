"""Bundles, and properties of coding and partition."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyweave.operators import gates, layout
from skyweave.plans import bundle
from skyweave.sources import binary
from tests.test_sources import points


def test_bundle(spark, tmp_path):
    df = layout.ordered_chunks(points(spark, 200), n=3).cache()
    for kind in ("chunks", "consolidated"):
        bundle.round_trip(df, str(tmp_path / kind), kind)
    files = bundle.inventory(spark, str(tmp_path / "consolidated"))
    listed = spark.createDataFrame(files.collect(), files.schema)
    bundle.verify(spark, str(tmp_path / "consolidated"), listed)
    counts = {r.chunk: r["count"] for r in df.groupBy("chunk").count().collect()}
    manifest = {"count": 200, "chunks": [{"file": f"catalog_{k:03d}.bin.gz", "count": n} for k, n in sorted(counts.items())]}
    assert len(json.loads(bundle.finalise(manifest, files))["chunks"][0]["sha256"]) == 64
    with pytest.raises(gates.GateError):
        bundle.finalise({**manifest, "count": 201}, files)
    chunks = binary.decode_consolidated(binary.files(spark, str(tmp_path / "consolidated")))
    fog = df.select("chunk", "pos_in_chunk", "fog")
    assert bundle.verify_chunks(chunks, {"fog": fog}, counts, {"fog": 300.0}).count() == 3
    for wrong in ({"counts": {**counts, 0: 1}}, {"caps": {"fog": 1e-9}}, {"payloads": {"fog": fog.where("pos_in_chunk > 0")}}):
        with pytest.raises(gates.GateError):
            bundle.verify_chunks(**{"chunks": chunks, "payloads": {"fog": fog}, "counts": counts, "caps": {"fog": 300.0}} | wrong)
    (tmp_path / "consolidated/extra.bin").write_bytes(b"x")
    with pytest.raises(gates.GateError):
        bundle.verify(spark, str(tmp_path / "consolidated"), listed)
    both = bundle.overlay(listed, listed.limit(1).withColumn("bytes", F.lit(1).cast("long")))
    assert both.count() == 3 and both.where("origin = 'new'").count() == 1
    assert bundle.inspect(df, ["qx", "lost"], "fog")["missing"] == ["lost"]
    with pytest.raises(gates.GateError):
        bundle.complete(listed, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-32768, 32767)] * 3), min_size=1, max_size=60), st.integers(1, 60))
def test_delta_planes_round_trip(rows, part):
    """Planes of parts, each from its edge on, are the planes of the whole."""
    import numpy as np
    import pandas as pd

    whole = pd.DataFrame(rows, columns=["qx", "qy", "qz"]).assign(chunk=0)
    planes = [binary.deltas(whole.iloc[max(0, k - 1) : k + part].assign(_edge=lambda g, k=k: g.index < k)) for k in range(0, len(rows), part)]
    assert (binary.undelta(np.concatenate(planes, 1)) == np.array(rows)).all()
