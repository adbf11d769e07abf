"""Remote batches with receipts, published versions, and the historical catalogue as one flow."""

import csv
import gzip
import io
import json
import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import gates, layout
from skyweave.plans import legacy, publish
from skyweave.sources import batches, binary

QUERY, COUNT = "SELECT targetid, flux FROM p WHERE targetid BETWEEN {low} AND {high}", "SELECT COUNT(*) AS n FROM p WHERE targetid BETWEEN {low} AND {high}"


@pytest.fixture
def service():
    """Answers both texts over 1,000 rows, as CSV, until its budget of answers is used up."""
    rows = {k: k / 4 for k in range(0, 3000, 3)}

    class Handler(BaseHTTPRequestHandler):
        budget, lose, asked = 10**6, False, []

        def log_message(self, *args):
            pass

        def do_GET(self):
            sql = parse_qs(urlparse(self.path).query)["sql"][0]
            Handler.budget -= 1
            if Handler.budget < 0:
                return self.send_error(403)
            low, high = map(int, re.search(r"BETWEEN (\d+) AND (\d+)", sql).groups())
            found = [(k, v) for k, v in rows.items() if low <= k <= high]
            out = io.StringIO()
            if "COUNT" in sql:
                csv.writer(out).writerows([["n"], [len(found)]])
            else:
                Handler.asked.append((low, high))
                csv.writer(out).writerows([["targetid", "flux"], *(found[1:] if Handler.lose else found)])
            raw = out.getvalue().encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/query", Handler, rows
    s.shutdown()


def test_batches_go_on_where_a_run_stopped(spark, tmp_path, service):
    url, handler, rows = service
    keys = spark.createDataFrame([(k,) for k in range(0, 3000, 6)], "targetid long")
    blocks = layout.key_blocks(keys, "targetid", 50)
    folder = str(tmp_path / "b")
    run = lambda **more: batches.fetch(blocks, url, QUERY, COUNT, ["targetid", "flux"], folder, streams=2, wait=0.01, **more)
    handler.budget = 9  # four batches and a half
    with pytest.raises(Exception, match="403"):
        run()
    done = sorted(int(n[6:12]) for n in os.listdir(folder) if n.endswith(".json"))
    assert 1 <= len(done) < 10 and not any(n.endswith(".part") for n in os.listdir(folder))
    handler.budget, handler.asked[:] = 10**6, []
    got = {r.block: r for r in run().collect()}
    assert sorted(b for b, r in got.items() if not r.asked) == done and len(handler.asked) == 10 - len(done) and len(got) == 10
    handler.asked.clear()
    receipts = run()
    assert not handler.asked and not receipts.where("asked").take(1)
    table = batches.table(spark, folder, receipts, "targetid long, flux double")
    due = {k: v for k, v in rows.items() if any(r.query.endswith(f"BETWEEN {a} AND {b}") and a <= k <= b for r in got.values() for a, b in [map(int, re.findall(r"\d+", r.query)[-2:])])}
    assert dict(map(tuple, table.collect())) == due
    # data that aren't those of the receipt, and another query, are asked for again
    with gzip.open(f"{folder}/batch-000003.csv.gz", "wb") as f:
        f.write(b"targetid,flux\n")
    with pytest.raises(gates.GateError):
        batches.table(spark, folder, receipts, "targetid long, flux double")
    run()
    assert len(handler.asked) == 1
    batches.fetch(blocks, url, QUERY + " ", COUNT, ["targetid", "flux"], folder, wait=0.01)
    assert len(handler.asked) == 11


def test_incomplete_answers_abort(spark, tmp_path, service):
    url, handler, _ = service
    handler.lose = True
    blocks = spark.createDataFrame([(0, 0, 30)], "block long, low long, high long")
    with pytest.raises(Exception, match="rows of"):
        batches.fetch(blocks, url, QUERY, COUNT, ["targetid", "flux"], str(tmp_path / "b"), wait=0.01)
    assert os.listdir(tmp_path / "b") == []
    with pytest.raises(Exception, match="columns differ"):
        batches.fetch(blocks, url, QUERY, COUNT, ["targetid"], str(tmp_path / "b"), wait=0.01)


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "pub")
    src = tmp_path / "src"
    src.mkdir()
    for n in "abc":
        (src / f"{n}.bin").write_bytes(n.encode() * 1000)
    own = {f"{n}.bin": str(src / f"{n}.bin") for n in "abc"}
    first = publish.stage(spark, folder, "v1", own)
    assert first.count() == 3 and publish.current(folder) is None
    publish.publish(spark, folder, "v1")
    (src / "b.bin").write_bytes(b"new")
    second = publish.stage(spark, folder, "v2", {"b.bin": own["b.bin"], "d.bin": own["a.bin"]}, base="v1")
    assert publish.current(folder) == "v1" and sorted(r.name for r in second.collect()) == ["a.bin", "b.bin", "c.bin", "d.bin"]
    assert os.path.samefile(f"{folder}/versions/v1/a.bin", f"{folder}/versions/v2/a.bin")
    publish.publish(spark, folder, "v2")
    assert publish.current(folder) == "v2" and open(f"{folder}/versions/v2/b.bin", "rb").read() == b"new" and open(f"{folder}/versions/v1/b.bin", "rb").read() == b"b" * 1000
    publish.publish(spark, folder, "v1")
    assert publish.current(folder) == "v1"
    # a version that was damaged, never finished, exists, or misses a digest doesn't become current
    (tmp_path / "pub/versions/v2/d.bin").write_bytes(b"x")
    os.makedirs(f"{folder}/versions/v3")
    for bad in (lambda: publish.publish(spark, folder, "v2"), lambda: publish.publish(spark, folder, "v3"), lambda: publish.stage(spark, folder, "v1", own), lambda: publish.stage(spark, folder, "v4", own, want={"a.bin": "0" * 64}), lambda: publish.stage(spark, folder, "../v5", own)):
        with pytest.raises(gates.GateError):
            bad()
    assert publish.current(folder) == "v1"
    with pytest.raises(gates.GateError):
        publish.publish(spark, folder, "v4")
    text = json.loads((tmp_path / "pub/versions/v1/manifest.json").read_text())
    (tmp_path / "pub/versions/v1/manifest.json").write_text(json.dumps(text))
    with pytest.raises(gates.GateError, match="changed"):
        publish.current(folder)


def test_legacy_catalogue(spark, tmp_path):
    binary.register(spark)
    g = np.random.default_rng(7)
    rows = [(k, int(t), float(a), float(d), float(z)) for k, (t, a, d, z) in enumerate(zip(g.permutation(400) + 1, g.uniform(0, 360, 400), g.uniform(-90, 90, 400), g.uniform(-0.2, 6.5, 400)))]
    rows[5] = (*rows[5][:4], float("nan"))
    parts = [spark.createDataFrame([(k - first, *r) for k, *r in rows[first : first + 200]], "row_index long, targetid long, ra double, dec double, z double") for first in (0, 200)]
    f4 = lambda x: float(np.float32(x))
    image = [(k, 2 * k, ["PSF ", "REX", "SER", "odd"][k % 4], f4(g.normal(1, 20)), f4(g.normal(5, 5)), f4(g.normal(5, 5)), f4(g.normal(5, 5)), k % 9) for k in range(150)] + [(150, 4, "DEV", 1.0, 1.0, 1.0, 1.0, 1)]
    full = spark.createDataFrame(image, "row_index long, targetid long, type string, shape_r float, flux_g float, flux_r float, flux_z float, zwarn long")
    good = [r for r in rows if 0 < r[4] < 6]
    head = legacy.build([p.repartition(3) for p in parts], full, str(tmp_path / "T.bin"), magic="TEST")
    assert head["version"] == 3 and head["count"] == len(good) and head["matched"] == sum(r[1] % 2 == 0 and r[1] < 300 for r in good)
    got = spark.read.format("sky_catalogue").load(str(tmp_path / "T.bin")).orderBy("row_index").collect()
    z = np.array([r[4] for r in good])
    grid = np.linspace(0, z.max() * 1.01 + 1e-3, 4096)
    d = np.interp(z, grid, sky.comoving_distances(grid.tolist()))
    ra, dec = np.radians([r[2] for r in good]), np.radians([r[3] for r in good])
    xyz = np.stack([d * np.cos(dec) * np.cos(ra), d * np.cos(dec) * np.sin(ra), d * np.sin(dec)], 1)
    units = 32767 / np.abs(xyz).max()
    assert head["unitsPerMpc"] == pytest.approx(units) and head["bounds"] == pytest.approx([*xyz.min(0), *xyz.max(0)], rel=1e-6)
    assert np.abs(np.array([(r.qx, r.qy, r.qz) for r in got]) - np.rint(xyz * units)).max() <= 1
    assert [r.zq for r in got] == np.rint((z - z.min()) / (z.max() - z.min()) * 65535).astype(int).tolist()
    assert [r.targetid for r in got] == [r[1] for r in good] and [r.ra for r in got] == [f4(r[2]) for r in good]
    known = {}
    for _, t, *x in image:
        known.setdefault(t, x)
    mag = lambda x: np.float32(22.5 - 2.5 * np.log10(x)) if x > 0 else np.float32("nan")
    code = lambda c, s: int(np.clip(np.rint((c + np.float32(0.5)) * np.float32(s)), 0, 255)) if np.isfinite(c) else 128
    for r in got:
        x = known.get(r.targetid)
        want = (255, 0, 128, 128, 0xFFFFFFFF) if x is None else ({"PSF": 0, "REX": 1, "EXP": 2, "DEV": 3, "SER": 4}.get(x[0].strip(), 255), int(np.clip(np.rint(np.float32(x[1]) * 10), 0, 255)), code(mag(x[2]) - mag(x[3]), 85), code(mag(x[3]) - mag(x[4]), 102), x[5])
        assert (r.morph, r.shape, r.gr, r.rz, r.zwarn) == want
    plain = legacy.build(parts, None, str(tmp_path / "P.bin"), magic="TEST")
    assert plain["version"] == 1 and os.path.getsize(tmp_path / "P.bin") == 48 + 8 * len(good)
    with pytest.raises(gates.GateError):
        legacy.build([p.where(F.lit(False)) for p in parts], None, str(tmp_path / "N.bin"))
