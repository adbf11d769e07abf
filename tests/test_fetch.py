"""Downloads from a local server that fails at times, and a remote table by key ranges."""

import hashlib
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from skyweave.operators import gates
from skyweave.sources import fetch, text


@pytest.fixture
def server():
    data = {"a.bin": os.urandom(5000), "b.bin": os.urandom(900), "empty.bin": b""}
    seen: list = []

    class Handler(BaseHTTPRequestHandler):
        fails, ranges = 0, True

        def log_message(self, *args):
            pass

        def answer(self, body: bool):
            raw = data.get(self.path[1:])
            if raw is None:
                return self.send_error(404)
            if body and Handler.fails:
                Handler.fails -= 1
                return self.send_error(503)
            wanted = self.headers.get("Range") if Handler.ranges else None
            first, last = map(int, wanted[6:].split("-")) if wanted else (0, len(raw) - 1)
            piece = raw[first : last + 1]
            self.send_response(206 if wanted else 200)
            self.send_header("Content-Length", str(len(piece)))
            if wanted:
                self.send_header("Content-Range", f"bytes {first}-{last}/{len(raw)}")
            self.end_headers()
            if body:
                seen.append((self.path[1:], first))
                self.wfile.write(piece)

        def do_GET(self):
            self.answer(True)

        def do_HEAD(self):
            self.answer(False)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", data, seen, Handler
    s.shutdown()


def test_download(spark, tmp_path, server):
    url, data, seen, handler = server
    listed = spark.createDataFrame([(n, f"{url}/{n}") for n in data], "name string, url string")
    folder = str(tmp_path / "in")
    os.makedirs(f"{folder}/.a.bin.pieces")
    with open(f"{folder}/.a.bin.pieces/000001", "wb") as f:
        f.write(data["a.bin"][1000:2000])
    handler.fails = 2
    got = {r.name: (r.bytes, r.sha256) for r in fetch.download(listed, folder, 3, 1000, wait=0.01).collect()}
    assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in data.items()}
    assert all(open(f"{folder}/{n}", "rb").read() == x for n, x in data.items()) and sorted(os.listdir(folder)) == sorted(data)
    assert sorted(seen) == [("a.bin", 0), ("a.bin", 2000), ("a.bin", 3000), ("a.bin", 4000), ("b.bin", 0)]
    assert fetch.download(listed, folder, 3, 1000, wait=0.01).count() == 3 and len(seen) == 5
    wrong = spark.createDataFrame([("b.bin", f"{url}/b.bin", "0" * 64)], "name string, url string, sha256 string")
    with pytest.raises(Exception, match="is due"):
        fetch.download(wrong, str(tmp_path / "other"), 1, 1000, wait=0.01)
    assert not os.path.exists(tmp_path / "other/b.bin")
    handler.ranges = False
    with pytest.raises(Exception, match="asked for"):
        fetch.download(listed.where("name = 'a.bin'"), str(tmp_path / "third"), 1, 1000, 2, 0.01)
    for bad in ([("x", f"{url}/b.bin"), ("x", f"{url}/b.bin")], [("../x", f"{url}/b.bin")]):
        with pytest.raises(gates.GateError):
            fetch.download(spark.createDataFrame(bad, "name string, url string"), folder)
    with pytest.raises(Exception, match="404"):
        fetch.sizes(spark.createDataFrame([("x", f"{url}/none")], "name string, url string")).collect()
    assert fetch.download(listed.limit(0), folder).count() == 0


def test_remote_table_by_ranges(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(k, k * 0.5) for k in range(100)], "ID long, X double").write.jdbc(url, "T1")
    rows = text.by_key_ranges(spark, url, "T1", "ID", [(0, 39), (40, 99)])
    assert rows.rdd.getNumPartitions() == 2 and text.complete_table(rows, url, "T1").count() == 100
    with pytest.raises(gates.GateError):
        text.complete_table(text.by_key_ranges(spark, url, "T1", "ID", [(0, 39), (41, 99)]), url, "T1")


def test_sequence_digest_tells_orders(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "g int, pos int, v string")
    b = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (2, 0, "z")], "g int, pos int, v string")
    one, two = ({r.g: (r.digest, r.rows) for r in gates.sequence_digest(df, "g", ["pos"], ["v"]).collect()} for df in (a, b))
    assert one[1] != two[1] and one[2] == two[2] and one[1][1] == 2
