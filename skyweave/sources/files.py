"""Digests of files of any size: streamed by pieces in tasks, never held whole."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that a task holds at a time.
PIECE = 1 << 22


def opened(path: str):
    """A stream over a file: of a mounted folder, or of a store that Arrow knows by the path's scheme."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    if not rest or "/" in scheme:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def sha256_of(path: str) -> tuple[int, str]:
    """Bytes and digest of a file."""
    sha, n = hashlib.sha256(), 0
    with opened(path) as f:
        while block := f.read(PIECE):
            sha.update(block)
            n += len(block)
    return n, sha.hexdigest()


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, bytes of all files below a folder, empty ones too, but hidden ones (. or _); of contents nothing is read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, rows = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getPath().getName(), f.getLen()))
    return spark.createDataFrame([r for r in rows if r[1][0] not in "._"], "path string, name string, bytes long")


def digests(found: DataFrame) -> DataFrame:
    """name, bytes, sha256 of files (path); dealt to tasks by path."""

    def work(batches):
        for b in batches:
            for path in b["path"].to_pylist():
                n, sha = sha256_of(path)
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([n], pa.int64()), pa.array([sha])], names=["name", "bytes", "sha256"])

    spread = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.select("path").repartition(spread, "path").mapInArrow(work, "name string, bytes long, sha256 string")
