"""Remote queries by batches of keys, each kept with a receipt, so that a stopped run goes on with what is missing."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import os
import uuid
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators import gates
from skyweave.sources.fetch import tried
from skyweave.storage import materialize

RECEIPT = "block long, rows long, bytes long, sha256 string, query string, asked boolean"


def put(path: str, raw: bytes) -> None:
    """A file that appears when it is whole."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(raw)
    os.replace(part, path)


def paths(folder: str, block: int) -> tuple[str, str]:
    return f"{folder}/batch-{block:06d}.csv.gz", f"{folder}/batch-{block:06d}.json"


def held(folder: str, block: int, query: str) -> dict | None:
    """The receipt of a batch, if it answers this query and its data are those it was written for."""
    data, receipt = paths(folder, block)
    if not (os.path.exists(data) and os.path.exists(receipt)):
        return None
    with open(receipt, encoding="utf-8") as f:
        r = json.load(f)
    with open(data, "rb") as f:
        same = hashlib.file_digest(f, "sha256").hexdigest() == r["sha256"]
    return r if same and r["query"] == query else None


def answer(endpoint: str, query: str, headers: dict[str, str], parameters: dict[str, str]) -> bytes:
    with urlopen(Request(f"{endpoint}?{urlencode(parameters | {'sql': query})}", headers=headers), timeout=240) as r:
        return r.read()


def checked(raw: bytes, expected: bytes, columns: list[str], low: int, high: int, what: str) -> int:
    """Rows of an answer: the due columns, keys (the first column) inside the batch and once each, and as many rows as counted apart."""
    lines = csv.reader(io.StringIO(raw.decode()))
    if next(lines, None) != columns:
        raise ValueError(f"{what}: columns differ from {columns}: {raw[:100]!r}")
    keys = [int(r[0]) for r in lines if r]
    if len(set(keys)) != len(keys) or any(not low <= k <= high for k in keys):
        raise ValueError(f"{what}: keys repeat or lie outside {low} to {high}")
    due = int(list(csv.reader(io.StringIO(expected.decode())))[1][0])
    if len(keys) != due:
        raise ValueError(f"{what}: {len(keys)} rows of {due}")
    return len(keys)


def fetch(blocks: DataFrame, endpoint: str, query: str, count: str, columns: list[str], folder: str, streams: int = 4, attempts: int = 4, wait: float = 1.0, headers: dict[str, str] | None = None, parameters: dict[str, str] | None = None) -> DataFrame:
    """Receipts (RECEIPT) of all blocks (block, low, high: layout.key_blocks()), after their answers are in a shared folder.

    query and count are texts with {low} and {high}; count asks how many rows query has.  A batch that is there with
    its receipt isn't asked for again; an incomplete answer aborts, and what came before stays for the next run.
    `asked` tells which batches this run asked for.
    """
    gates.unique(blocks, "block")
    os.makedirs(folder, exist_ok=True)
    own_headers, own_parameters = headers or {}, parameters or {}

    def work(batches):
        for b in batches:
            for block, low, high in zip(b["block"].to_pylist(), b["low"].to_pylist(), b["high"].to_pylist()):
                text, counting = query.format(low=low, high=high), count.format(low=low, high=high)
                receipt, asked = held(folder, block, text), False
                if receipt is None:
                    def ask(text=text, counting=counting, low=low, high=high, block=block):
                        raw = answer(endpoint, text, own_headers, own_parameters)
                        return raw, checked(raw, answer(endpoint, counting, own_headers, own_parameters), columns, low, high, f"batch {block}")

                    raw, n = tried(ask, f"batch {block}", attempts, wait)
                    packed = gzip.compress(raw, mtime=0)
                    data, path = paths(folder, block)
                    receipt, asked = {"block": block, "rows": n, "bytes": len(packed), "sha256": hashlib.sha256(packed).hexdigest(), "query": text}, True
                    put(data, packed)
                    put(path, json.dumps(receipt, indent=2).encode())
                yield pa.RecordBatch.from_pylist([receipt | {"asked": asked}], schema=pa.schema([("block", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("query", pa.string()), ("asked", pa.bool_())]))

    cast = [F.col(c).cast("long").alias(c) for c in ("block", "low", "high")]
    return materialize(blocks.select(*cast).repartition(streams, "block").mapInArrow(work, RECEIPT), "receipts")


def table(spark: SparkSession, folder: str, receipts: DataFrame, schema: str) -> DataFrame:
    """The rows of all batches; a receipt without its data, or with other rows than it says, aborts."""
    names = receipts.select(F.format_string("batch-%06d.csv.gz", "block").alias("name"), "rows")
    rows = spark.read.csv(folder, schema=schema, header=True, pathGlobFilter="batch-*.csv.gz").withColumn("_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    known = rows.join(names.select(F.col("name").alias("_name")), "_name")
    counted = known.groupBy("_name").agg(F.count("*").alias("n"))
    bad = names.join(counted, names["name"] == counted["_name"], "left").where(F.coalesce("n", F.lit(0)) != F.col("rows")).take(3)
    gates.require(not bad, f"batches differ from their receipts: {bad}")
    return known.drop("_name")
