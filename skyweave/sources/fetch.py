"""Downloads: files of a listing in pieces over tasks, resumed by piece, checked by size and digest."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators import gates
from skyweave.storage import materialize

BLOCK = 1 << 20


def tried(work, what: str, attempts: int, wait: float):
    """work(), again after growing pauses when the connection or the server fails; a refusal (4xx) isn't tried again."""
    for k in range(1, attempts + 1):
        try:
            return work()
        except OSError as e:
            if k == attempts or isinstance(e, HTTPError) and 400 <= e.code < 500:
                raise OSError(f"{what}: {e}") from e
            time.sleep(min(60.0, wait * 2**k))


def remote_bytes(url: str) -> int:
    with urlopen(Request(url, method="HEAD"), timeout=60) as r:
        return int(r.headers["Content-Length"])


def sizes(listed: DataFrame, attempts: int = 8, wait: float = 1.0) -> DataFrame:
    """listed (name, url) with bytes, as the servers say."""

    def work(batches):
        for b in batches:
            yield b.assign(bytes=[tried(lambda u=u: remote_bytes(u), u, attempts, wait) for u in b["url"]])

    return listed.select("name", "url").mapInPandas(work, "name string, url string, bytes long")


def part_folder(folder: str, name: str) -> str:
    return f"{folder}/.{name}.pieces"


def get_piece(url: str, path: str, first: int, n: int, total: int) -> None:
    """Bytes first to first + n - 1 into a file that appears when it is whole; a server that sends another range aborts."""
    part = f"{path}.{uuid.uuid4().hex}"
    whole = n == total
    try:
        with urlopen(Request(url, headers={} if whole else {"Range": f"bytes={first}-{first + n - 1}"}), timeout=120) as r, open(part, "wb") as out:
            if not whole and (r.status != 206 or r.headers.get("Content-Range") != f"bytes {first}-{first + n - 1}/{total}"):
                raise ValueError(f"{url}: asked for {n} bytes at {first} of {total}; got status {r.status}, {r.headers.get('Content-Range')}")
            shutil.copyfileobj(r, out, BLOCK)
        if os.path.getsize(part) != n:
            raise OSError(f"{os.path.getsize(part)} of {n} bytes came")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def assemble(folder: str, name: str, total: int, pieces: int, digest: str | None) -> str:
    """The file of its pieces, in place when its size (and digest, if one is due) is right; its digest."""
    path, part, sha = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}.part", hashlib.sha256()
    held = os.path.exists(path) and os.path.getsize(path) == total
    sources = [path] if held else [f"{part_folder(folder, name)}/{k:06d}" for k in range(pieces)]
    with open(os.devnull if held else part, "wb") as out:
        for s in sources:
            with open(s, "rb") as f:
                while block := f.read(BLOCK):
                    sha.update(block)
                    out.write(block)
    try:
        if digest and sha.hexdigest() != digest.lower():
            shutil.rmtree(part_folder(folder, name), ignore_errors=True)  # the next run asks for all of them again
            raise ValueError(f"{name}: digest {sha.hexdigest()}; {digest} is due")
        if not held:
            if os.path.getsize(part) != total:
                raise ValueError(f"{name}: {os.path.getsize(part)} of {total} bytes")
            os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    shutil.rmtree(part_folder(folder, name), ignore_errors=True)
    return sha.hexdigest()


def download(listed: DataFrame, folder: str, streams: int = 8, piece: int = 64 << 20, attempts: int = 8, wait: float = 1.0) -> DataFrame:
    """name, url, bytes, sha256 of listed files (name, url, and sha256 where it is known) after they are in a shared folder.

    Pieces are dealt over `streams` tasks.  A piece that is there already isn't asked for again, nor is a file of the
    right size, so a stopped download goes on where it was.  Names that repeat or leave the folder abort, as do a
    server that ignores ranges, a wrong digest, and a folder without room for what is missing.
    """
    spark = listed.sparkSession
    gates.unique(listed, "name")
    gates.require(not listed.where(F.col("name").contains("/") | F.col("name").startswith(".")).take(1), "names leave the folder")
    os.makedirs(folder, exist_ok=True)
    due = F.col("sha256") if "sha256" in listed.columns else F.lit(None).cast("string")
    sized = materialize(sizes(listed, attempts, wait).join(listed.select("name", due.alias("due")), "name").withColumn("pieces", F.ceil(F.col("bytes") / piece).cast("long")), "listing")
    need = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    present = sum(e.stat().st_size for e in os.scandir(folder) if e.is_file())
    free = shutil.disk_usage(folder).free
    gates.require(need - present <= free, f"{need} bytes are due, {present} are there, {free} fit")

    def get(batches):
        for b in batches:
            for name, url, total, k in zip(b["name"], b["url"], b["bytes"], b["k"]):
                path, n = f"{part_folder(folder, name)}/{int(k):06d}", min(piece, int(total) - int(k) * piece)
                done = f"{folder}/{name}"
                if not (os.path.exists(done) and os.path.getsize(done) == total) and not (os.path.exists(path) and os.path.getsize(path) == n):
                    os.makedirs(part_folder(folder, name), exist_ok=True)
                    tried(lambda: get_piece(url, path, int(k) * piece, n, int(total)), url, attempts, wait)
            yield b[["name", "k"]]

    pieces = sized.where("pieces > 0").select("name", "url", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("k"))
    got = pieces.repartition(streams, "name", "k").mapInPandas(get, "name string, k long").groupBy("name").agg(F.count("*").alias("got"))
    ready = materialize(sized.join(got, "name", "left").withColumn("got", F.coalesce("got", F.lit(0))), "pieces")
    gates.require(not ready.where("got <> pieces").take(1), "pieces are missing")

    def put(batches):
        for b in batches:
            sha = [assemble(folder, n, int(t), int(k), d) for n, t, k, d in zip(b["name"], b["bytes"], b["pieces"], b["due"])]
            yield pd.DataFrame({"name": b["name"], "url": b["url"], "bytes": b["bytes"], "sha256": sha})

    return materialize(ready.repartition(streams, "name").mapInPandas(put, "name string, url string, bytes long, sha256 string"), "files")
