"""Published bundles: a version is written aside, verified, and made current by one pointer.

A folder holds ``versions/<name>/`` with files and ``manifest.json`` (name, bytes, sha256 of each), and ``CURRENT``,
which names the version that readers take and the digest of its manifest.  Nothing in a version changes once its
manifest is there; the pointer is replaced by a rename, so a reader sees one version or the other, whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyweave.operators import gates
from skyweave.plans import bundle
from skyweave.sources import files
from skyweave.sources.batches import put


def version_of(folder: str, version: str) -> str:
    gates.require(bool(version) and "/" not in version and version[0] != ".", f"{version!r} is no name of a version")
    return f"{folder}/versions/{version}"


def manifest_of(folder: str, version: str) -> dict[str, dict]:
    with open(f"{version_of(folder, version)}/manifest.json", encoding="utf-8") as f:
        return {r["name"]: r for r in json.load(f)["files"]}


def current(folder: str) -> str | None:
    """The version that readers take; one whose manifest isn't the one that was made current aborts."""
    if not os.path.exists(f"{folder}/CURRENT"):
        return None
    with open(f"{folder}/CURRENT", encoding="utf-8") as f:
        pointer = json.load(f)
    with open(f"{version_of(folder, pointer['version'])}/manifest.json", "rb") as f:
        gates.require(hashlib.file_digest(f, "sha256").hexdigest() == pointer["manifest"], f"the manifest of {pointer['version']} has changed")
    return pointer["version"]


def listed(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.createDataFrame([(r["name"], r["bytes"], r["sha256"]) for r in manifest_of(folder, version).values()], "name string, bytes long, sha256 string")


def stage(spark: SparkSession, folder: str, version: str, sources: dict[str, str], want: dict[str, str] | None = None, base: str | None = None) -> DataFrame:
    """Write a version of files (name: path); with a base version, its other files belong to it too. Gives name, bytes, sha256.

    Tasks copy the files and digest them on the way; files of the base are linked where the store allows it.  want:
    digests that are due.  The manifest comes last, so a version without one was never finished, and can't be published.
    """
    path = version_of(folder, version)
    gates.require(not os.path.exists(path), f"version {version} exists")
    gates.require(not any("/" in n or n[0] == "." or n == "manifest.json" for n in sources), "names leave the folder")
    kept = {n: r for n, r in (manifest_of(folder, base) if base else {}).items() if n not in sources}
    os.makedirs(path)

    def work(batches):
        for b in batches:
            for name, source in zip(b["name"].to_pylist(), b["path"].to_pylist()):
                part, sha, n = f"{path}/.{name}.{uuid.uuid4().hex}.part", hashlib.sha256(), 0
                with files.opened(source) as f, open(part, "wb") as out:
                    while block := f.read(files.PIECE):
                        sha.update(block)
                        out.write(block)
                        n += len(block)
                os.replace(part, f"{path}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=["name", "bytes", "sha256"])

    asked = spark.createDataFrame(sorted(sources.items()), "name string, path string")
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = {r["name"]: r.asDict() for r in asked.repartition(spread, "name").mapInArrow(work, "name string, bytes long, sha256 string").collect()}
    bad = sorted(n for n, sha in (want or {}).items() if done.get(n, kept.get(n, {})).get("sha256") != sha.lower())
    gates.require(not bad, f"digests differ: {bad}")
    for n in kept:
        try:
            os.link(f"{version_of(folder, base)}/{n}", f"{path}/{n}")
        except OSError:
            with open(f"{version_of(folder, base)}/{n}", "rb") as f, open(f"{path}/{n}", "wb") as out:
                while block := f.read(files.PIECE):
                    out.write(block)
    rows = sorted((kept | done).values(), key=lambda r: r["name"])
    put(f"{path}/manifest.json", json.dumps({"version": version, "base": base, "files": rows}, indent=2).encode())
    return listed(spark, folder, version)


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version current, if its files are exactly those of its manifest, digest by digest; an older one too."""
    path = version_of(folder, version)
    gates.require(os.path.exists(f"{path}/manifest.json"), f"version {version} isn't finished")
    found = bundle.inventory(spark, path).where("name <> 'manifest.json'")
    bad = bundle.compare(found, listed(spark, folder, version)).take(5)
    gates.require(not bad, f"version {version} differs from its manifest: {bad}")
    with open(f"{path}/manifest.json", "rb") as f:
        pointer = {"version": version, "manifest": hashlib.file_digest(f, "sha256").hexdigest()}
    put(f"{folder}/CURRENT", json.dumps(pointer).encode())
