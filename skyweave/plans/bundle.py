"""Bundles of files with a manifest: inventory, verification, finalisation, inspection of inputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.sky import finite
from skyweave.operators import aggregates, gates
from skyweave.sources import binary, files
from skyweave.storage import materialize


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes, sha256 of the files of a folder; files of any size, streamed by tasks."""
    return files.digests(files.listing(spark, folder))


def compare(found: DataFrame, listed: DataFrame) -> DataFrame:
    """name and fault of files that are missing, unlisted, or differ in size or digest."""
    a, b = found.select("name", F.col("bytes").alias("fb"), F.col("sha256").alias("fs")), listed.select("name", F.col("bytes").alias("lb"), F.col("sha256").alias("ls"))
    fault = F.when(F.col("fb").isNull(), "missing").when(F.col("lb").isNull(), "unlisted").when(F.col("fb") != F.col("lb"), "size").when(F.lower("fs") != F.lower("ls"), "digest")
    return a.join(b, "name", "full_outer").select("name", fault.alias("fault")).where("fault IS NOT NULL")


def verify(spark: SparkSession, folder: str, listed: DataFrame) -> None:
    """Abort unless the folder holds exactly the listed files."""
    bad = compare(inventory(spark, folder), listed).take(5)
    gates.require(not bad, f"bundle differs: {bad}")


def verify_chunks(chunks: DataFrame, payloads: dict[str, DataFrame], counts: dict[int, int], caps: dict[str, float]) -> DataFrame:
    """Decoded chunks and payloads against the manifest's counts: every chunk and payload has its rows, values are finite and within caps. Gives rows by chunk."""
    want = chunks.sparkSession.createDataFrame(sorted(counts.items()), "chunk int, due long")
    got = chunks.groupBy("chunk").agg(F.count("*").alias("rows"))
    for name, rows in payloads.items():
        got = got.join(rows.groupBy("chunk").agg(F.count("*").alias(f"n_{name}"), F.max(F.abs(name)).alias(f"most_{name}"), F.count_if(~finite(F.col(name))).alias(f"odd_{name}")), "chunk", "full_outer")
    both = got.join(want, "chunk", "full_outer")
    wrong = ~F.col("rows").eqNullSafe(F.col("due"))
    for name in payloads:
        wrong = wrong | ~F.col(f"n_{name}").eqNullSafe(F.col("due")) | (F.col(f"odd_{name}") > 0) | (F.col(f"most_{name}") > caps[name])
    bad = both.where(wrong).take(3)
    gates.require(not bad, f"chunks differ from the manifest: {bad}")
    return got.select("chunk", "rows")


def finalise(manifest: dict, listed: DataFrame, **extra) -> str:
    """The manifest as JSON with each chunk's bytes and digest; every chunk's file must be there."""
    found = {r["name"]: r for r in listed.collect()}
    missing = [c["file"] for c in manifest["chunks"] if c["file"] not in found]
    gates.require(not missing, f"files are missing: {missing}")
    chunks = [{**c, "bytes": found[c["file"]]["bytes"], "sha256": found[c["file"]]["sha256"]} for c in manifest["chunks"]]
    gates.require(sum(c["count"] for c in chunks) == manifest["count"], "chunk counts don't add up")
    return json.dumps({**manifest, **extra, "chunks": chunks}, indent=2)


def overlay(base: DataFrame, new: DataFrame) -> DataFrame:
    """Files of a staged bundle: new ones in place of base ones of the same name."""
    return base.join(new.select("name"), "name", "left_anti").withColumn("origin", F.lit("base")).unionByName(new.withColumn("origin", F.lit("new")))


def inspect(rows: DataFrame, required: list[str], value: str = "z", points=(0.0, 0.01, 0.5, 0.99, 1.0)) -> dict:
    """Rows, missing columns, and percentiles of a value over finite rows."""
    missing = sorted(set(required) - set(rows.columns))
    out = {"columns": rows.columns, "missing": missing, "rows": rows.count()}
    if value in rows.columns:
        own = materialize(rows.where(finite(F.col(value))).select(value), "values")  # read by several passes
        out["percentiles"] = aggregates.exact_percentiles(own, value, list(points)).get(0)
    return out


def complete(receipts: DataFrame, total: int) -> DataFrame:
    """Receipts of a compact source (name, rows, sha256): all there, none twice."""
    gates.unique(receipts, "name")
    return gates.row_count(receipts, total)


def round_trip(rows: DataFrame, folder: str, kind: str = "consolidated") -> None:
    """Write rows as chunk files, read them again, and abort unless they are the same rows in the same places."""
    encode, decode = {"consolidated": (binary.encode_consolidated, binary.decode_consolidated), "chunks": (binary.encode_chunks, binary.decode_chunks)}[kind]
    binary.write_files(encode(rows), folder).count()
    back = decode(binary.files(rows.sparkSession, folder))
    same = rows.select(*[F.col(c).cast(back.schema[c].dataType).alias(c) for c in back.columns])
    lost = same.exceptAll(back).take(1) or back.exceptAll(same).take(1)
    gates.require(not lost, f"rows changed on the way: {lost}")
