"""Corrections onto catalogue rows: lookup by field and identity, precedence, range override, caps, totals."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.sky import f32
from skyweave.operators import gates, joins
from skyweave.sources import binary

#: Fixed: redshift fields (name, low, high), half open, compared in single precision.
FIELDS = [("BGS", 0.1, 0.4), ("LRG", 0.4, 0.8), ("LRG_ELG", 0.8, 1.1), ("ELG", 1.1, 1.6), ("QSO", 1.6, 2.1)]
FOG_CAP, RSD_CAP, LOW_Z = 300.001, 150.0, (0.01, 0.4)


def extend(base: DataFrame, extension: DataFrame) -> DataFrame:
    """Base and extension caches (tracer, targetid, delta_mpc) as one; a shared (tracer, targetid) aborts."""
    both = base.select("tracer", "targetid", "delta_mpc").unionByName(extension.select("tracer", "targetid", "delta_mpc"))
    return gates.unique(both, "tracer", "targetid")


def materialise(viewer: DataFrame, fog: DataFrame, rsd: DataFrame, low_z: DataFrame | None = None, fields=FIELDS) -> DataFrame:
    """viewer (chunk, pos_in_chunk, targetid, z) with fog_mpc, rsd_mpc, field and matched.

    A row takes the value of its own field only; a candidate low-z table replaces the whole of its redshift range,
    misses included.
    """
    rows = joins.lookup(viewer, fog.withColumnRenamed("delta_mpc", "fog_mpc"), "targetid", "fog_mpc")
    named = rows.withColumn("field", joins.interval32(F.col("z"), fields))
    cache = rsd.select(F.col("tracer").alias("_field"), F.col("targetid").alias("_id"), F.col("delta_mpc").alias("_delta"))
    out = named.join(cache, (named["field"] == F.col("_field")) & (named["targetid"] == F.col("_id")), "left").select(named["*"], F.coalesce("_delta", F.lit(0.0)).cast("float").alias("rsd_mpc"), F.col("_id").isNotNull().alias("matched"))
    if low_z is not None:
        new = low_z.select(F.col("targetid").alias("_id"), F.col("delta_mpc").alias("_new"))
        joined = out.join(new, out["targetid"] == F.col("_id"), "left")
        z, (low, high) = f32(F.col("z")), LOW_Z
        inside = (z >= f32(low)) & (z < f32(high))
        value = joins.override_range(F.col("rsd_mpc"), F.col("_new"), z, f32(low), f32(high)).cast("float")
        out = joined.select(*[F.col(c) for c in named.columns], value.alias("rsd_mpc"), F.when(inside, F.col("_id").isNotNull()).otherwise(F.col("matched")).alias("matched"))
    gates.within(out, "fog_mpc", FOG_CAP)
    gates.within(out, "rsd_mpc", RSD_CAP)
    return out


def totals(rows: DataFrame) -> DataFrame:
    """Per-chunk and grand totals of materialise()."""
    return rows.rollup("chunk").agg(F.count("*").alias("rows"), F.count_if(F.col("fog_mpc") != 0).alias("fog_nonzero"), F.count_if(F.col("rsd_mpc") != 0).alias("rsd_nonzero"), F.count_if("matched").alias("matched"), F.count_if(F.col("field").isNotNull()).alias("eligible"))


def pairs(catalogue: DataFrame, rows: DataFrame) -> DataFrame:
    """row_index, targetid, fog_mpc, rsd_mpc for every catalogue row: the corrections of its identity, 0 without any.

    An identity that materialise() gave more than one pair of values aborts.
    """
    one = rows.groupBy("targetid").agg(*[f(c).alias(f"{n}_{c}") for c in ("fog_mpc", "rsd_mpc") for n, f in (("lo", F.min), ("hi", F.max))])
    split = one.where("lo_fog_mpc <> hi_fog_mpc OR lo_rsd_mpc <> hi_rsd_mpc").take(1)
    gates.require(not split, f"an identity has two corrections: {split}")
    values = one.select("targetid", F.col("lo_fog_mpc").alias("fog_mpc"), F.col("lo_rsd_mpc").alias("rsd_mpc"))
    return joins.with_defaults(catalogue.select("row_index", "targetid"), values, "targetid", {"fog_mpc": 0.0, "rsd_mpc": 0.0})


def write_pairs(paired: DataFrame, path: str) -> dict:
    """The rows of pairs() as a gzip file of two floats a row, in row order, packed by parts that must unpack to the same rows. Gives its report.

    A file that exists, row numbers that aren't 0, 1, 2 ..., adjacent equal identities and values that aren't finite abort.
    """
    for c in ("fog_mpc", "rsd_mpc"):
        gates.within(paired, c, float("inf"))
    after = paired.select((F.col("row_index") - 1).alias("row_index"), F.col("targetid").alias("next"))
    gates.require(not paired.join(after, "row_index").where("targetid = next").take(1), "an identity repeats")
    if os.path.exists(path):
        raise FileExistsError(path)
    folder, name = os.path.split(path)
    rows = paired.select("row_index", *[F.col(c).cast("float").alias(c) for c in ("fog_mpc", "rsd_mpc")])
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("fog_mpc") != 0).alias("fogNonzero"), F.count_if(F.col("rsd_mpc") != 0).alias("rsdNonzero"), F.min("row_index").alias("first"), F.max("row_index").alias("last")).first().asDict()
    gates.require((counts.pop("first"), counts.pop("last")) == (0, counts["rows"] - 1), "row_index isn't 0 to the number of rows")
    packed = gates.exactly_one(binary.write_files(binary.encode_pairs(rows, "fog_mpc", "rsd_mpc", name), folder or "."))
    return {"file": name, **counts, "bytes": packed["bytes"], "sha256": packed["sha256"], "validated": True}


def write_cache(rows: DataFrame, folder: str) -> None:
    """tracer, region, targetid, delta_mpc as a table by tracer and region, in files of ranges of identities; a folder that exists aborts."""
    gates.unique(rows, "tracer", "region", "targetid")
    gates.within(rows, "delta_mpc", float("inf"))
    cols = [F.col("tracer"), F.col("region"), F.col("targetid"), F.col("delta_mpc").cast("float").alias("delta_mpc")]
    rows.select(*cols).repartitionByRange("tracer", "region", "targetid").write.mode("errorifexists").partitionBy("tracer", "region").parquet(folder)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The table of write_cache(); filters on tracer and region read only their folders."""
    return spark.read.schema("targetid long, delta_mpc float, tracer string, region string").parquet(folder)


def write_payloads(rows: DataFrame, folder: str, extended: bool = False) -> DataFrame:
    """The values of materialise() as one file a chunk and kind; with extensions the folder must be empty. Gives name, bytes, sha256."""
    if extended:
        gates.vacant(rows.sparkSession, folder)
    files = binary.encode_payload(rows, "fog_mpc", "fog_%03d.bin").unionByName(binary.encode_payload(rows, "rsd_mpc", "rsd_%03d.bin"))
    return binary.write_files(files, folder)
