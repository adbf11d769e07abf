"""Listings, checksums, manifests, remote tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: file names of clustering catalogues: name, region, number of the random, kind.
CLUSTERING = r"^(.+)_(NGC|SGC)(?:_(\d+))?_clustering\.(dat|ran)\.fits$"
#: Fixed: the tracer of each name.
TRACERS = {"BGS_BRIGHT-21.5": "BGS", "LRG": "LRG", "LRG+ELG_LOPnotqso": "LRG_ELG", "ELG_LOPnotqso": "ELG", "QSO": "QSO"}


def clustering_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, path, bytes, name, and tracer (null for an unknown name), region, random_index, kind; contents aren't read."""
    raw = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -1).alias("file"))
    part = lambda k: F.regexp_extract("file", CLUSTERING, k)
    tracer = F.lit(None).cast("string")
    for name, known in TRACERS.items():
        tracer = F.when(F.col("name") == name, F.lit(known)).otherwise(tracer)
    found = raw.where(F.col("file").rlike(CLUSTERING)).withColumn("name", part(1))
    return found.select("file", "path", "bytes", "name", tracer.alias("tracer"), part(2).alias("region"), F.when(part(3) != "", part(3).cast("int")).alias("random_index"), F.when(part(4) == "dat", "data").otherwise("random").alias("kind"))


def local_files(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """file, path, bytes, tracer, region, random_index, kind of the catalogues of known tracers; strict: another name aborts."""
    from skyweave.operators.gates import require

    found = clustering_files(spark, folder)
    if strict:
        odd = [r["file"] for r in unknown_files(spark, folder).select("file").take(5)]
        require(not odd, f"unknown tracers: {odd}")
    return found.where(F.col("tracer").isNotNull()).drop("name")


def unknown_files(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogues whose name is none of TRACERS, which local_files() leaves out."""
    return clustering_files(spark, folder).where(F.col("tracer").isNull())


def source_path(found: DataFrame, tracer: str, region: str, kind: str) -> str:
    """The first file by name."""
    from skyweave.operators.gates import exactly_one

    return exactly_one(found.where((F.col("tracer") == tracer) & (F.col("region") == region) & (F.col("kind") == kind)).orderBy("file").limit(1))["path"]


def links(pages: DataFrame, column: str, pattern: str) -> DataFrame:
    """link: all matches of the pattern's first group in a directory index."""
    return pages.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("link")).distinct()


def checksums(lines: DataFrame) -> DataFrame:
    """name, sha256 of lines '<digest>  <name>'."""
    return lines.where(F.col("value").rlike(r"^[0-9a-fA-F]{64}\s")).select(F.regexp_extract("value", r"^\S+\s+\*?(?:\./)?(.+?)\s*$", 1).alias("name"), F.lower(F.substring("value", 1, 64)).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def photometry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed measurements; empty numbers are NaN, types are trimmed."""
    raw = spark.read.csv(path, header=True, schema="targetid bigint, type string, shape_r string, flux_g string, flux_r string, flux_z string")
    number = lambda c: F.when(F.trim(c) == "", F.lit(float("nan"))).otherwise(F.coalesce(F.try_to_number(F.trim(c), F.lit("S999999999999D999999999")).cast("double"), F.expr(f"try_cast(trim({c}) AS double)"), F.lit(float("nan")))).cast("float").alias(c)
    return raw.select("targetid", F.trim("type").alias("type"), *[number(c) for c in ("shape_r", "flux_g", "flux_r", "flux_z")])


def by_key_ranges(spark: SparkSession, url: str, table: str, key: str, blocks: list[tuple[int, int]], **options) -> DataFrame:
    """A remote table, one partition for each range of keys."""
    where = [f"{key} BETWEEN {a} AND {b}" for a, b in blocks]
    return spark.read.jdbc(url, table, predicates=where, properties=options)


def complete_table(rows: DataFrame, url: str, table: str, **options) -> DataFrame:
    """rows of by_key_ranges(), if the source counts as many: blocks that miss keys or overlap abort."""
    from skyweave.operators.gates import row_count

    counted = rows.sparkSession.read.jdbc(url, f"(SELECT COUNT(*) AS N FROM {table}) t", properties=options)
    return row_count(rows, int(counted.first()[0]))


def merge_reports(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Reports by key: new ones replace old ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_csv(df: DataFrame, path: str, digits: dict[str, int]) -> None:
    """CSV with a header; the named columns with so many significant digits."""
    cols = [F.format_string(f"%.{digits[c]}g", F.col(c).cast("double")).alias(c) if c in digits else F.col(c) for c in df.columns]
    df.select(*cols).write.option("header", True).csv(path)


def receipt(df: DataFrame, key: str, query: str = "") -> DataFrame:
    """Rows, a digest that doesn't depend on their order, and the query text."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(row).alias("digest")).withColumn("query", F.lit(query))


def stamped(df: DataFrame) -> DataFrame:
    """df with generated_at: the time of the query in UTC, ISO 8601."""
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return df.withColumn("generated_at", at)


def sources_report(found: DataFrame, catalogue: str, tracer: str | None = None) -> DataFrame:
    """One row: generated_at, catalogue, files (of one tracer or all, by name), total_bytes of a listing."""
    chosen = found.where(F.col("tracer") == tracer) if tracer else found
    one = chosen.agg(F.sort_array(F.collect_list(F.struct("file", "path", "bytes", "tracer", "region", "random_index", "kind"))).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    return stamped(one.withColumn("catalogue", F.lit(catalogue))).select("generated_at", "catalogue", "files", "total_bytes")
