"""Tables laid out by identity: joined without an exchange, and asked for one identity by reading one bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skyweave.operators import gates


def store(rows: DataFrame, key: str, folder: str, buckets: int | None = None, name: str | None = None) -> str:
    """Write rows to a new folder in buckets by the key's hash, each sorted by it; gives the name of the catalogue table.

    Tables that shall meet without an exchange need the same number of buckets.  One task writes a bucket, so that it
    is one file; `buckets` is the session's number of shuffle partitions unless given.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"skyweave_{uuid.uuid4().hex}"
    rows.repartition(n, key).write.mode("errorifexists").bucketBy(n, key).sortBy(key).option("path", folder).format("parquet").saveAsTable(name)
    return name


def attach(spark: SparkSession, name: str, folder: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A folder of store() as a table of this session's catalogue: sessions after the one that wrote it need this."""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def find(table: DataFrame, key: str, value: int) -> DataFrame:
    """The rows of one identity: of a table of store(), one bucket is read, and of it the row groups whose ends hold the value."""
    return table.where(table[key] == value)


def inspect(corrections: dict[str, DataFrame], value: int, key: str = "targetid") -> list[dict]:
    """tracer, row, fogMpc, rsdMpc, combinedMpc of an identity in the first tracer's table (row_index, fog_mpc, rsd_mpc) that has it; an unknown one aborts."""
    for tracer, table in corrections.items():
        found = sorted(find(table, key, value).select("row_index", "fog_mpc", "rsd_mpc").collect())
        if found:
            return [{"tracer": tracer, "row": r["row_index"], "fogMpc": r["fog_mpc"], "rsdMpc": r["rsd_mpc"], "combinedMpc": r["fog_mpc"] + r["rsd_mpc"]} for r in found]
    gates.require(False, f"{key} {value} isn't there")
    return []
