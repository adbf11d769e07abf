"""Identity matching of a growing folder, with state that is kept once and batches that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyweave.operators import gates, identity


def known_keys(catalogue: DataFrame, key: str, folder: str, buckets: int | None = None) -> DataFrame:
    """How many catalogue rows (source_hits) each key has, written once, in buckets by the key: the state of match_new()."""
    counted = catalogue.groupBy(key).agg(F.count("*").alias("source_hits"))
    return catalogue.sparkSession.table(identity.store(counted, key, folder, buckets))


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def match_new(spark: SparkSession, folder: str, schema: str, known: DataFrame, key: str, out: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Match rows of Parquet files that are new since the checkpoint, write them to out by batch, and end.

    known: known_keys(), which no batch counts anew.  A batch goes to the folder batch=<its number>, in place of what a
    stopped attempt at it left, so each file's rows are there once, however often the query is stopped.  Results without
    the checkpoint that numbered them abort, as numbers would begin again.
    """
    gates.require("source_hits" in known.columns, "known is a table of known_keys()")
    gates.require(there(spark, checkpoint) or not there(spark, out), f"{out} exists, but not the checkpoint of its batches")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.join(known, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and distinct-free sums by event-time window, for bounded or unbounded events."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, length), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")
