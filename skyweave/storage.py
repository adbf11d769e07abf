"""Where plans keep intermediate tables: the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it names none, a folder of the warehouse, or in local mode, where executors are the driver, a fresh local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/skyweave-intermediate"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="skyweave-"))
    return _own[0]


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside gives back its shuffle files when it ends; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, whichever executor is lost later, and the shuffle files go."""
    path = fresh_folder(df.sparkSession, tag)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


#: Tables of materialize() and their folders, by the identity of the DataFrame, which the entry keeps from being another's.
_written: dict[int, tuple[DataFrame, str]] = {}


def forget(df: DataFrame) -> None:
    """Delete the folder of a table of materialize() that no plan will read again."""
    _, path = _written.pop(id(df), (None, None))
    if path:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
