"""What intermediate work leaves on disk."""

import os
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyweave import storage
from skyweave.llm import jaccard_join


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    setting, before = spark.conf.get(storage.CLEANUP), shuffle_files(spark)
    df = spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).count()
    out = storage.materialize(df, "grouped")
    for _ in range(50):  # they go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.count() == 977 == df.count() and spark.conf.get(storage.CLEANUP) == setting


def test_pipeline_keeps_one_stage_at_a_time(spark, monkeypatch, tmp_path):
    paths = []

    def folder(session, tag):
        paths.append(f"{tmp_path}/{tag}-{len(paths)}")
        return paths[-1]

    monkeypatch.setattr(storage, "fresh_folder", folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda session, docs, sf_dir: docs.where("doc_id >= 0")) for k in range(4)])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and len(paths) == 3 and [os.path.exists(p) for p in paths] == [False, False, True]


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_near_copies_go_with_and_without_a_table_of_bits(spark, limit):
    before, text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (5, text), (3, text + " more"), (7, "another text of its own kind"), (8, None), (8, None), (None, text), (9, text)]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[2], rows[3], rows[4], rows[5]], kept.schema).collect()))
        again = jaccard_join.one_of_each(spark.createDataFrame([rows[0], rows[1], rows[3]], "doc_id long, text string"))
        assert sorted(r.doc_id for r in again.collect()) == [5, 7]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
