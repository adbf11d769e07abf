"""A corpus pipeline of operators of skyweave.llm: each stage works on all rows that its predecessor kept.

`documents` goes in; toxic documents, all but one of equal texts, all but one of each near-duplicate group and
documents that hold benchmark passages go; the rest is encoded, and decoded again to prove it.

Cases: a null text is empty: it isn't toxic, is a copy of the other empty ones, resembles nothing and has no tokens; of
rows that repeat doc_id and text one stays; rows without doc_id take part; of equal texts the largest doc_id stays, of
near ones the smallest; long texts are judged whole; stages but the last keep all columns, whatever their names; empty
tables give empty tables; without labels no document is toxic or, with positive ones alone, each is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyweave.llm import bpe, decontamination, exact_dedup, jaccard_join, queries, toxicity
from skyweave.llm.util import materialize
from skyweave.storage import forget


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_clean(docs, toxicity.fit(docs, queries.labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.filter_clean(docs, queries.benchmark(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(docs, queries.vocabulary()))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("BPE encoding and decoding", encode)]

#: A learned classifier decides in the first stage, which SQL can't express; tests/llm/test_pipeline.py holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
            forget(before)  # the table of the stage before; what was written while it ran goes when the driver ends
    return docs
