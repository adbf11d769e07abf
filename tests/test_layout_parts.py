"""Chunk numbering and delta coding by parts against plain loops: few groups, null groups and values, empty tables."""

import random

import pytest

from skyweave.operators import layout


def wrapped(x):
    return (x + 32768) % 65536 - 32768


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_delta_round_trip(spark, groups):
    r = random.Random(groups)
    rows = [(g if g else None, p, r.randint(-32768, 32767)) for g in range(groups) for p in range(r.choice([1, 2, 90]))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "chunk int, pos_in_chunk long, q int")
    coded = layout.delta_encode(df, ["q"])
    want, before = {}, {}
    for g, p, q in rows:
        want[g, p] = wrapped(q - before.get(g, 0))
        before[g] = q
    assert {(x["chunk"], x["pos_in_chunk"]): x["dq"] for x in coded.collect()} == want
    back = layout.delta_decode(coded, ["q"]).collect()
    assert len(back) == len(rows) and all(x["q"] == x["q_decoded"] for x in back)


def test_null_values_and_empty(spark):
    df = spark.createDataFrame([(0, p, None if p % 3 == 1 else p) for p in range(50)], "chunk int, pos_in_chunk long, q int")
    got = {x["pos_in_chunk"]: x["dq"] for x in layout.delta_encode(df, ["q"]).collect()}
    assert got == {p: None if p % 3 == 1 or (p - 1) % 3 == 1 else (p - (p - 1 if p else 0)) for p in range(50)}
    empty = df.where("chunk = 1")
    assert layout.delta_encode(empty, ["q"]).count() == 0
    assert layout.ordered_chunks(spark.createDataFrame([], "row_index long, qx int, qy int, qz int")).count() == 0


def test_one_hot_cell(spark):
    """A third of all rows at one position: numbers have no gaps and follow Z-order, then the source row."""
    r = random.Random(5)
    rows = [(k, *((7, 7, 7) if k % 3 == 0 else (r.randint(-99, 99), r.randint(-99, 99), r.randint(-99, 99)))) for k in range(600)]
    got = layout.ordered_chunks(spark.createDataFrame(rows, "row_index long, qx int, qy int, qz int"), n=2).collect()
    for chunk in {x["chunk"] for x in got}:
        own = sorted((x["morton"], x["row_index"], x["pos_in_chunk"]) for x in got if x["chunk"] == chunk)
        assert [x[2] for x in own] == list(range(len(own)))
