"""Layout steps make their input once."""

import pytest
from pyspark.sql import functions as F

from skyweave.operators import layout


@pytest.mark.parametrize("step", ["positions", "encode", "decode"])
def test_layout_steps_make_their_input_once(spark, step):
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(5000).select((F.col("id") % 3).alias("chunk"), F.floor(F.col("id") / 3).alias("pos"), (F.col("id") % 50).cast("int").alias("q"), (F.col("id") % 50).cast("int").alias("dq"))
    df = df.mapInArrow(passing, df.schema)
    out = {"positions": lambda: layout.positions(df, "chunk", ["pos"], "at"), "encode": lambda: layout.delta_encode(df.drop("dq"), ["q"], "chunk", "pos"), "decode": lambda: layout.delta_decode(df.drop("q"), ["q"], "chunk", "pos")}[step]()
    assert len(out.collect()) == 5000 and seen.value == 5000
