"""Order, numbering, delta coding, sampling and partition of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.functions.sky import morton, spatial_chunk, wrap16
from skyweave.storage import materialize


def key_parts(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """df with _part: quantiles of a numeric key cut its range into parts, one for each shuffle partition, 16 at least and 1,024 at most, unless given; equal keys share a part."""
    parts = parts or min(1024, max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.001))) if parts > 1 else []

    def search(low: int, high: int) -> Column:
        """Which of the parts low to high holds the key: a tree of comparisons."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key).cast("double") > F.lit(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return df.withColumn("_part", search(0, len(cuts)))


def written_parts(df: DataFrame, key: str) -> DataFrame:
    """key_parts of a written copy: quantiles, what parts say and the rows themselves read it, and none of them makes df again."""
    return key_parts(materialize(df, "rows"), key)


def ordinal(df: DataFrame, key: str, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """Number rows from 0 in the order of a unique numeric key, without gathering them.

    Rows are numbered inside their part of the key's range and start where the parts before end.
    """
    placed = key_parts(materialize(df, "rows"), key, parts)
    sums = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over at most `parts` rows
    begin = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part"), F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_begin"))
    within = Window.partitionBy("_part").orderBy(key)
    return placed.withColumn("_k", F.row_number().over(within)).join(F.broadcast(begin), "_part").withColumn(name, (F.col("_begin") + F.col("_k") - 1).cast("long")).select(*df.columns, name)


def with_before(placed: DataFrame, group: str, own: list[Column], before: list[Column]) -> DataFrame:
    """placed (with _part) with what the group's parts before a row's part say.

    own: aggregates of a part; before: windows over these in the order of a group's parts, which have at most as many
    rows of a group as there are parts.  They are written, so that their size is known and few meet the rows without a shuffle.
    """
    sums = materialize(placed.groupBy(group, "_part").agg(*own).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *before), "parts")
    return placed.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p")


def positions(df: DataFrame, group: str, keys: list[str], name: str = "pos") -> DataFrame:
    """Number the rows of each group from 0 in the order of keys, in parts of the first one (numeric), so that a group isn't a task."""
    earlier = Window.partitionBy(F.col(group)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = with_before(written_parts(df, keys[0]), group, [F.count("*").alias("_n")], [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin")])
    k = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*keys))
    return begun.withColumn(name, (F.col("_begin") + k - 1).cast("long")).select(*df.columns, name)


def even_odd(df: DataFrame, key: str) -> DataFrame:
    """train (even ordinals) or holdout."""
    return ordinal(df, key, "_ordinal").withColumn("is_train", F.col("_ordinal") % 2 == 0).drop("_ordinal")


def stride(df: DataFrame, row: str, rows: int, limit: int) -> DataFrame:
    """Every step-th row, step = rows // limit; 0 keeps all; may keep more than limit."""
    step = max(1, rows // limit) if limit else 1
    return df.where(F.col(row) % step == 0)


def key_blocks(df: DataFrame, key: str, size: int = 50_000) -> DataFrame:
    """block, low, high, n of sorted keys, size at a time."""
    return ordinal(df.select(key).distinct(), key).groupBy(F.floor(F.col("ordinal") / size).cast("long").alias("block")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))


def even_picks(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows (or all, if fewer) evenly spaced in the order of key: ordinals floor(i * rows / n)."""
    rows = df.count()
    want = df.sparkSession.range(min(n, rows)).select(F.floor(F.col("id") * (rows / max(1, min(n, rows)))).cast("long").alias("ordinal"))
    return ordinal(df, key).join(F.broadcast(want), "ordinal")


def equal_split(df: DataFrame, key: str, n: int) -> DataFrame:
    """part 1 to n of contiguous near-equal parts, the first ones one row longer."""
    rows = df.count()
    small, longer = divmod(rows, n)
    k = F.col("_ordinal")
    edge = longer * (small + 1)
    part = F.when(k < edge, F.floor(k / (small + 1))).otherwise(longer + F.floor((k - edge) / max(1, small)))
    return ordinal(df, key, "_ordinal").withColumn("part", (part + 1).cast("int")).drop("_ordinal")


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """The first n rows of each key: first inside salted parts of the key, then among what is left."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    inner = Window.partitionBy(key, "_salt").orderBy(*order)
    outer = Window.partitionBy(key).orderBy(*order)
    some = df.withColumn("_salt", salt).withColumn("_k", F.row_number().over(inner)).where(F.col("_k") <= n)
    return some.withColumn("_k", F.row_number().over(outer)).where(F.col("_k") <= n).drop("_salt", "_k")


def hash_rank(*columns: str, seed: str = "") -> Column:
    """A pseudo-random order that other engines can reproduce."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(seed)).cast("binary"))


def hash_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each stratum, by rank of the hash of their key."""
    return top_per_key(df.withColumn("_h", hash_rank(key, seed=seed)), stratum, [F.col("_h"), F.col(key)], n).drop("_h")


def largest(df: DataFrame, value: Column, key: str, n: int = 25) -> DataFrame:
    """Top n by absolute value; ties by key."""
    return df.orderBy(F.abs(value).desc(), key).limit(n)


def ordered_chunks(df: DataFrame, q: tuple[str, str, str] = ("qx", "qy", "qz"), row: str = "row_index", n: int = 12) -> DataFrame:
    """chunk, pos_in_chunk: hash partition of positions, Z-order inside, ties by source row.

    A chunk is numbered in parts of the Z-order, so that its n chunks aren't n tasks; rows of one cell share a part.
    """
    x, y, z = (F.col(c) for c in q)
    placed = written_parts(df.withColumn("chunk", spatial_chunk(x, y, z, n)).withColumn("morton", morton(x, y, z)), "morton")
    earlier = Window.partitionBy(F.col("chunk")).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = with_before(placed, "chunk", [F.count("*").alias("_n")], [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin")])
    k = F.row_number().over(Window.partitionBy("chunk", "_part").orderBy("morton", row))
    return begun.withColumn("pos_in_chunk", (F.col("_begin") + k - 1).cast("int")).drop("_part", "_begin")


def delta_encode(df: DataFrame, columns: list[str], group: str = "chunk", position: str = "pos_in_chunk") -> DataFrame:
    """d<column>: difference to the row before, the first being absolute, wrapped to 16 bits.

    A group is taken in parts of its positions; the first row of a part meets the last one of the part before.
    """
    parts = Window.partitionBy(group).orderBy("_part")
    last = F.max_by(F.struct(*columns), position).alias("_last")
    met = with_before(written_parts(df, position), group, [last], [F.lag(F.col(f"_last.{c}"), 1, 0).over(parts).alias(f"_last_{c}") for c in columns])
    w = Window.partitionBy(group, "_part").orderBy(position)
    before = lambda c: F.when(F.row_number().over(w) == 1, F.col(f"_last_{c}")).otherwise(F.lag(c).over(w))
    return met.select(*df.columns, *[wrap16(F.col(c) - before(c)).alias(f"d{c}") for c in columns])


def delta_decode(df: DataFrame, columns: list[str], group: str = "chunk", position: str = "pos_in_chunk") -> DataFrame:
    """What delta_encode took: running sums, wrapped to 16 bits, over parts of a group that start from the sums of the parts before."""
    parts = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = [F.sum(F.col(f"d{c}").cast("bigint")).alias(f"_sum_{c}") for c in columns]
    met = with_before(written_parts(df, position), group, total, [F.coalesce(F.sum(f"_sum_{c}").over(parts), F.lit(0)).alias(f"_begin_{c}") for c in columns])
    w = Window.partitionBy(group, "_part").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.select(*df.columns, *[wrap16(F.col(f"_begin_{c}") + F.sum(F.col(f"d{c}").cast("bigint")).over(w)).alias(f"{c}_decoded") for c in columns])


def adjacent_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """repeats: the row before, in order, has the same keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("repeats", F.row_number().over(w) > 1)


def shuffled(df: DataFrame, key: str, value: str, seed: str = "42") -> DataFrame:
    """shuffled_<value>: the values dealt to the keys anew, by rank of a hash, as a control."""
    by_key = ordinal(df.select(key, value), key, "_n")
    # the hash as a number, so that it can be cut by quantiles; ties by key
    h = F.conv(F.substring(hash_rank(key, seed=seed), 1, 13), 16, 10).cast("bigint")
    by_hash = ordinal(df.select(F.col(value).alias(f"shuffled_{value}"), h.alias("_h")), "_h", "_n").drop("_h")
    return by_key.join(by_hash, "_n").drop("_n")
