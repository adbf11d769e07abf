"""Joins by exact identity, by interval, and by precedence."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.operators import layout
from skyweave.storage import materialize


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default=0.0, found: str | None = None) -> DataFrame:
    """Left join by key: the table's value or the default, and whether there was one. Keys of the table are unique."""
    right = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_found"))
    out = rows.join(right, rows[key] == F.col("_key"), "left")
    hit = F.coalesce("_found", F.lit(False))
    return out.select(rows["*"], F.coalesce("_value", F.lit(default)).alias(value), *([hit.alias(found)] if found else []))


def with_defaults(rows: DataFrame, table: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join by key with a default for each column."""
    right = table.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in defaults])
    return rows.join(right, rows[key] == F.col("_key"), "left").select(rows["*"], *[F.coalesce(f"_{c}", F.lit(d)).alias(c) for c, d in defaults.items()])


def members(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_semi")


def others(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_anti")


def membership(rows: DataFrame, table: DataFrame, key: str, flag: str) -> DataFrame:
    right = table.select(F.col(key).alias("_key")).distinct().withColumn("_in", F.lit(True))
    return rows.join(right, rows[key] == F.col("_key"), "left").select(rows["*"], F.coalesce("_in", F.lit(False)).alias(flag))


def with_multiplicity(rows: DataFrame, table: DataFrame, key: str, count: str = "source_hits") -> DataFrame:
    """Inner join with how many rows of the table have the key."""
    return rows.join(table.groupBy(key).agg(F.count("*").alias(count)), key)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two sides that must hold the same keys, each once."""
    from skyweave.operators.gates import same_keys

    same_keys(left, right, key)
    return left.join(right, key)


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left_only, right_only, repeated: what keeps a join from being one to one."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((left, "a"), (right, "b")))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))


def interval(value: Column, bands: list[tuple], otherwise=None) -> Column:
    """Name of the half-open interval [low, high) that holds the value, as one CASE: (name, low, high)."""
    out = F.lit(otherwise)
    for name, low, high in reversed(bands):
        out = F.when((value >= low) & (value < high), F.lit(name)).otherwise(out)
    return out


def interval32(value: Column, bands: list[tuple], otherwise=None) -> Column:
    """The same where value and bounds compare in single precision."""
    return interval(value.cast("float"), [(n, F.lit(a).cast("float"), F.lit(b).cast("float")) for n, a, b in bands], otherwise)


def in_intervals(rows: DataFrame, value: str, table: DataFrame, low: str, high: str) -> DataFrame:
    """rows with each row of an interval table whose half-open [low, high) holds the value: an equi-join on cells, then the exact test.

    An interval lies in cells as wide as the power of two that is not less than its length, so in two of them at most;
    a value looks into one cell of each width that occurs.  Intervals may overlap, be nested, and be unbounded; they are
    first cut to the values' ends, so those that no value can meet are gone.  Nulls and NaN, and intervals that are
    empty, meet nothing.  Columns of both sides have different names.
    """
    clash = sorted(set(rows.columns) & set(table.columns))
    if clash:
        raise ValueError(f"columns of both sides: {clash}")
    x = F.col(value).cast("double")
    real = ~F.isnan(x) & x.isNotNull() & (F.abs(x) < float("inf"))
    ends = rows.where(real).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if ends["lo"] is None:
        return rows.crossJoin(table.limit(0))
    lo, hi = F.greatest(F.col(low).cast("double"), F.lit(ends["lo"])), F.least(F.col(high).cast("double"), F.lit(math.nextafter(ends["hi"], math.inf)))
    ok = F.col(low).isNotNull() & F.col(high).isNotNull() & ~F.isnan(F.col(low).cast("double")) & ~F.isnan(F.col(high).cast("double"))
    # cells so narrow that a double doesn't number them exactly aren't used
    floor_ = math.frexp(max(abs(ends["lo"]), abs(ends["hi"]), 1e-300))[1] - 50
    cut = table.where(ok).withColumn("_lo", lo).withColumn("_hi", hi).where("_lo < _hi")
    levelled = materialize(cut.withColumn("_level", F.greatest(F.ceil(F.log2(F.col("_hi") - F.col("_lo"))), F.lit(floor_)).cast("int")), "intervals")
    levels = sorted(r["_level"] for r in levelled.select("_level").distinct().collect())  # exponents of doubles: two thousand at most
    if not levels:
        return rows.crossJoin(table.limit(0))
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level)).cast("long")
    sides = F.explode(F.array_distinct(F.array(cell(F.col("_lo"), F.col("_level")), cell(F.col("_hi"), F.col("_level")))))
    right = levelled.withColumn("_cell", sides).select(*table.columns, "_level", "_cell")
    left = rows.where(real).withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_cell", cell(x, F.col("_level")))
    met = left.join(right, ["_level", "_cell"]).where((x >= F.col(low)) & (x < F.col(high)))
    return met.select(*rows.columns, *table.columns)


#: Children of a node of the tree of interval_totals, as a power of two.
FANOUT = 4


def interval_totals(rows: DataFrame, value: str, table: DataFrame, low: str, high: str, aggregates: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """table with aggregates over the rows whose value its half-open [low, high) holds; intervals that hold none are left out.

    No pair of a row and an interval is made: rows of one value are one point, points are numbered in order, and each 16
    neighbours are one node of the next level.  An interval is a range of numbers, which 30 nodes of each level at most
    make up.  Intervals may overlap, be nested, and be unbounded; nulls and NaN, and intervals that are empty, meet
    nothing.  aggregates: name to an aggregate of rows and the function that merges it (F.sum for counts and sums).
    """
    x = F.col(value).cast("double")
    merged = [merge(name).alias(name) for name, (_, merge) in aggregates.items()]
    real = ~F.isnan(x) & x.isNotNull() & (F.abs(x) < float("inf"))
    points = rows.where(real).groupBy(x.alias("_x")).agg(*[f.alias(name) for name, (f, _) in aggregates.items()])
    ends = [(F.col(c).cast("double") + F.lit(0.0)).alias(name) for c, name in ((low, "_low"), (high, "_high"))]
    spans = materialize(table.select(*ends).where("NOT isnan(_low) AND NOT isnan(_high) AND _low < _high").distinct(), "spans")
    marks = points.withColumn("_point", F.lit(1)).unionByName(spans.select(F.explode(F.array("_low", "_high")).alias("_x")).distinct().withColumn("_point", F.lit(0)), allowMissingColumns=True)
    # An end comes before the point of its value, so the points before it are those of smaller values.
    placed = layout.key_parts(materialize(marks, "marks"), "_x")
    begin = placed.groupBy("_part").agg(F.sum("_point").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    within = Window.partitionBy("_part").orderBy("_x", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("_k", F.sum("_point").over(within)).join(F.broadcast(begin), "_part")
    numbered = materialize(numbered.withColumn("_node", F.col("_begin") + F.col("_k") - F.col("_point")).drop("_part", "_begin", "_k"), "numbered")
    number = lambda c, to: numbered.where("_point = 0").select(F.col("_x").alias(c), F.col("_node").alias(to))
    ranges = materialize(spans.join(number("_low", "_a"), "_low").join(number("_high", "_b"), "_high").where("_a < _b"), "ranges")
    levels, width = [numbered.where("_point = 1").select("_node", *aggregates)], 0
    size = levels[0].count()
    while (size - 1) >> (FANOUT * width) > 0:
        width += 1
        levels.append(materialize(levels[-1].groupBy(F.shiftright("_node", FANOUT).alias("_node")).agg(*merged), "level"))
    totals = None
    run = lambda i, j: F.when(i < j, F.sequence(i, j - 1)).otherwise(F.array().cast("array<bigint>"))
    for k, level in enumerate(levels):
        # the nodes of this level inside [_a, _b), of which those that fill nodes of the next level are left to it
        a, up = (F.shiftright(F.col("_a") + ((1 << FANOUT * i) - 1), FANOUT * i) for i in (k, k + 1))
        b, down = (F.shiftright("_b", FANOUT * i) for i in (k, k + 1))
        own = F.when(up <= down, F.concat(run(a, F.shiftleft(up, FANOUT)), run(F.shiftleft(down, FANOUT), b))).otherwise(run(a, b))
        met = ranges.where(a < b).select("_low", "_high", F.explode(own).alias("_node")).join(level, "_node").groupBy("_low", "_high").agg(*merged)
        totals = met if totals is None else totals.unionByName(met)
    totals = totals.groupBy("_low", "_high").agg(*merged)
    return table.select("*", *ends).join(totals, ["_low", "_high"]).drop("_low", "_high")


def by_interval_and_key(rows: DataFrame, cache: DataFrame, value: Column, bands: list[tuple], key: str, band: str, result: str) -> DataFrame:
    """The cache's value for the row's own band and key only; 0 for a miss, null band outside all."""
    named = rows.withColumn(band, interval(value, bands))
    right = cache.select(F.col(band).alias("_band"), F.col(key).alias("_key"), F.col(result).alias("_value"))
    out = named.join(right, (named[band] == F.col("_band")) & (named[key] == F.col("_key")), "left")
    return out.select(named["*"], F.coalesce("_value", F.lit(0.0)).alias(result), F.col("_value").isNotNull().alias("matched"))


def precedence(rows: DataFrame, tables: list[DataFrame], key: str, value: str, allowed: list[Column] | None = None) -> DataFrame:
    """The first table that has the key (and is allowed for the row) gives the value; 0 and source null if none has."""
    out, picks = rows, []
    for k, table in enumerate(tables):
        right = table.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}"))
        out = out.join(right, out[key] == F.col(f"_k{k}"), "left")
        use = F.col(f"_k{k}").isNotNull() & (allowed[k] if allowed else F.lit(True))
        picks.append((use, k))
    chosen, source = F.lit(0.0), F.lit(None).cast("int")
    for use, k in reversed(picks):
        chosen, source = F.when(use, F.col(f"_v{k}")).otherwise(chosen), F.when(use, F.lit(k)).otherwise(source)
    return out.select(*[F.col(c) for c in rows.columns], chosen.alias(value), source.alias("source"))


def override_range(old: Column, new: Column, position: Column, low, high) -> Column:
    """Inside [low, high) the new value holds, a miss being 0; outside the old one."""
    return F.when((position >= low) & (position < high), F.coalesce(new, F.lit(0.0))).otherwise(old)


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two tables whose keys must not meet."""
    from skyweave.operators.gates import unique

    return unique(a.unionByName(b), key)


def null_safe_differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each shared key and column count how often the sides differ, NaN and null equal to themselves."""
    right = b.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = a.join(right, a[key] == F.col("_key"))
    return both.agg(F.count("*").alias("shared"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_differs") for c in columns])


def matrix(a: DataFrame, b: DataFrame, key: str, group: str, *aggregates: Column) -> DataFrame:
    """For each pair of groups of two tables that share keys: aggregates over the shared rows (columns a_*, b_*)."""
    left = a.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key])
    right = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    return left.join(right, key).groupBy(f"a_{group}", f"b_{group}").agg(F.count("*").alias("shared"), *aggregates)


def zip_rows(a: DataFrame, b: DataFrame, chunk: str = "chunk", position: str = "pos_in_chunk") -> DataFrame:
    """Row-aligned sides, joined by chunk and position in it."""
    return a.join(b, [chunk, position])
