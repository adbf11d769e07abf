"""Aggregates of catalogue audits: deduplication, robust spreads, agreement, histograms, coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.functions.sky import finite
from skyweave.operators import gates
from skyweave.storage import materialize

#: Fixed: MAD to standard deviation, and the 97.5 % point of the normal distribution.
MAD_SIGMA, Z95 = 1.4826, 1.959963984540054

#: Of exact_percentiles(): bins of a pass, rows that end the passes, groups at most.
BINS, SETTLED, GROUPS = 2048, 20_000, 1000


def keep_best(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the one with the largest order (a tuple); a partial aggregate, so hot keys don't gather."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def conflict_free(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows agree in all columns (NaN with NaN, null with null), once each."""
    agree = F.lit(True)
    for c in columns:
        agree = agree & F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}")) & F.col(f"_n_{c}").isin(0, 1)
    # a column may be all null or never null, not both kinds
    mixed = [(F.count(c) / F.count("*")).alias(f"_n_{c}") for c in columns]
    ends = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return df.groupBy(key).agg(*ends, *mixed).where(agree).select(key, *[F.col(f"_lo_{c}").alias(c) for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that repeat, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def robust_spread(df: DataFrame, group: str, *values: str) -> DataFrame:
    """n, median_<v> and spread_<v> (1.4826 times the median absolute deviation) by group; a group may hold any share of the rows.

    Rows meet their group's median by a join whose hot groups aren't moved.  Where all groups are small, two aggregates
    and a join do.  Nulls are left out of a value's ranks; other values that aren't finite abort.
    """
    odd = sum((F.count_if(F.col(v).isNotNull() & ~finite(F.col(v))) for v in values[1:]), F.count_if(F.col(values[0]).isNotNull() & ~finite(F.col(values[0]))))
    seen = df.groupBy(group).agg(F.count("*").alias("n"), odd.alias("odd")).agg(F.max("n").alias("most"), F.sum("odd").alias("odd")).first()
    gates.require(not seen["odd"], f"{values} have values that aren't finite")
    if (seen["most"] or 0) <= SMALL_GROUP:
        medians = df.groupBy(F.col(group).alias("_g")).agg(*[F.median(v).alias(f"median_{v}") for v in values])
        met = df.join(medians, df[group].eqNullSafe(medians["_g"]))
        return met.groupBy(group).agg(F.count("*").alias("n"), *[F.first(f"median_{v}").alias(f"median_{v}") for v in values], *[(MAD_SIGMA * F.median(F.abs(F.col(v) - F.col(f"median_{v}")))).alias(f"spread_{v}") for v in values])
    out = df.groupBy(group).agg(F.count("*").alias("n"))
    total = None
    for v in values:
        medians = materialize(grouped_percentiles(df, group, v, [0.5]).select(F.col(group).alias("_g"), F.col("n").alias("_n"), F.get("p", F.lit(0)).alias("_m")), "medians")
        total = total or medians.agg(F.sum("_n")).first()[0] or 0
        hot = F.col("_n") * 1000 >= F.lit(total)
        away = None
        for some in (F.broadcast(medians.where(hot)), medians.where(~hot)):
            met = df.join(some, df[group].eqNullSafe(some["_g"])).select(F.col(group), F.abs(F.col(v) - F.col("_m")).alias("_d"))
            away = met if away is None else away.unionByName(met)
        spread = grouped_percentiles(away, group, "_d", [0.5]).select(F.col(group).alias("_s"), (MAD_SIGMA * F.get("p", F.lit(0))).alias(f"spread_{v}"))
        out = out.join(medians.select("_g", F.col("_m").alias(f"median_{v}")), out[group].eqNullSafe(F.col("_g")), "left").drop("_g")
        out = out.join(spread, out[group].eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.select(group, "n", *[f"median_{v}" for v in values], *[f"spread_{v}" for v in values])


def exact_percentiles(df: DataFrame, value: str, points: list[float], group: str | None = None) -> dict:
    """Percentiles of finite values as percentile() gives them, by group (0 without one); groups without values have no entry.

    percentile() holds all distinct values in one task.  A table of at most SETTLED rows goes to it; of a larger one a
    pass counts the rows of 2,048 equal bins between the ends of what is still open, and the bin that holds a wanted rank
    is all that the next pass looks at.  A bin of SETTLED rows or fewer is counted value by value.  So a thousand times
    the rows is one or two passes more, and the driver gets at most 2,048 counts, or SETTLED values, for each of the
    2 * len(points) ranks.  df is read once a pass.  With a group this is grouped_percentiles(), whose result (GROUPS
    groups at most; more abort) is fetched.  Nulls are left out; other values that aren't finite abort.
    """
    if group:
        found = grouped_percentiles(df, group, value, points).limit(GROUPS + 1).collect()
        gates.require(len(found) <= GROUPS, f"more than {GROUPS} groups")
        return {r[group]: list(r["p"]) for r in found}
    rows = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    ends = rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(~finite(F.col("x"))).alias("odd")).first()
    gates.require(not ends["odd"], f"{value} has values that aren't finite")
    if not ends["n"]:
        return {}
    if ends["n"] <= SETTLED:
        return {0: list(rows.agg(percentiles("x", points).alias("p")).first()["p"])}
    places = {p: p * (ends["n"] - 1) for p in points}
    # by rank: first and last value of the bin that holds it, rows before, rows in it
    at = {k: (ends["lo"], ends["hi"], 0, ends["n"]) for x in places.values() for k in (math.floor(x), math.ceil(x))}
    wide = lambda b: b[3] > SETTLED and b[1] / 2 - b[0] / 2 > 0

    def narrow(keys: list[int], by: Column) -> None:
        """Count the rows of the bins that hold these ranks by a finer column, and take the finer bins that hold them."""
        open_ = sorted({at[k][:2] for k in keys})
        table = rows.sparkSession.createDataFrame([(k, *b) for k, b in enumerate(open_)], "b int, first double, last double")
        inside = rows.join(F.broadcast(table), rows["x"].between(table["first"], table["last"]))
        found: dict[tuple, list] = {b: [] for b in open_}
        for r in inside.groupBy("b", by.alias("f")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b", "f").collect():
            found[open_[r["b"]]].append(r)
        for k in keys:
            lo, hi, before, _ = at[k]
            for r in found[lo, hi]:
                if k < before + r["n"]:
                    at[k] = (r["lo"], r["hi"], before, r["n"])
                    break
                before += r["n"]

    part = (F.col("x") / 2 - F.col("first") / 2) / (F.col("last") / 2 - F.col("first") / 2)
    while keys := [k for k, b in at.items() if wide(b)]:
        narrow(keys, F.least(F.floor(part * BINS), F.lit(BINS - 1)))
    if keys := [k for k, b in at.items() if b[0] < b[1]]:
        narrow(keys, F.col("x"))
    between = lambda x, low, high: low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
    return {0: [between(x, at[math.floor(x)][0], at[math.ceil(x)][0]) for x in places.values()]}


def percentiles(value: str, points: list[float]) -> Column:
    """Exact, by group; one task holds the distinct values of a group, so for groups of bounded size."""
    return F.percentile(value, F.array(*[F.lit(p) for p in points]))


def agreement(df: DataFrame, got: str, ref: str, least: float = 0.5) -> DataFrame:
    """count, pearson, bias, median/p90/p99 of the absolute difference, share of equal signs where abs(ref) >= least, and p1, p50, p99 of both sides."""
    held = materialize(df.select(F.col(got).cast("double").alias("got"), F.col(ref).cast("double").alias("ref"), F.abs(F.col(got) - F.col(ref)).alias("d")), "agreement")
    far = F.abs("ref") >= least
    same = (F.signum("got") == F.signum("ref")).cast("double")
    out = [F.count("*").alias("count"), F.corr("got", "ref").alias("pearson"), F.avg(F.col("got") - F.col("ref")).alias("bias")]
    for c, names in (("d", {"median_diff": 0.5, "p90_diff": 0.9, "p99_diff": 0.99}), *((c, {f"{c}_p1": 0.01, f"{c}_p50": 0.5, f"{c}_p99": 0.99}) for c in ("ref", "got"))):
        found = exact_percentiles(held, c, list(names.values())).get(0, [None] * len(names))
        out += [F.lit(x).cast("double").alias(n) for n, x in zip(names, found)]
    return held.agg(*out, F.avg(F.when(far, same)).alias("sign_agreement"), F.count_if(far).alias("sign_compared"))


def histogram(df: DataFrame, value: str, bins: int = 40, signed: bool = False) -> DataFrame:
    """bin, low, high, n: equal bins up to the 99th percentile of the nonzero finite values, the last one closed; empty bins are rows too.

    Values outside are in bin -1, zeros in bin -2.
    """
    x = F.col(value).cast("double")
    good = materialize(df.where(finite(x)).select(x.alias("x")), "values")  # read by several passes
    p99 = exact_percentiles(good.where("x <> 0").select((F.abs("x") if signed else F.col("x")).alias("x")), "x", [0.99]).get(0, [None])[0]
    top = max(1.0 if p99 is None else p99, 1e-6)
    low = -top if signed else 0.0
    width = (top - low) / bins
    inside = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
    placed = good.select(F.when(F.col("x") == 0, -2).when((F.col("x") < low) | (F.col("x") > top), -1).otherwise(inside).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(-2, bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.when(F.col("bin") >= 0, F.lit(low) + F.lit(width) * k)
    return spine.join(F.broadcast(counts), "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def wilson(successes: Column, n: Column, population: Column) -> list[Column]:
    """estimate, low, high of a population count from a sample fraction (95 %, rounded)."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    z2 = F.lit(Z95 * Z95)
    den = 1 + z2 / n
    center = (p + z2 / (2 * n)) / den
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / den
    count = lambda x: F.when(n > 0, F.rint(x * population)).otherwise(0.0)
    return [count(p), count(F.greatest(F.lit(0.0), center - half)), count(F.least(F.lit(1.0), center + half))]


def intersections(df: DataFrame, key: str, group: str) -> DataFrame:
    """a, b, shared: how many keys each pair of groups has in common (a < b)."""
    one = df.select(key, group).distinct()
    a, b = one.select(key, F.col(group).alias("a")), one.select(key, F.col(group).alias("b"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def consistency(df: DataFrame, keys: list[str], order: list[str], position: list[str], value: str) -> DataFrame:
    """Of keys that repeat: copies, largest distance from the first row (by order), span of the value."""
    first = df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(F.struct(*order, *[F.col(p).alias(f"_{k}") for k, p in enumerate(position)])).alias("f"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("copies > 1")
    d = sum(((F.col(p) - F.col(f"f._{k}")) ** 2 for k, p in enumerate(position)), F.lit(0.0))
    return df.join(first, keys).groupBy(*keys).agg(F.first("copies").alias("copies"), F.sqrt(F.max(d)).alias("separation"), F.first(F.col("hi") - F.col("lo")).alias("span"))


def share(hit: Column) -> list[Column]:
    """hits, n, fraction (null for no rows)."""
    return [F.count_if(hit).alias("hits"), F.count("*").alias("n"), F.try_divide(F.count_if(hit).cast("double"), F.count("*").cast("double")).alias("fraction")]


def label_counts(df: DataFrame, flags: str, bits: int) -> DataFrame:
    """bit, n: rows with each bit set."""
    one = df.agg(*[F.sum((F.shiftright(flags, b).bitwiseAND(1)).cast("long")).alias(f"b{b}") for b in range(bits)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.coalesce(f"b{b}", F.lit(0)).alias("n")) for b in range(bits)])).alias("r")).select("r.*")


def preflight(df: DataFrame, position: list[str], cell: float, pad: float = 1.2, bytes_per_cell: int = 48) -> DataFrame:
    """Box, mesh, and least and recommended memory (three times the least) of a field over these positions."""
    ends = df.agg(*[F.min(p).alias(f"lo{k}") for k, p in enumerate(position)], *[F.max(p).alias(f"hi{k}") for k, p in enumerate(position)])
    box = [(F.col(f"hi{k}") - F.col(f"lo{k}")) * pad for k in range(len(position))]
    mesh = [F.greatest(F.lit(1), F.ceil(b / cell)).cast("long") for b in box]
    cells = mesh[0]
    for m in mesh[1:]:
        cells = cells * m
    least = cells * bytes_per_cell / F.lit(float(1 << 30))
    return ends.select(*[b.alias(f"box{k}") for k, b in enumerate(box)], *[m.alias(f"mesh{k}") for k, m in enumerate(mesh)], cells.alias("cells"), least.alias("least_gib"), (3 * least).alias("recommended_gib"))


#: Rows of a group whose values one buffer holds, and bins of a pass over larger groups.
SMALL_GROUP, GROUP_BINS = 20_000, 512


def grouped_percentiles(df: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """group, n, p (array of the percentiles, as percentile() gives them) of finite values, for any number of groups of any size.

    Groups of at most SMALL_GROUP rows go to percentile(), whose buffer they bound.  Of larger ones the wanted ranks are
    narrowed down by passes: joined with what is known of its group, a row counts for one of GROUP_BINS equal bins of
    each interval that still holds a rank, and the bin that holds it is the next interval; counts are partial
    aggregates, so a group of a third of all rows is no buffer, no task and no driver's matter.  Rows of a hot group
    meet a broadcast table (hot: a thousandth of all rows, so a thousand groups at most).  A pass is left out when no
    group needs it.  Nulls are left out; other values that aren't finite abort.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    ends = materialize(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(~finite(F.col("x"))).alias("odd")), "ends")
    seen = ends.agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.sum("odd").alias("odd")).first()
    gates.require(not seen["odd"], f"{value} has values that aren't finite")
    wanted = F.array(*[F.lit(float(p)) for p in points])
    plain = lambda some: some.groupBy("g").agg(F.count("*").alias("n"), F.percentile("x", wanted).alias("p"))
    if (seen["most"] or 0) <= SMALL_GROUP:
        return plain(rows).withColumnRenamed("g", group)
    rows = materialize(rows, "values")
    large = ends.where(F.col("n") > SMALL_GROUP)

    def met(table: DataFrame) -> DataFrame:
        """rows with the columns of a table of large groups (g, size, ...); groups too large to move meet a broadcast."""
        hot = F.col("size") * 1000 >= F.lit(seen["rows"])
        same = lambda t: rows["g"].eqNullSafe(t["tg"])
        named = table.withColumnRenamed("g", "tg")
        few, rest = F.broadcast(named.where(hot)), named.where(~hot)
        return rows.join(few, same(few)).drop("tg").unionByName(rows.join(rest, same(rest)).drop("tg"))

    # each wanted rank of each group: the interval that holds it, rows before and in it
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (f(F.lit(float(p)) * (F.col("n") - 1))).cast("long").alias("k")) for i, p in enumerate(points) for j, f in enumerate((F.floor, F.ceil))]))
    at = materialize(large.select("g", F.col("n").alias("size"), "lo", "hi", F.lit(0).cast("long").alias("before"), "n", places.alias("w")).select("g", "size", "lo", "hi", "before", "n", "w.*"), "ranks")
    done = None
    last = Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        closed = F.col("lo") == F.col("hi")
        settled = at.where(closed).select("g", "i", "j", F.col("lo").alias("x"))
        done = settled if done is None else done.unionByName(settled)
        at = at.where(~closed)
        if at.isEmpty():
            break
        # an interval of few rows is told apart value by value
        open_ = at.select("g", "size", "lo", "hi", "n").distinct()
        part = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        fine = F.col("n") <= GROUP_BINS
        bin_ = F.when(fine, F.col("x")).otherwise(F.least(F.floor(part * GROUP_BINS), F.lit(GROUP_BINS - 1)).cast("double"))
        inside = met(open_).where(F.col("x").between(F.col("lo"), F.col("hi"))).withColumn("bin", bin_)
        counts = inside.groupBy("g", "lo", "hi", "bin").agg(F.count("*").alias("m"), F.min("x").alias("first"), F.max("x").alias("final"))
        counts = counts.withColumn("skip", F.coalesce(F.sum("m").over(last), F.lit(0))).select(F.col("g").alias("cg"), F.col("lo").alias("clo"), F.col("hi").alias("chi"), "m", "first", "final", "skip")
        here = at["g"].eqNullSafe(counts["cg"]) & (at["lo"] == counts["clo"]) & (at["hi"] == counts["chi"]) & (at["k"] >= at["before"] + counts["skip"]) & (at["k"] < at["before"] + counts["skip"] + counts["m"])
        at = materialize(at.join(counts, here).select("g", "size", F.col("first").alias("lo"), F.col("final").alias("hi"), (F.col("before") + F.col("skip")).alias("before"), F.col("m").alias("n"), "i", "j", "k"), "ranks")
    both = done.groupBy("g", "i").agg(F.max(F.when(F.col("j") == 0, F.col("x"))).alias("low"), F.max(F.when(F.col("j") == 1, F.col("x"))).alias("high")).join(large.select(F.col("g").alias("lg"), "n"), F.col("g").eqNullSafe(F.col("lg")))
    place = F.element_at(wanted, F.col("i") + 1) * (F.col("n") - 1)
    value_ = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(place) - place) * F.col("low") + (place - F.floor(place)) * F.col("high"))
    found = both.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", value_.alias("v")))), lambda s: s["v"]).alias("p"))
    small = rows.join(large.select(F.col("g").alias("lg")), rows["g"].eqNullSafe(F.col("lg")), "left_anti")
    return plain(small).unionByName(found).withColumnRenamed("g", group)
