"""Audits and workflows over fields: extension of a cache to rows it misses, coherence, coverage, sampled estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions.sky import norm
from skyweave.operators import aggregates, gates, joins, layout, spatial
from skyweave.plans import field as fields
from skyweave.storage import materialize

#: Fixed: floors that an extension may not relax.
FLOORS = {"mask_percentile": 99.0, "min_correlation": 0.995, "min_sign_agreement": 0.99, "max_median_abs_difference": -0.1}


def unique_region(candidates: DataFrame, randoms: dict[str, DataFrame], key: str, position: list[str], percentile: float = 0.99) -> DataFrame:
    """candidates with region: the only region that supports them; null if none or several do (ambiguous: several)."""
    out = candidates
    for name, rows in randoms.items():
        flags = spatial.supported(candidates, rows, key, position, percentile).select(key, F.col("supported").alias(f"_in_{name}"))
        out = out.join(flags, key)
    hits = [F.col(f"_in_{n}").cast("int") for n in randoms]
    total = sum(hits[1:], hits[0])
    region = F.lit(None).cast("string")
    for n in randoms:
        region = F.when(F.col(f"_in_{n}"), F.lit(n)).otherwise(region)
    return out.select(*candidates.columns, F.when(total == 1, region).alias("region"), (total > 1).alias("ambiguous"))


def extend(rows: DataFrame, cache: DataFrame, randoms: dict[str, DataFrame], mesh: DataFrame, geometry: dict, key: str, position: list[str], **thresholds) -> tuple[DataFrame, dict]:
    """Displacements of rows that the cache misses, where exactly one region supports them, and the agreement on cached rows.

    The field is evaluated at a row's own position; it must first reproduce the cache (correlation, sign, median).
    """
    given = {"mask_percentile": 99.0, "min_correlation": 0.995, "min_sign_agreement": 0.99, "max_median_abs_difference": 0.1} | thresholds
    gates.not_relaxed(given, FLOORS)
    known = joins.members(rows, cache, key)
    back = None
    for name in geometry:
        own = known.join(cache.where(F.col("region") == name).select(key, F.col("delta_mpc").alias("ref")), key).withColumn("region", F.lit(name))
        back = own if back is None else back.unionByName(own)
    again = fields.shifts_at(back, mesh, geometry, key, position, "region").select(key, "delta_mpc").join(back.select(key, "ref"), key)
    report = aggregates.agreement(again, "delta_mpc", "ref").first().asDict()
    gates.require(report["count"] > 1 and report["pearson"] >= given["min_correlation"] and (report["sign_agreement"] is None or report["sign_agreement"] >= given["min_sign_agreement"]) and report["median_diff"] <= given["max_median_abs_difference"], f"the field doesn't reproduce the cache: {report}")
    missing = unique_region(joins.others(rows, cache, key), randoms, key, position, given["mask_percentile"] / 100).where(F.col("region").isNotNull())
    moved = fields.shifts_at(missing, mesh, geometry, key, position, "region").select(key, F.col("field").alias("region"), "delta_mpc")
    gates.unique_and_finite(moved, key, "delta_mpc")
    return moved, report


def cross_fit(data: DataFrame, randoms: DataFrame, key: str, position: list[str], share: float = 0.2, seed: str = "42", **field_options) -> DataFrame:
    """Agreement of displacements of held-out rows between a field with them and one without."""
    h = F.conv(F.substring(layout.hash_rank(key, seed=seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    rows = data.withColumn("_held", h < share)
    held = rows.where("_held").drop("_held")
    whole = fields.shifts_at(held, *fields.reconstruct(data, randoms, position, **field_options), key, position)
    part = fields.shifts_at(held, *fields.reconstruct(rows.where("NOT _held").drop("_held"), randoms, position, **field_options), key, position)
    both = whole.select(key, F.col("delta_mpc").alias("ref")).join(part.select(key, F.col("delta_mpc").alias("got")), key)
    return aggregates.agreement(both, "got", "ref")


def coherence(rows: DataFrame, key: str, position: list[str], value: str, radii: list[float], seed: str = "42") -> DataFrame:
    """radius, pairs, pearson, median_diff, shuffled_median_diff, smoothness of values of pairs within each radius, against a shuffled control.

    Pairs are made and written once, as the smallest radius that holds them and three numbers; medians are ranks found
    by passes over them, so no buffer holds the pairs of a radius.
    """
    control = layout.shuffled(rows, key, value, seed)
    values = materialize(rows.select(key, F.col(value).alias("v")).join(control.select(key, F.col(f"shuffled_{value}").alias("s")), key), "values")
    pairs = spatial.pairs_within(rows, key, position, max(radii))
    a, b = values.select(F.col(key).alias("a"), F.col("v").alias("va"), F.col("s").alias("sa")), values.select(F.col(key).alias("b"), F.col("v").alias("vb"), F.col("s").alias("sb"))
    ranked = sorted(map(float, radii))
    least = F.lit(len(ranked) - 1)
    for k in reversed(range(len(ranked) - 1)):
        least = F.when(F.col("distance") <= ranked[k], F.lit(k)).otherwise(least)
    met = pairs.join(a, "a").join(b, "b").select(least.alias("k"), F.col("va").cast("double").alias("va"), F.col("vb").cast("double").alias("vb"), F.abs(F.col("va") - F.col("vb")).cast("double").alias("d"), F.abs(F.col("sa") - F.col("sb")).cast("double").alias("c"))
    held = materialize(met, "pairs").withColumn("radius", F.explode(F.slice(F.array(*map(F.lit, ranked)), F.col("k") + 1, F.lit(len(ranked)))))
    out = held.groupBy("radius").agg(F.count("*").alias("pairs"), F.corr("va", "vb").alias("pearson"))
    for name, column in (("median_diff", "d"), ("shuffled_median_diff", "c")):
        found = aggregates.exact_percentiles(held, column, [0.5], "radius")
        known = rows.sparkSession.createDataFrame([(g, x[0]) for g, x in found.items()], f"radius double, {name} double")
        out = out.join(F.broadcast(known), "radius", "left")
    return out.withColumn("smoothness", F.col("median_diff") / F.greatest("shuffled_median_diff", F.lit(1e-12)))


def two_realisations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Of flags (key, flagged) from two random realisations: rows, both, either, and share of agreement."""
    both = a.select(key, F.col("flagged").alias("fa")).join(b.select(key, F.col("flagged").alias("fb")), key)
    return both.agg(F.count("*").alias("rows"), F.count_if("fa").alias("first"), F.count_if("fb").alias("second"), F.count_if(F.col("fa") & F.col("fb")).alias("both"), F.count_if(F.col("fa") | F.col("fb")).alias("either"), F.try_divide(F.count_if(F.col("fa") == F.col("fb")).cast("double"), F.count("*").cast("double")).alias("agreement"))


def by_bins(rows: DataFrame, position: str, old: str, new: str, bins: list[tuple]) -> DataFrame:
    """For each bin (name, low, high) of position: rows, both nonzero, correlation, median and p99 of abs(new - old)."""
    placed = materialize(rows.select(joins.interval(F.col(position), bins).alias("bin"), F.col(old).cast("double").alias("old"), F.col(new).cast("double").alias("new")).where("bin IS NOT NULL"), "bins")
    ranks = aggregates.grouped_percentiles(placed.withColumn("d", F.abs(F.col("new") - F.col("old"))), "bin", "d", [0.5, 0.99]).select("bin", F.get("p", F.lit(0)).alias("median_diff"), F.get("p", F.lit(1)).alias("p99_diff"))
    return placed.groupBy("bin").agg(F.count("*").alias("rows"), F.count_if((F.col("new") != 0) & (F.col("old") != 0)).alias("both"), F.corr("new", "old").alias("pearson")).join(ranks, "bin", "left")


def shells(rows: DataFrame, before: list[str], after: dict[str, list[str]], width: float = 5.0, start: float = 0.0) -> DataFrame:
    """Counts by shell of radius, one column for the positions before and one for each set of positions after."""
    series = {"before": before} | after
    radius = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), norm(*[F.col(c).cast("double") for c in p]).alias("radius")) for n, p in series.items()]))
    placed = rows.select(radius.alias("r")).select("r.series", F.floor((F.col("r.radius") - start) / width).cast("long").alias("shell"))
    return placed.groupBy("shell").agg(*[F.count_if(F.col("series") == n).alias(n) for n in series])
