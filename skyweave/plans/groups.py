"""Compression of elongated groups along the line of sight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates


def match(catalogue: DataFrame, galaxies: DataFrame) -> DataFrame:
    """Galaxies whose packed identity is in the catalogue, with the number of catalogue rows (source_hits)."""
    known = catalogue.groupBy("targetid").agg(F.count("*").alias("source_hits"))
    return galaxies.withColumn("targetid", sky.pack_target(F.col("objid"), F.col("brickid"), F.col("release"))).join(known, "targetid")


def resolve(matches: DataFrame, relation: DataFrame, groups: DataFrame, min_rich: int = 5) -> tuple[DataFrame, DataFrame]:
    """Groups of matched galaxies with at least min_rich members, and all their members (igal, igrp). Every related group must exist."""
    wanted = relation.join(matches.select("igal").distinct(), "igal", "left_semi").select("igrp").distinct()
    lost = wanted.join(groups.select("igrp"), "igrp", "left_anti").take(1)
    gates.require(not lost, f"group is missing: {lost}")
    rich = groups.join(wanted, "igrp", "left_semi").where(F.col("rich") >= min_rich)
    return rich, relation.join(rich.select("igrp"), "igrp", "left_semi").select("igal", "igrp")


def compress(members: DataFrame, min_spec: int = 5, elongation: float = 1.5, floor: float = 0.08, cap: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """Group statistics and member displacements.

    members: igrp, igal, spec (has a spectroscopic redshift), offset (distance of the member beyond its group's
    distance), across (transverse distance). Spreads come from spec members only, displacements go to all members of
    an eligible group, others get 0.
    """
    spec = members.where("spec").select("igrp", "offset", "across")
    spread = aggregates.robust_spread(spec, "igrp", "offset", "across")
    parallel, transverse = F.col("spread_offset"), F.col("spread_across")
    good = (F.col("n") >= min_spec) & sky.finite(parallel) & sky.finite(transverse) & (parallel > 0) & (transverse > 0)
    stats = spread.where(good).select("igrp", F.col("n").alias("spec"), parallel.alias("sigma_parallel"), transverse.alias("sigma_perp"), F.try_divide(parallel, transverse).alias("elongation"), sky.compression(parallel, transverse, floor).alias("alpha")).where(F.col("elongation") >= elongation)
    moved = members.join(stats.select("igrp", "alpha"), "igrp", "left").withColumn("delta_mpc", F.coalesce(sky.compressed_delta(F.col("offset"), F.col("alpha"), cap), F.lit(0.0)).cast("float"))
    return stats, moved


def plan(catalogue: DataFrame, galaxies: DataFrame, relation: DataFrame, groups: DataFrame, z_max: float, min_rich: int = 5, **options) -> tuple[DataFrame, DataFrame]:
    """The whole flow: (targetid, delta_mpc) of matched objects, and group statistics."""
    matches = match(catalogue, galaxies)
    rich, members = resolve(matches, relation, groups, min_rich)
    full = members.join(galaxies, "igal").join(rich.select("igrp", "rich", "grp_ra", "grp_dec", "grp_z"), "igrp")
    far, center = sky.comoving_distance(F.col("z"), z_max), sky.comoving_distance(F.col("grp_z"), z_max)
    angle = sky.angular_separation(F.col("ra"), F.col("dec"), F.col("grp_ra"), F.col("grp_dec"))
    measured = full.select("igrp", "igal", (F.col("zsrc") > 0).alias("spec"), (far - center).alias("offset"), (center * angle).alias("across"))
    stats, moved = compress(measured, **options)
    return matches.join(moved.select("igal", "delta_mpc"), "igal").select("targetid", "delta_mpc"), stats
