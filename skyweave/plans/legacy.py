"""The historical catalogue of a tracer as one flow: clustering parts, imaging attributes by identity, one binary file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates, joins, layout
from skyweave.plans.catalogue import scale
from skyweave.sources import binary
from skyweave.storage import materialize

#: Fixed: names of a tracer's clustering parts and of its imaging table.
TRACERS = {
    "BGS_BRIGHT": (["BGS_BRIGHT_NGC", "BGS_BRIGHT_SGC"], "BGS_BRIGHT_full_HPmapcut.dat.fits"),
    "LRG": (["LRG_NGC", "LRG_SGC"], "LRG_full_HPmapcut.dat.fits"),
    "ELG": (["ELG_LOPnotqso_NGC", "ELG_LOPnotqso_SGC"], "ELG_LOPnotqso_full_HPmapcut.dat.fits"),
    "QSO": (["QSO_NGC", "QSO_SGC"], "QSO_full_HPmapcut.dat.fits"),
}
#: Nodes of the distance table, and what an object without imaging has.
NODES, NO_WARNING = 4096, 0xFFFFFFFF


def together(parts: list[DataFrame]) -> DataFrame:
    """The valid rows of the parts (row_index, targetid, ra, dec, z), numbered from 0 in the order of part and row."""
    gates.require(bool(parts), "no parts")
    rows = None
    for k, part in enumerate(parts):
        own = part.select("targetid", *[F.col(c).cast("double").alias(c) for c in ("ra", "dec", "z")], (F.lit(k).cast("long") * (1 << 45) + F.col("row_index")).alias("_at"))
        rows = own if rows is None else rows.unionByName(own)
    good = sky.finite(F.col("z")) & (F.col("z") > 0) & (F.col("z") < 6) & sky.finite(F.col("ra")) & sky.finite(F.col("dec"))
    return layout.ordinal(rows.where(good), "_at", "row_index").drop("_at")


def colour(c: Column, scale_: float) -> Column:
    """Colour code of a single-precision colour, in single precision at every step."""
    code = F.rint(sky.f32(sky.f32(c + sky.f32(F.lit(0.5))) * sky.f32(F.lit(scale_))))
    return F.when(sky.finite(c), sky.clip(code, 0, 255)).otherwise(sky.NO_COLOUR).cast("int")


def imaging(rows: DataFrame, full: DataFrame) -> DataFrame:
    """rows with morph, shape, gr, rz, zwarn of their exact identity in an imaging table, its first row where it has several."""
    mag = {c: sky.f32(sky.magnitude(F.col(f"flux_{c}").cast("double"))) for c in "grz"}
    one = aggregates.keep_best(full.select("row_index", "targetid", "type", "shape_r", "flux_g", "flux_r", "flux_z", "zwarn"), "targetid", -F.col("row_index"))
    known = one.select("targetid", sky.morphology_code(F.col("type")).alias("morph"), sky.quantise_radius(F.col("shape_r")).alias("shape"), colour(mag["g"] - mag["r"], 85).alias("gr"), colour(mag["r"] - mag["z"], 102).alias("rz"), F.col("zwarn").cast("long").alias("zwarn"))
    return joins.with_defaults(rows, known, "targetid", {"morph": sky.UNKNOWN, "shape": 0, "gr": sky.NO_COLOUR, "rz": sky.NO_COLOUR, "zwarn": NO_WARNING})


def build(parts: list[DataFrame], full: DataFrame | None, path: str, magic: str = "SKYC", **cosmology) -> dict:
    """Write a tracer's catalogue: version 3 with an imaging table, else version 1. Gives its header and how many objects have imaging."""
    rows = materialize(together(parts), "legacy")
    ends = rows.agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    gates.require(ends["n"] > 0, "no valid objects")
    # nodes lie from 0 to a little beyond the largest redshift, which comoving_distance() takes as 1.001 times its own end
    far = sky.comoving_distance(F.col("z"), (ends["hi"] * 1.01 + 1e-3) / 1.001, NODES, **cosmology)
    placed = rows.withColumns(dict(zip(("x", "y", "z3"), sky.sky_to_cartesian(F.col("ra"), F.col("dec"), far))))
    units = scale(placed, ["x", "y", "z3"])
    box = placed.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z3") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    coded = placed.withColumns({f"q{a}": sky.quantise_position(F.col(c), units) for a, c in (("x", "x"), ("y", "y"), ("z", "z3"))} | {"zq": sky.quantise_redshift(F.col("z"), ends["lo"], ends["hi"])})
    columns = ["row_index", "qx", "qy", "qz", "zq"]
    if full is not None:
        coded = imaging(coded, full)
        columns += ["morph", "shape", "gr", "rz", "ra", "dec", "zwarn", "targetid"]
    bounds = [box[f"{n}_{c}"] for n in ("lo", "hi") for c in ("x", "y", "z3")]
    version = 1 if full is None else 3
    binary.place_rows(coded.select(*columns), "sky_catalogue", path, version=version, magic=magic, count=ends["n"], unitsPerMpc=units, zMin=ends["lo"], zMax=ends["hi"], bounds=",".join(map(str, bounds)))
    found = None if full is None else rows.join(full.select("targetid"), "targetid", "left_semi").count()
    return binary.read_header(path) | {"matched": found}
