"""Building a catalogue: selection, positions, quantisation, flags, chunk order; checks that a rebuild is the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates, layout
from skyweave.sources import binary


#: Fixed: columns of the dark and of the bright target masks.
DARK = ["desi_target", "sv1_desi_target", "sv2_desi_target", "sv3_desi_target"]
BRIGHT = ["bgs_target", "sv1_bgs_target", "sv2_bgs_target", "sv3_bgs_target"]


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    gates.require(not missing, f"columns are missing: {missing}")
    return df


def select_primary(zcat: DataFrame, kind: str | None = None, min_z: float = 0.0045) -> DataFrame:
    """Primary science rows: target fibres without warnings, of a kind (GALAXY, QSO or both), with sane z, position and identity."""
    c = F.col
    ok = c("zcat_primary") & (F.trim("objtype") == "TGT") & (c("zwarn") == 0) & sky.finite(c("z")) & (c("z") >= min_z)
    ok = ok & (c("target_ra") >= 0) & (c("target_ra") < 360) & c("target_dec").between(-90, 90) & (c("targetid") > 0)
    kinds = [kind] if kind else ["GALAXY", "QSO"]
    return zcat.where(ok & F.trim("spectype").isin(kinds)).withColumn("class", F.trim("spectype"))


def valid_clustering(rows: DataFrame, z_min: float, z_max: float) -> DataFrame:
    """Rows with finite position, redshift in [z_min, z_max) and finite positive weight; weight_fkp multiplies where it exists."""
    weight = F.col("weight") * F.col("weight_fkp") if "weight_fkp" in rows.columns else F.col("weight")
    c = F.col
    ok = sky.finite(c("ra")) & sky.finite(c("dec")) & sky.finite(c("z")) & sky.finite(weight) & (weight > 0) & (c("z") >= z_min) & (c("z") < z_max)
    return rows.where(ok).withColumn("weight", weight)


def deduplicate_targets(rows: DataFrame) -> DataFrame:
    """One row per targetid: the largest weight, then the earliest source row."""
    return aggregates.keep_best(rows, "targetid", F.col("weight"), -F.col("row_index"))


def class_ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("rows"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def scale(rows: DataFrame, position: list[str], margin: float = 1.0) -> float:
    """Units per Mpc that bring the largest coordinate to 32767."""
    most = rows.agg(F.greatest(*[F.max(F.abs(p)) for p in position]).alias("m")).first()["m"]
    gates.require(bool(most), "no extent")
    return 32767 / (most * margin)


def build(zcat: DataFrame, kind: str, min_z: float = 0.0045, nodes: int = 16384) -> tuple[DataFrame, dict]:
    """Quantised rows of one class (row_index in source order) and its header."""
    rows = select_primary(zcat, kind, min_z)
    ends = rows.agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    gates.require(ends["n"] > 0, f"no {kind} rows")
    far = sky.comoving_distance(F.col("z"), ends["hi"], nodes)
    x, y, z = sky.sky_to_cartesian(F.col("target_ra"), F.col("target_dec"), far)
    placed = rows.select("class", "row_index", "targetid", x.alias("x"), y.alias("y"), z.alias("z3"), "z", "target_ra", "target_dec", "zwarn")
    units = scale(placed, ["x", "y", "z3"])
    q = placed.select("class", "row_index", "targetid", *[sky.quantise_position(F.col(c), units).alias(n) for c, n in (("x", "qx"), ("y", "qy"), ("z3", "qz"))], sky.quantise_redshift(F.col("z"), ends["lo"], ends["hi"]).alias("zq"), F.col("target_ra").cast("float").alias("ra"), F.col("target_dec").cast("float").alias("dec"), "zwarn")
    box = placed.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z3") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    header = {"count": ends["n"], "unitsPerMpc": units, "zMin": ends["lo"], "zMax": ends["hi"], "bounds": [box[f"{n}_{c}"] for n in ("lo", "hi") for c in ("x", "y", "z3")]}
    return q, header


def viewer(rows: DataFrame, heads: dict[str, dict], units: float) -> DataFrame:
    """rows (class, qx, qy, qz, zq) of several classes with qx, qy, qz in common units, x, y, z3 in Mpc, and z, in single precision.

    heads has unitsPerMpc, zMin and zMax of each class; rows of other classes abort.
    """
    gates.require(not rows.where(F.col("class").isNull() | ~F.col("class").isin(*heads)).take(1), f"classes other than {sorted(heads)}")

    def own(key: str) -> Column:
        first, *rest = heads
        out = F.lit(heads[first][key])
        for name in rest:
            out = F.when(F.col("class") == name, F.lit(heads[name][key])).otherwise(out)
        return out

    low = sky.f32(own("zMin"))
    step = sky.f32((own("zMax") - own("zMin")) / 65535)
    codes = {c: sky.requantise(F.col(c), own("unitsPerMpc"), units) for c in ("qx", "qy", "qz")}
    placed = rows.withColumns(codes)
    return placed.withColumns({n: sky.f32(sky.f32(F.col(c)) / sky.f32(F.lit(units))) for c, n in (("qx", "x"), ("qy", "y"), ("qz", "z3"))} | {"z": sky.f32(low + sky.f32(sky.f32(F.col("zq")) * step))})


def decoded(chunks: DataFrame, scales: tuple[float, float]) -> DataFrame:
    """Rows of decode_consolidated() with x, y, z3 in Mpc: scales[1] units each for quasars, scales[0] for the rest."""
    units = F.when(sky.is_quasar(F.col("type")), F.lit(float(scales[1]))).otherwise(F.lit(float(scales[0])))
    return chunks.withColumns({n: F.col(c) / units for c, n in (("qx", "x"), ("qy", "y"), ("qz", "z3"))})


def identified(chunks: DataFrame, galaxies: DataFrame, quasars: DataFrame) -> DataFrame:
    """Rows of decode_consolidated() with the targetid at their row_index in the array of their class; an index out of range aborts."""
    both = galaxies.select(F.lit(False).alias("_q"), "row_index", "targetid").unionByName(quasars.select(F.lit(True).alias("_q"), "row_index", "targetid"))
    rows = chunks.withColumn("_q", sky.is_quasar(F.col("type")))
    return gates.found(rows, both, ["_q", "row_index"]).drop("_q")


def write_flags(rows: DataFrame, catalogue: DataFrame, path: str) -> DataFrame:
    """One byte of flags a row of a catalogue (row_index, targetid), in its order, as a file; rows in another order abort. Gives label counts."""
    gates.untouched(catalogue, rows, "row_index", ["targetid"])
    binary.place_rows(rows.select("row_index", "flags"), "row_vector", path, values="flags", type="u1", count=catalogue.count())
    back = rows.sparkSession.read.format("row_vector").options(values="flags", type="u1").load(path)
    return aggregates.label_counts(back, "flags", 6)


def target_flags(rows: DataFrame, dark: list[str] | None = None, bright: list[str] | None = None) -> DataFrame:
    """rows with the six label bits of their masks, by default of all columns of DARK and BRIGHT; a missing one aborts."""
    dark, bright = dark or DARK, bright or BRIGHT
    require_columns(rows, *dark, *bright)
    return rows.withColumn("flags", sky.target_flags(sky.bit_or(*map(F.col, dark)), sky.bit_or(*map(F.col, bright))))


def chunks(classes: list[tuple[DataFrame, float, bool]], units: float, n: int = 12) -> DataFrame:
    """(rows, own units, is quasar) of each class as one table in chunk order, with its type byte."""
    parts = None
    for rows, own, quasar in classes:
        same = rows.select("class", "row_index", "targetid", *[sky.requantise(F.col(c), own, units).alias(c) for c in ("qx", "qy", "qz")], "zq", sky.type_byte(F.col("flags"), F.lit(quasar)).alias("type"))
        parts = same if parts is None else parts.unionByName(same)
    offset = parts.withColumn("source", F.struct(F.col("class"), F.col("row_index")))
    return layout.ordered_chunks(offset, row="source", n=n).drop("source")


def same_redshift_codes(a: DataFrame, b: DataFrame, key: str = "targetid") -> None:
    """Codes of two builds differ by one at most."""
    worst = a.select(key, F.col("zq").alias("a")).join(b.select(key, F.col("zq").alias("b")), key).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("m")).first()["m"]
    gates.require(worst is None or worst <= 1, f"redshift codes differ by {worst}")


def photometry(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """Fill unknown morphology from measurements: exact identity, recognised type, and only identities whose measurements agree."""
    known = measured.select("targetid", sky.morphology_code(F.col("type")).alias("_morph"), sky.quantise_radius(F.col("shape_r")).alias("_shape"), sky.quantise_colour(sky.magnitude(F.col("flux_g")) - sky.magnitude(F.col("flux_r")), 85).alias("_gr"), sky.quantise_colour(sky.magnitude(F.col("flux_r")) - sky.magnitude(F.col("flux_z")), 102).alias("_rz"), "type", "shape_r", "flux_g", "flux_r", "flux_z")
    sure = aggregates.conflict_free(measured, "targetid", ["type", "shape_r", "flux_g", "flux_r", "flux_z"]).select("targetid")
    found = known.join(sure, "targetid", "left_semi").where(F.col("_morph") != sky.UNKNOWN).select("targetid", "_morph", "_shape", "_gr", "_rz").dropDuplicates(["targetid"])
    use = (F.col("morph") == sky.UNKNOWN) & F.col("_morph").isNotNull()
    out = rows.join(found, "targetid", "left")
    return out.select(*[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("morph", "shape", "gr", "rz") else F.col(c) for c in rows.columns])
