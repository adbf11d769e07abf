"""Column expressions on sky catalogues: positions, quantisers, bit flags, displacements, units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: megaparsec to million light years, and the quantiser constants of the catalogue format.
MPC_TO_MLY = 3.261563777
#: Fixed: morphology codes; anything else is UNKNOWN.
MORPHOLOGY = {"PSF": 0, "REX": 1, "EXP": 2, "DEV": 3, "SER": 4}
UNKNOWN, NO_COLOUR = 255, 128


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))


def clip(x: Column, low, high) -> Column:
    """Into [low, high]; null stays null, which greatest and least alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def sky_to_cartesian(ra: Column, dec: Column, distance: Column) -> list[Column]:
    """x, y, z of a direction in degrees and a distance."""
    a, d = F.radians(ra), F.radians(dec)
    return [distance * F.cos(d) * F.cos(a), distance * F.cos(d) * F.sin(a), distance * F.sin(d)]


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    """Single-precision unit vector of a direction in degrees."""
    return [f32(x) for x in sky_to_cartesian(ra, dec, F.lit(1.0))]


def interpolate(x: Column, low: float, step: float, values: list[float]) -> Column:
    """Linear interpolation in a table of equally spaced nodes low, low + step, ...; constant beyond its ends."""
    # one literal that the optimiser folds to an array, however many nodes
    nodes = F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")
    at = clip((x - F.lit(low)) / F.lit(step), 0.0, float(len(values) - 1))
    k = F.least(F.floor(at).cast("int"), F.lit(len(values) - 2))
    a, b = F.get(nodes, k), F.get(nodes, k + 1)
    return a + (b - a) * (at - k)


def comoving_distances(redshifts: list[float], h0: float = 67.66, omega_m: float = 0.30966, omega_r: float = 9.1e-5) -> list[float]:
    """Comoving distance (Mpc) of sorted redshifts in a flat universe, by Simpson's rule between them; defaults are public Planck 2018 values."""
    light = 299792.458

    def slowness(z: float) -> float:
        return 1 / math.sqrt(omega_m * (1 + z) ** 3 + omega_r * (1 + z) ** 4 + 1 - omega_m - omega_r)

    out, total, last = [], 0.0, 0.0
    for z in redshifts:
        n = 2 * max(1, math.ceil((z - last) / 0.002))
        h = (z - last) / n
        total += h / 3 * sum(slowness(last + k * h) * (1 if k in (0, n) else 4 if k % 2 else 2) for k in range(n + 1))
        out.append(light / h0 * total)
        last = z
    return out


def comoving_distance(z: Column, z_max: float, nodes: int = 16384, **cosmology) -> Column:
    """Distance by linear interpolation in a table on [0, 1.001 z_max]."""
    step = 1.001 * z_max / (nodes - 1)
    return interpolate(z, 0.0, step, comoving_distances([k * step for k in range(nodes)], **cosmology))


def magnitude(flux: Column) -> Column:
    """Magnitude of a flux in nanomaggies; NaN for fluxes that aren't positive."""
    return F.when(flux > 0, 22.5 - 2.5 * F.log10(flux)).otherwise(F.lit(float("nan")))


def quantise_position(x: Column, units: Column | float) -> Column:
    return F.rint(x * units).cast("int")


def quantise_redshift(z: Column, low: float, high: float) -> Column:
    return F.rint((z - low) / (high - low) * 65535).cast("int") if high > low else F.lit(0)


def dequantise_redshift(code: Column, low: float, high: float) -> Column:
    """In single precision at every step."""
    return f32(f32(low) + f32(f32(code) * f32((high - low) / 65535)))


def requantise(position: Column, own_units: float, units: float) -> Column:
    """A position code in another scale, in single precision."""
    return F.rint(f32(f32(f32(position) / f32(own_units)) * f32(units))).cast("int")


def quantise_radius(r: Column) -> Column:
    return F.when(finite(r), clip(F.rint(r * 10), 0, 255)).otherwise(0).cast("int")


def quantise_colour(c: Column, scale: float) -> Column:
    return F.when(finite(c), clip(F.rint((c + 0.5) * scale), 0, 255)).otherwise(NO_COLOUR).cast("int")


def morphology_code(label: Column) -> Column:
    out = F.lit(UNKNOWN)
    for name, code in MORPHOLOGY.items():
        out = F.when(F.trim(label) == name, code).otherwise(out)
    return out


def bit_or(*masks: Column) -> Column:
    out = F.coalesce(masks[0], F.lit(0)).cast("bigint")
    for m in masks[1:]:
        out = out.bitwiseOR(F.coalesce(m, F.lit(0)).cast("bigint"))
    return out


def has_bits(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits).cast("bigint")) != 0


def target_flags(dark: Column, bright: Column) -> Column:
    """Six label bits of two target masks: bright 15, bright 2, dark 1, dark 2, dark 4, and none of these."""
    tests = [has_bits(bright, 15), has_bits(bright, 2), has_bits(dark, 1), has_bits(dark, 2), has_bits(dark, 4)]
    flags = sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))
    return F.when(flags == 0, 32).otherwise(flags)


def type_byte(flags: Column, is_quasar: Column) -> Column:
    return flags.bitwiseOR(is_quasar.cast("int") * 64)


def is_quasar(byte: Column) -> Column:
    return byte.bitwiseAND(64) != 0


def spread_bits(x: Column) -> Column:
    """Ten bits with two free bits after each."""
    x = x.cast("bigint").bitwiseAND(F.lit(0x3FF))
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(qx: Column, qy: Column, qz: Column) -> Column:
    """Z-order key of ten bits for each of three 16-bit positions."""
    a, b, c = (spread_bits(F.shiftright(q.cast("bigint") + 32768, 6)) for q in (qx, qy, qz))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def spatial_chunk(qx: Column, qy: Column, qz: Column, n: int = 12) -> Column:
    """Hash partition of a position (fixed multipliers 17, 101, 59)."""
    return (F.abs(17 * qx.cast("bigint") + 59 * qz.cast("bigint") + 101 * qy.cast("bigint")) % n).cast("int")


def wrap16(x: Column) -> Column:
    """Into the range of a signed 16-bit integer, as overflow does."""
    return (F.pmod(x.cast("bigint") + 32768, F.lit(65536)) - 32768).cast("int")


def norm(*xs: Column) -> Column:
    return F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))


def dot(a: list[Column], b: list) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def displace(p: list[Column], delta: Column, amount: float = 1.0) -> list[Column]:
    """Positions moved along the line of sight; the origin stays."""
    r = norm(*p)
    return [F.when(r > 0, x + x / r * delta * amount).otherwise(x) for x in p]


def radial_shift(shift: list[Column], p: list[Column]) -> Column:
    """Displacement along the line of sight that undoes a shift."""
    r = norm(*p)
    return F.when(r > 0, -dot(shift, p) / r)


def transverse_shift(shift: list[Column], p: list[Column]) -> Column:
    radial = radial_shift(shift, p)
    return F.sqrt(F.greatest(F.lit(0.0), dot(shift, shift) - radial * radial))


def angular_separation(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Column:
    a, d, a0, d0 = map(F.radians, (ra, dec, ra0, dec0))
    return F.acos(clip(F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a - a0), -1.0, 1.0))


def compression(parallel: Column, transverse: Column, floor: float = 0.08) -> Column:
    """Radial scale of a group: transverse over parallel spread, within [floor, 1]."""
    return clip(F.try_divide(transverse, parallel), floor, 1.0)


def compressed_delta(offset: Column, alpha: Column, cap: float = 300.0) -> Column:
    return clip((alpha - 1) * offset, -cap, cap)


def basis(center: tuple[float, float, float]) -> list[tuple[float, float, float]]:
    """Orthonormal frame of a line of sight: two axes across, one along it."""
    length = math.sqrt(sum(c * c for c in center))
    if not length > 0:
        raise ValueError("no line of sight at the origin")
    along = tuple(c / length for c in center)
    pole = (0.0, 0.0, 1.0) if abs(along[2]) <= 0.95 else (0.0, 1.0, 0.0)
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    right = cross(pole, along)
    size = math.sqrt(sum(c * c for c in right))
    right = tuple(c / size for c in right)
    return [right, cross(along, right), along]


def chord_arcmin(d: Column) -> Column:
    """Arc minutes of a chord between unit vectors."""
    return F.degrees(2 * F.asin(clip(d / 2, -1.0, 1.0))) * 60


def pack_target(objid: Column, brickid: Column, release: Column) -> Column:
    """Identity of an object: bits 0-21 object, 22-41 brick, 42-57 release (the public layout)."""
    return objid.cast("bigint").bitwiseOR(F.shiftleft(brickid.cast("bigint"), 22)).bitwiseOR(F.shiftleft(release.cast("bigint"), 42))


def unpack_target(target: Column) -> list[Column]:
    return [target.bitwiseAND(F.lit((1 << 22) - 1)), F.shiftright(target, 22).bitwiseAND(F.lit((1 << 20) - 1)), F.shiftright(target, 42).bitwiseAND(F.lit((1 << 16) - 1))]


def applied(first: Column, second: Column, component: str) -> Column:
    """Which of two displacements act: 'fog', 'rsd' or 'both'."""
    if component not in ("fog", "rsd", "both"):
        raise ValueError(component)
    parts = [x for x, names in ((first, ("fog", "both")), (second, ("rsd", "both"))) if component in names]
    return sum(parts[1:], parts[0])


#: Fixed: colours of points: outward and inward channels (start, span), groups only, neither.
OUTWARD, INWARD, GROUPED, STILL = (172, -108), ((170, -120), (210, 45)), "#f59e0b", "#73869b"


def component_colour(fog: Column, rsd: Column, scale: float, component: str) -> Column:
    """Hex colour of a point: by the sign and size of rsd where it counts and isn't 0, else whether fog counts and isn't 0."""
    level = F.least(F.abs(rsd) / scale, F.lit(1.0))
    channel = lambda start, span: (F.lit(float(start)) + level * span).cast("int")
    out = F.when(fog != 0, F.lit(GROUPED)).otherwise(F.lit(STILL)) if component in ("fog", "both") else F.lit(STILL)
    if component not in ("rsd", "both"):
        return out
    outward = F.format_string("#ff%02x50", channel(*OUTWARD))
    inward = F.format_string("#50%02x%02x", channel(*INWARD[0]), channel(*INWARD[1]))
    return F.when(rsd > 0, outward).when(rsd < 0, inward).otherwise(out)


def colour_code(value: Column, scale: float) -> Column:
    """Hex colour of a displacement: red outward, blue inward, stronger for larger; grey for none."""
    level = F.rint(clip(F.abs(value) / scale, 0.0, 1.0) * 255).cast("int")
    return F.when(value > 0, F.format_string("#%02x3030", level)).when(value < 0, F.format_string("#3030%02x", level)).otherwise(F.lit("#808080"))
