"""Displacement fields: weighted mesh deposit, iterative FFT reconstruction, and queries at positions.

The deposit and the queries are joins and aggregates on mesh cells.  Only the solve, on at most `MOST` cells of one
field, is a single numpy task for each field; the method is the published iterative FFT scheme with a local line of sight.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates
from skyweave.storage import materialize

MOST = 20_000_000
CELLS = "field string, i long, j long, k long, data double, random double"
MESH = "field string, i long, j long, k long, sx double, sy double, sz double"


def corners(position: list[str], low: list, cell) -> list:
    """(i, j, k, weight) structs of the eight cells around a position (cloud in cell); low, cell: numbers or columns."""
    at = [(F.col(c) - lo) / cell for c, lo in zip(position, low)]
    base = [F.floor(a) for a in at]
    part = [a - b for a, b in zip(at, base)]
    out = []
    for step in product((0, 1), repeat=3):
        w = F.lit(1.0)
        for s, p in zip(step, part):
            w = w * (p if s else 1 - p)
        out.append(F.struct(*[(b + s).cast("long").alias(n) for n, b, s in zip("ijk", base, step)], w.alias("w")))
    return out


def shapes(spark: SparkSession, geometry: dict) -> DataFrame:
    """_name, _low0 to _low2, _cell, _n0 to _n2: a row for each field's mesh, broadcast."""
    rows = [(name, *map(float, g["low"]), float(g["cell"]), *map(int, g["shape"])) for name, g in geometry.items()]
    return F.broadcast(spark.createDataFrame(rows, "_name string, _low0 double, _low1 double, _low2 double, _cell double, _n0 long, _n1 long, _n2 long"))


def deposit(points: DataFrame, position: list[str], weight: str, low: list, cell, group: list[str] | None = None) -> DataFrame:
    """group columns, i, j, k, value: sums of weights on the mesh."""
    keys = group or []
    shared = points.select(*keys, F.col(weight).alias("_weight"), F.explode(F.array(*corners(position, low, cell))).alias("c"))
    return shared.groupBy(*keys, "c.i", "c.j", "c.k").agg(F.sum(F.col("c.w") * F.col("_weight")).alias("value"))


def solve(data: np.ndarray, random: np.ndarray, low, cell: float, smoothing: float, bias: float, growth: float, iterations: int = 3, floor: float = 0.01) -> np.ndarray:
    """Redshift-space shift (3, nx, ny, nz) from data and random counts on a mesh; low: position of cell (0, 0, 0)."""
    shape = data.shape
    ks = np.meshgrid(*[2 * np.pi * np.fft.fftfreq(n, cell) for n in shape[:2]], 2 * np.pi * np.fft.rfftfreq(shape[2], cell), indexing="ij")
    k2 = sum(k * k for k in ks)
    window = np.exp(-0.5 * k2 * smoothing**2)
    k2[0, 0, 0] = 1.0
    fft, back = np.fft.rfftn, lambda x: np.fft.irfftn(x, shape, axes=(0, 1, 2))
    d, r = back(fft(data) * window), back(fft(random) * window)
    ratio = data.sum() / max(random.sum(), 1e-300)
    there = r > floor * r.mean()
    contrast = np.where(there, d / np.where(there, ratio * r, 1.0) - 1.0, 0.0) / bias
    where = np.meshgrid(*[lo + cell * np.arange(n) for lo, n in zip(low, shape)], indexing="ij")
    far = np.sqrt(sum(w * w for w in where))
    sight = [w / np.where(far > 0, far, 1.0) for w in where]
    real, radial = contrast, np.zeros(shape)
    for _ in range(iterations):
        field = fft(real)
        field[0, 0, 0] = 0.0
        psi = [back(1j * k / k2 * field) for k in ks]  # displacement whose divergence is minus the contrast
        radial = sum(p * s for p, s in zip(psi, sight))
        pushed = sum(back(1j * k * fft(radial * s)) for k, s in zip(ks, sight))
        real = contrast + growth * pushed
    return np.stack([growth * radial * s for s in sight])


def reconstruct(data: DataFrame, randoms: DataFrame, position: list[str], cell: float, smoothing: float, bias: float, growth: float, field: str = "field", weight: str = "weight", pad: float = 1.2, iterations: int = 3) -> tuple[DataFrame, dict]:
    """Mesh of shifts (field, i, j, k, sx, sy, sz) and its geometry (low, shape, cell) for each field value."""
    both = data.select(field, *position).unionByName(randoms.select(field, *position))
    ends = {r[field]: r for r in both.groupBy(field).agg(*[F.min(c).alias(f"lo{n}") for n, c in enumerate(position)], *[F.max(c).alias(f"hi{n}") for n, c in enumerate(position)]).collect()}
    geometry = {}
    for name, r in ends.items():
        box = [max(cell, (r[f"hi{n}"] - r[f"lo{n}"]) * pad) for n in range(3)]
        shape = [int(np.ceil(b / cell)) + 2 for b in box]
        gates.require(int(np.prod(shape)) <= MOST, f"{name}: mesh of {shape} cells")
        middle = [(r[f"hi{n}"] + r[f"lo{n}"]) / 2 for n in range(3)]
        geometry[name] = {"low": [m - cell * (s - 1) / 2 for m, s in zip(middle, shape)], "shape": shape, "cell": cell}
    gates.require(bool(geometry), "no rows to reconstruct from")
    known, own = shapes(data.sparkSession, geometry), []
    for kind, rows in (("data", data), ("random", randoms)):  # each read once, whatever the number of fields
        met = rows.select(F.col(field).alias("field"), *position, weight).join(known, F.col("field") == F.col("_name"))
        cells = deposit(met, position, weight, [F.col(f"_low{n}") for n in range(3)], F.col("_cell"), ["field"])
        own.append(cells.select("field", "i", "j", "k", *[(F.col("value") if kind == n else F.lit(0.0)).alias(n) for n in ("data", "random")]))
    parts = own[0].unionByName(own[1])

    def work(cells: pd.DataFrame) -> pd.DataFrame:
        name = cells["field"].iloc[0]
        g = geometry[name]
        mesh = np.zeros((2, *g["shape"]))
        at = tuple(cells[c].to_numpy() for c in "ijk")
        for n, kind in enumerate(("data", "random")):
            np.add.at(mesh[n], at, cells[kind].to_numpy())
        shift = solve(mesh[0], mesh[1], g["low"], g["cell"], smoothing, bias, growth, iterations)
        i, j, k = (x.ravel() for x in np.indices(g["shape"]))
        return pd.DataFrame({"field": name, "i": i, "j": j, "k": k, "sx": shift[0].ravel(), "sy": shift[1].ravel(), "sz": shift[2].ravel()})

    cells = parts.groupBy("field", "i", "j", "k").agg(F.sum("data").alias("data"), F.sum("random").alias("random"))
    # Written once: each query of a field reads its mesh, and no solve runs twice.
    return materialize(cells.groupBy("field").applyInPandas(work, MESH), "mesh"), geometry


def shifts_at(points: DataFrame, mesh: DataFrame, geometry: dict, key: str, position: list[str], field: str = "field") -> DataFrame:
    """key, field, sx, sy, sz, delta_mpc: shift interpolated from the eight cells around each point, and its radial displacement.

    Points outside the box of their field's mesh have no row, nor have points that lack one of the eight cells.
    """
    at = points.select(F.col(key).alias("_key"), F.col(field).alias("_field"), *[F.col(c).cast("double").alias(f"_p{n}") for n, c in enumerate(position)])
    near = at.join(shapes(points.sparkSession, geometry), F.col("_field") == F.col("_name"))
    for n in range(3):
        p, low, cell, size = (F.col(f"{c}{n}") if c != "_cell" else F.col(c) for c in ("_p", "_low", "_cell", "_n"))
        near = near.where(p.between(low, low + cell * (size - 1)) & (F.floor((p - low) / cell) < size - 1))
    near = near.select("_key", "_field", "_p0", "_p1", "_p2", F.explode(F.array(*corners([f"_p{n}" for n in range(3)], [F.col(f"_low{n}") for n in range(3)], F.col("_cell")))).alias("c")).select("_key", "_field", "_p0", "_p1", "_p2", "c.*")
    own = near.join(mesh.withColumnRenamed("field", "_field"), ["_field", "i", "j", "k"])
    sums = own.groupBy("_key", "_field").agg(*[F.first(f"_p{n}").alias(f"_p{n}") for n in range(3)], *[F.sum(F.col("w") * F.col(s)).alias(s) for s in ("sx", "sy", "sz")], F.count("*").alias("_n")).where("_n = 8")
    return sums.select(F.col("_key").alias(key), F.col("_field").alias("field"), "sx", "sy", "sz", sky.radial_shift([F.col(s) for s in ("sx", "sy", "sz")], [F.col(f"_p{n}") for n in range(3)]).alias("delta_mpc"))


def same_mesh(a: dict, b: dict, tolerance: float = 1e-6) -> bool:
    """Whether two geometries are one."""
    close = lambda x, y: abs(x - y) <= tolerance * max(1.0, abs(x), abs(y))
    return a.keys() == b.keys() and all(a[n]["shape"] == b[n]["shape"] and close(a[n]["cell"], b[n]["cell"]) and all(map(close, a[n]["low"], b[n]["low"])) for n in a)


#: Percentiles of a shift's size and radial part, and of its transverse part.
SHIFT_RANKS = {"size": (50, 75, 90, 95, 99, 100), "radial": (50, 75, 90, 95, 99, 100), "transverse": (50, 90, 99, 100)}


def shift_statistics(points: DataFrame, shift: list[str], position: list[str]) -> DataFrame:
    """<part>_mean and <part>_p<percentile> of the shift's size, its radial part without sign, and its transverse part."""
    s, p = [F.col(c).cast("double") for c in shift], [F.col(c).cast("double") for c in position]
    parts = points.select(sky.norm(*s).alias("size"), F.abs(sky.radial_shift(s, p)).alias("radial"), sky.transverse_shift(s, p).alias("transverse"))
    held = materialize(parts, "shifts")
    out = []
    for c, ranks in SHIFT_RANKS.items():
        found = aggregates.exact_percentiles(held, c, [k / 100 for k in ranks]).get(0, [None] * len(ranks))
        out += [F.avg(c).alias(f"{c}_mean"), *[F.lit(x).cast("double").alias(f"{c}_p{k}") for k, x in zip(ranks, found)]]
    return held.agg(*out)
