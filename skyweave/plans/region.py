"""The region query: an oriented box around one object, before and after its neighbours' displacements."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import aggregates, gates, identity, layout, zorder
from skyweave.storage import materialize


def box(points: DataFrame, key: str, position: list[str], target, dimensions: tuple[float, float, float], delta: str = "delta", amount: float = 1.0) -> DataFrame:
    """Points in the box: local coordinates before (u, v, w) and after (u2, v2, w2) displacement, and retained (still inside)."""
    at = gates.exactly_one(points.where(F.col(key) == target).select(*position))
    return box_around(points, position, tuple(float(at[c]) for c in position), dimensions, delta, amount)


def box_around(points: DataFrame, position: list[str], center: tuple[float, float, float], dimensions: tuple[float, float, float], delta: str = "delta", amount: float = 1.0) -> DataFrame:
    """box() around a known place."""
    frame = sky.basis(center)
    p = [F.col(c).cast("double") for c in position]
    local = lambda xs: [sky.dot([x - c for x, c in zip(xs, center)], list(axis)) for axis in frame]
    before, after = local(p), local(sky.displace(p, F.coalesce(F.col(delta), F.lit(0.0)), amount))
    inside, still = F.lit(True), F.lit(True)
    for a, b, d in zip(before, after, dimensions):
        inside, still = inside & (F.abs(a) <= d / 2), still & (F.abs(b) <= d / 2)
    names = list(zip("uvw", before)) + [(f"{n}2", x) for n, x in zip("uvw", after)]
    return points.where(inside).select("*", *[x.alias(n) for n, x in names], still.alias("retained"))


def pruned_box(laid: zorder.Laid, known: DataFrame, key: str, target, dimensions: tuple[float, float, float], delta: Column, amount: float = 1.0) -> DataFrame:
    """box() that reads little: the centre comes from one bucket of `known` (identity.store() of key and position), the points from the ranges of a Z-order table that the box meets. delta: displacement of a point."""
    at = gates.exactly_one(identity.find(known, key, target).select(*laid.position))
    center = tuple(float(at[c]) for c in laid.position)
    half = [sum(abs(axis[j]) * d / 2 for axis, d in zip(sky.basis(center), dimensions)) * (1 + 1e-9) for j in range(3)]
    near = laid.within_box([c - h for c, h in zip(center, half)], [c + h for c, h in zip(center, half)])
    return box_around(near.withColumn("delta", delta), laid.position, center, dimensions, "delta", amount)


def report(inside: DataFrame, key: str, target, dimensions, component: str = "both", bins: int = 40, shown: int = 10_000, seed: int = 42, position: tuple[str, ...] = ()) -> dict:
    """Summary, histograms, the 25 largest displacements and the drawn sample; columns fog, rsd, applied are due.

    The summary's centre is the target's position, and its chunk where the points have that column.
    """
    inside = materialize(inside, "region")  # read several times below
    at = gates.exactly_one(inside.where(F.col(key) == target).select(*position, "u", "v", "w", "u2", "v2", "w2", *(["chunk"] if "chunk" in inside.columns else [])))
    row = inside.agg(F.count("*").alias("n"), F.count_if("retained").alias("still"), F.count_if(F.col("fog") != 0).alias("fog"), F.count_if(F.col("rsd") != 0).alias("rsd"), F.count_if(F.col("applied") != 0).alias("applied")).first()
    gates.require(not inside.where(~(sky.finite(F.col("u2")) & sky.finite(F.col("v2")) & sky.finite(F.col("w2")))).take(1), "a corrected position is not finite")
    sizes = lambda c, points: aggregates.exact_percentiles(inside.where(F.col(c) != 0).select(F.abs(c).alias("x")), "x", points).get(0)
    p, p95_rsd = sizes("applied", [0.5, 0.95, 1.0]) or [0.0, 0.0, 0.0], (sizes("rsd", [0.95]) or [1.0])[0]
    sample = layout.hash_sample(inside.withColumn("_all", F.lit(1)), "_all", key, shown, str(seed)).drop("_all")
    histograms = {}
    #: Fixed: titles of the three series, which are the keys of their histograms.
    series = (("Signed RSD displacement", F.col("rsd"), True), ("Absolute RSD displacement", F.abs("rsd"), False), (f"Absolute applied displacement ({component})", F.abs("applied"), False))
    for name, value, signed in series:
        rows = sorted(aggregates.histogram(inside.withColumn("_x", value), "_x", bins, signed).collect(), key=lambda r: r["bin"])
        real = [r for r in rows if r["bin"] >= 0]
        histograms[name] = {"binEdgesMpc": [real[0]["low"], *(r["high"] for r in real)], "counts": [r["n"] for r in real], "zeroCount": rows[0]["n"], "outsidePlottedP99Range": rows[1]["n"]}
    #: Fixed: names of the report and its two notes.
    summary = {
        "targetid": str(target), "centerChunk": at["chunk"] if "chunk" in inside.columns else None, "centerObservedMpc": [float(at[c]) for c in position],
        "dimensionsMly": [d * sky.MPC_TO_MLY for d in dimensions], "component": component,
        "selection": "observed-position axis-aligned box in Earth line-of-sight frame",
        "objectsInObservedBox": row["n"], "correctedPositionsStillInBox": row["still"], "correctedPositionsOutsideBox": row["n"] - row["still"],
        "objectsWithNonzeroFoG": row["fog"], "objectsWithNonzeroRSD": row["rsd"], "objectsWithAppliedDisplacement": row["applied"],
        "absoluteAppliedDisplacementMpc": {"median": p[0], "p95": p[1], "maximum": p[2]}, "histogramData": "histograms.json",
        "samplePlotted": min(row["n"], shown), "sampleSeed": seed, "redCross": "same TARGETID in both panels; corrected cross may move radially",
    }
    top = layout.largest(inside, F.col("applied"), key).select(key, *[F.format_string("%.7g", F.col(c).cast("double")).alias(f"{c}_mpc") for c in ("fog", "rsd", "applied")])
    scale = max(p95_rsd, 1.0)
    coloured = sample.withColumn("colour", sky.component_colour(F.coalesce("fog", F.lit(0.0)), F.coalesce("rsd", F.lit(0.0)), scale, component))
    return {"summary": summary, "histograms": histograms, "largest": top, "sample": coloured, "target": at.asDict()}


def query(points: DataFrame, key: str, position: list[str], target, width: float, height: float, depth: float, component: str = "both", unit: str = "mly", **options) -> dict:
    """The whole query on points with columns fog and rsd (Mpc); sides in million light years or Mpc."""
    dimensions = tuple(x / (sky.MPC_TO_MLY if unit == "mly" else 1.0) for x in (width, height, depth))
    gates.require(all(d > 0 for d in dimensions), "sides are positive")
    moved = points.withColumn("applied", sky.applied(F.coalesce("fog", F.lit(0.0)), F.coalesce("rsd", F.lit(0.0)), component))
    return report(box(moved, key, position, target, dimensions, "applied"), key, target, dimensions, component, position=tuple(position), **options)


def svg(sample: list, title: str, target: dict, size: int = 420) -> str:
    """Four panels: u-v and u-w, before and after; rows have u, v, w, u2, v2, w2, colour; a red cross marks the target."""
    half = max([1e-9, *(abs(r[c]) for r in sample for c in ("u", "v", "w"))])
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{2 * size}" height="{2 * size + 30}"><text x="8" y="20">{title}</text>']
    for k, (a, b) in enumerate((("u", "v"), ("u2", "v2"), ("u", "w"), ("u2", "w2"))):
        x0, y0 = (k % 2) * size, 30 + (k // 2) * size
        out.append(f'<rect x="{x0}" y="{y0}" width="{size}" height="{size}" fill="none" stroke="black"/>')
        for r in sample:
            x, y = x0 + size * (0.5 + r[a] / half / 2), y0 + size * (0.5 - r[b] / half / 2)
            out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="1.5" fill="{r["colour"]}"/>')
        x, y = x0 + size * (0.5 + target[a] / half / 2), y0 + size * (0.5 - target[b] / half / 2)
        out.append(f'<path d="M{x - 6:.1f} {y:.1f}h12m-6 -6v12" stroke="red"/>')
    return "\n".join([*out, "</svg>"])


def bars(histograms: dict, width: int = 420, height: int = 160) -> str:
    """One panel for each histogram of report()."""
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height * len(histograms)}">']
    for k, (name, h) in enumerate(histograms.items()):
        top, n = max([1, *h["counts"]]), len(h["counts"])
        for i, c in enumerate(h["counts"]):
            tall = (height - 30) * c / top
            out.append(f'<rect x="{width * i / n:.1f}" y="{height * (k + 1) - tall:.1f}" width="{width / n * 0.9:.1f}" height="{tall:.1f}"/>')
        out.append(f'<text x="4" y="{height * k + 14}">{name}: zero {h["zeroCount"]}, outside {h["outsidePlottedP99Range"]}</text>')
    return "\n".join([*out, "</svg>"])


def write(result: dict, out: str) -> None:
    """summary.json, histograms.json, largest_displacements.csv, comparison.svg, histograms.svg into a folder of the driver."""
    import os

    os.makedirs(out, exist_ok=True)
    for name in ("summary", "histograms"):
        with open(f"{out}/{name}.json", "w", encoding="utf-8") as f:
            f.write(json.dumps(result[name], indent=2) + "\n")
    rows = [r.asDict() for r in result["sample"].select("u", "v", "w", "u2", "v2", "w2", "colour").collect()]
    for name, text in (("comparison.svg", svg(rows, result["summary"]["targetid"], result["target"])), ("histograms.svg", bars(result["histograms"]))):
        with open(f"{out}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    top = result["largest"].collect()
    with open(f"{out}/largest_displacements.csv", "w", encoding="utf-8") as f:
        f.write("targetid,fog_mpc,rsd_mpc,applied_mpc\n" + "".join(",".join(map(str, r)) + "\n" for r in top))
