"""Arrays from formulas: every voxel is computed from its coordinates, so a box costs what it holds.

Values are those of the array format's public generators, in double instead of single precision. Formulas are columns over the
level-0 places ``Z``, ``Y``, ``X``; spheres, whose number follows the space and not the voxels, are drawn once a lattice cell
and meet the voxels by one equi-join.
"""

from __future__ import annotations

from functools import reduce
from math import log, log2

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import lattice_noise
from ..grid import Grid
from ..meta import ArrayMeta, Box

#: Cell sizes of the two octaves of noise, and its height.
NOISE_CELLS, NOISE_HEIGHT = (256, 128), 80
#: Cell size and spheres in a cell.
SPHERES = {"blobs": (128.0, 2), "shells": (160.0, 1)}
#: Steps of the quaternion set and the squared size at which a point has left it; its extent.
JULIA_STEPS, JULIA_FAR, JULIA_WIDTH = 14, 16, 2.8
#: Half the bulb's extent and its power.
BULB, POWER = 1.25, 8.0
AXES = ("Z", "Y", "X")


def coordinates(spark: SparkSession, box: Box, stride: int = 1) -> DataFrame:
    """The voxels of a box: a range whose rows are keyed arithmetically. ``X``, ``Y``, ``Z`` are level-0 places."""
    nz, ny, nx = box.shape
    i = F.col("id")
    at = {"z": F.floor(i / (ny * nx)) + box.start[0], "y": F.floor(i / nx) % ny + box.start[1], "x": i % nx + box.start[2]}
    df = spark.range(nz * ny * nx).select(*[c.cast("long").alias(a) for a, c in at.items()])
    return df.select("z", "y", "x", *[(F.col(a) * stride).alias(a.upper()) for a in "zyx"])


def noise(seed: int) -> Column:
    """Smooth value noise: lattice values interpolated, each octave half as high as the one before."""
    total, height = F.lit(0.0), 0.0
    for octave, size in enumerate(NOISE_CELLS):
        cell = {a: F.floor(F.col(a) / size).cast("long") for a in AXES}
        part = {a: (F.col(a) % size) / float(size) for a in AXES}
        smooth = {a: t * t * (F.lit(3.0) - t * 2) for a, t in part.items()}
        value = F.lit(0.0)
        for corner in np.ndindex(2, 2, 2):
            w = reduce(lambda p, q: p * q, [smooth[a] if d else F.lit(1.0) - smooth[a] for a, d in zip(AXES, corner, strict=True)])
            value = value + w * lattice_noise(*[cell[a] + d for a, d in zip(AXES, corner, strict=True)], seed + octave)
        total = total + value * (0.5**octave)
        height += 0.5**octave
    return total / height * NOISE_HEIGHT


def _drawn(kind: str, seed: int) -> list[Column]:
    """Centre, radius, height and reach of sphere ``k`` of the cell ``gz``, ``gy``, ``gx``."""
    size, _ = SPHERES[kind]
    u = [lattice_noise(F.col("gz"), F.col("gy"), F.col("gx"), F.col("k") * 7 + (seed * 131 + i)) for i in range(5)]
    if kind == "blobs":
        at = [(F.col(g) + x) * size for g, x in zip(("gz", "gy", "gx"), u, strict=False)]
        radius, height = u[3] * (size / 6 - 8) + 8, u[4] * 130 + 90
        return [*at, radius, height, radius * 3]
    at = [(F.col(g) + 0.5 + (x - 0.5) * 0.4) * size for g, x in zip(("gz", "gy", "gx"), u, strict=False)]
    radius = (u[3] * 0.15 + 0.22) * size
    return [*at, radius, F.lit(200.0), radius + 10]


def with_spheres(df: DataFrame, kind: str, seed: int, name: str = "v") -> DataFrame:
    """``df`` with the sum of all spheres that reach a voxel: those of the eight cells whose middles are nearest.

    ``blobs`` are Gaussian, cut off at three radii; ``shells`` have a bright skin around a dimly filled ball.
    """
    size, each = SPHERES[kind]
    keys = [f"__b{a.lower()}" for a in AXES]
    placed = df.select("*", *[F.floor(F.col(a) / size - 0.5).cast("long").alias(k) for a, k in zip(AXES, keys, strict=True)])
    cells = placed.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(8 * each - 1))).alias("n"))
    cells = cells.select(*keys, *[(F.col(b) + F.shiftright("n", s).bitwiseAND(F.lit(1))).cast("long").alias(g) for b, s, g in zip(keys, (2, 1, 0), ("gz", "gy", "gx"), strict=True)], F.shiftright("n", 3).cast("long").alias("k"))
    drawn = cells.select(*keys, F.struct(*[c.alias(n) for c, n in zip(_drawn(kind, seed), ("z", "y", "x", "r", "h", "far"), strict=True)]).alias("s"))
    near = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("__near"))

    def height(s: Column) -> Column:
        d2 = reduce(lambda p, q: p + q, [F.pow(F.col(a) - s[a.lower()], F.lit(2.0)) for a in AXES])
        if kind == "blobs":
            value = s["h"] * F.exp(-d2 / (s["r"] * s["r"] * 2))
        else:
            off = F.sqrt(d2) - s["r"]
            value = s["h"] * F.exp(-(off * off) / 12.5) + F.when(off < 0, 40.0).otherwise(0.0)
        return F.when(d2 <= s["far"] * s["far"], value).otherwise(0.0)

    met = placed.join(near, keys)
    return met.select(*[c for c in df.columns if c != name], F.aggregate("__near", F.lit(0.0), lambda total, s: total + height(s)).alias(name))


def julia_constant(seed: int) -> list[float]:
    return (np.random.default_rng(seed).uniform(-0.8, 0.4, 4) * np.array([1, 1, 1, 0.3])).tolist()


def julia(shape: tuple[int, int, int], seed: int = 0) -> Column:
    """Steps that a point of the quaternion Julia set's slice stays near, in shares of 255."""
    c = julia_constant(seed)
    p = {a: F.col(a) / (max(shape) / JULIA_WIDTH) - JULIA_WIDTH / 2 for a in AXES}
    start = F.struct(p["X"].alias("a"), p["Y"].alias("b"), p["Z"].alias("c"), F.lit(0.0).alias("d"), F.lit(True).alias("near"), F.lit(0.0).alias("n"))

    def step(q: Column, _: Column) -> Column:
        a, b, e, d = (q[k] for k in "abcd")
        return F.struct((a * a - b * b - e * e - d * d + c[0]).alias("a"), (a * b * 2 + c[1]).alias("b"), (a * e * 2 + c[2]).alias("c"), (a * d * 2 + c[3]).alias("d"), q["near"], q["n"])

    def judged(q: Column) -> Column:
        near = q["near"] & (q["a"] * q["a"] + q["b"] * q["b"] + q["c"] * q["c"] + q["d"] * q["d"] < JULIA_FAR)
        return F.struct(*[F.when(near, q[k]).otherwise(0.0).alias(k) for k in "abcd"], near.alias("near"), (q["n"] + near.cast("double")).alias("n"))

    one = lambda q, i: F.transform(F.array(step(q, i)), judged)[0]  # noqa: E731  a step is worked out once and judged after
    return F.aggregate(F.sequence(F.lit(1), F.lit(JULIA_STEPS)), start, one, lambda q: q["n"]) * (255.0 / JULIA_STEPS)


def bulb_steps(shape: tuple[int, int, int], level: int) -> int:
    """How long a level looks: longer the finer its voxels are."""
    return int(min(80.0, max(10.0, 10 + 3 * log2(max(shape) / (256 * 2**level)))))


def mandelbulb(shape: tuple[int, int, int], level: int = 0) -> Column:
    """Four times the smooth step at which a point leaves the eighth-power bulb; 255 for those that stay."""
    across, stride = BULB * 2 / max(shape), 2**level
    p = {a: (F.col(a) + 0.5 * stride) * across - BULB for a in AXES}
    start = F.struct(*[p[a].alias(a.lower()) for a in AXES], F.lit(None).cast("double").alias("out"))

    def step(q: Column, i: Column) -> Column:
        r = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
        sized = F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"), q["out"].alias("out"), r.alias("r"))

        def moved(s: Column) -> Column:
            theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["z"] / F.greatest(s["r"], F.lit(1e-300))))) * POWER
            phi, far = F.atan2(s["y"], s["x"]) * POWER, F.pow(s["r"], F.lit(POWER))
            smooth = (i + 1 - F.log(F.log(s["r"]) / log(2)) / log(POWER)) * 4
            kept = [s[a].alias(a) for a in ("z", "y", "x")]
            left = F.struct(*kept, F.least(F.lit(254.0), F.greatest(F.lit(0.0), smooth)).alias("out"))
            new = F.struct((far * F.cos(theta) + p["Z"]).alias("z"), (far * F.sin(theta) * F.sin(phi) + p["Y"]).alias("y"), (far * F.sin(theta) * F.cos(phi) + p["X"]).alias("x"), s["out"].alias("out"))
            return F.when(s["out"].isNotNull(), F.struct(*kept, s["out"].alias("out"))).when(s["r"] > 2, left).otherwise(new)

        return F.transform(F.array(sized), moved)[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(bulb_steps(shape, level) - 1)), start, step, lambda q: F.coalesce(q["out"], F.lit(255.0)))


KINDS = ("blobs", "shells", "noise", "julia", "mandelbulb")


def with_kind(df: DataFrame, kind: str, shape: tuple[int, int, int], level: int = 0, seed: int = 0, name: str = "v") -> DataFrame:
    """``df`` (with ``Z``, ``Y``, ``X``) and one kind's value."""
    if kind in SPHERES:
        return with_spheres(df, kind, seed, name)
    makers = {"noise": lambda: noise(seed), "julia": lambda: julia(shape, seed), "mandelbulb": lambda: mandelbulb(shape, level)}
    return df.withColumn(name, makers[kind]())


def synthetic(spark: SparkSession, kinds: str = "blobs", shape: tuple[int, int, int] = (256, 256, 256), level: int = 0, seed: int = 0, box: Box | None = None, voxel_size: float = 8.0, unit: str = "nm") -> Grid:
    """One level of ``kind+kind+...``: their sum within 0 and 255. Level ``i`` is the function at every ``2 ** i``-th place."""
    stride = 2**level
    meta = ArrayMeta(("z", "y", "x"), tuple(-(-n // stride) for n in shape), "uint8", (64, 64, 64), (voxel_size * stride,) * 3, (unit,) * 3)
    names = kinds.split("+")
    if unknown := [k for k in names if k not in KINDS]:
        raise ValueError(f"unknown kind {unknown[0]}")
    df = coordinates(spark, (box or meta.box).clip(meta.shape), stride)
    for i, kind in enumerate(names):
        df = with_kind(df, kind, shape, level, seed, f"v{i}")
    total = reduce(lambda a, b: a + b, [F.col(f"v{i}") for i in range(len(names))])
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), total))
    return Grid(df.select("z", "y", "x", v.cast("long").alias("v")), meta)
