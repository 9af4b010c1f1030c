"""Connected components and spots."""

from __future__ import annotations

from dataclasses import replace
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.components import connected_components
from ..grid import Grid
from .stencil import _blurred_pair, ball


def voxel_number(grid: Grid) -> Column:
    """A voxel's place in row order."""
    out = F.lit(0).cast("long")
    for a, n in zip(grid.axes, grid.meta.shape, strict=True):
        out = out * n + F.col(a)
    return out


def half_neighbours(n: int, connectivity: int) -> list[tuple[int, ...]]:
    """One of each two opposite offsets to neighbours that differ on at most ``connectivity`` axes."""
    return [o for o in product((-1, 0, 1), repeat=n) if any(o) and sum(map(abs, o)) <= connectivity and o > (0,) * n]


def links(grid: Grid, connectivity: int = 1) -> DataFrame:
    """Pairs of neighbouring set voxels, by number: each voxel is sent to half its neighbours and meets what is there."""
    offsets = half_neighbours(len(grid.axes), connectivity)
    here = grid.df.where("v > 0").select(*grid.axes, voxel_number(grid).alias("a"))
    spread = here.select("a", F.explode(F.array(*[F.struct(*[(F.col(x) + k).alias(x) for x, k in zip(grid.axes, o, strict=True)]) for o in offsets])).alias("o")).select("a", "o.*")
    there = here.withColumnRenamed("a", "b")
    return spread.join(there, list(grid.axes)).select("a", "b")


def label(grid: Grid, min_size: int = 0, connectivity: int = 1) -> Grid:
    """Connected components of the whole array: each is named by its first voxel's number, plus 1; smaller ones go."""
    if min_size < 0 or not 1 <= connectivity <= 3:
        raise ValueError("min_size must be 0 or more, connectivity from 1 to 3")
    parts = connected_components(links(grid, connectivity))
    named = grid.df.withColumn("n", voxel_number(grid)).join(parts, F.col("n") == F.col("node"), "left")
    own = F.when(F.col("v") > 0, F.coalesce("component", "n") + 1).otherwise(F.lit(0))
    out = named.select(*grid.axes, own.cast("long").alias("v"))
    if min_size > 1:
        kept = out.where("v > 0").groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select(F.col("v").alias("kept"))
        out = out.join(kept, F.col("v") == F.col("kept"), "left").select(*grid.axes, F.coalesce("kept", F.lit(0)).cast("long").alias("v"))
    return Grid(out, replace(grid.meta, dtype="uint32", kind="label"))


def label_in_chunks(grid: Grid, connectivity: int = 1) -> Grid:
    """Connected components of each chunk by itself: links that cross a chunk's border are left out."""
    cell = F.struct(*[F.floor(F.col(a) / c).alias(a) for a, c in zip(grid.axes, grid.meta.chunk, strict=True)])
    here = grid.df.where("v > 0").select(*grid.axes, voxel_number(grid).alias("a"), cell.alias("cell"))
    offsets = half_neighbours(len(grid.axes), connectivity)
    spread = here.select("a", "cell", F.explode(F.array(*[F.struct(*[(F.col(x) + k).alias(x) for x, k in zip(grid.axes, o, strict=True)]) for o in offsets])).alias("o")).select("a", "cell", "o.*")
    met = spread.join(here.withColumnRenamed("a", "b"), [*grid.axes, "cell"]).select("a", "b")
    parts = connected_components(met)
    named = grid.df.withColumn("n", voxel_number(grid)).join(parts, F.col("n") == F.col("node"), "left")
    own = F.when(F.col("v") > 0, F.coalesce("component", "n") + 1).otherwise(F.lit(0))
    return Grid(named.select(*grid.axes, own.cast("long").alias("v")), replace(grid.meta, dtype="uint32", kind="label"))


#: The primes that a spot's place is hashed with.
SPOT_PRIMES = (73856093, 19349663, 83492791)


def spot_id(z: Column, y: Column, x: Column) -> Column:
    """A spot's id, from its place alone."""
    mixed = (z * SPOT_PRIMES[0]).bitwiseXOR(y * SPOT_PRIMES[1]).bitwiseXOR(x * SPOT_PRIMES[2])
    return F.pmod(mixed, F.lit(0xFFFFFFFE)) + 1


def spots(grid: Grid, sigma: float = 1.0, sigma_z: float = 0.6, threshold: float = 10.0, separation: int = 2, radius: int = 1, ratio: float = 1.6, truncate: float = 4.0) -> Grid:
    """Bright spots of a volume: peaks of a difference of Gaussians, drawn as balls; where balls overlap the largest id wins."""
    if grid.axes != ("z", "y", "x"):
        raise ValueError("spots need a volume (z, y, x)")
    s = (sigma_z, sigma, sigma)
    pair = _blurred_pair(grid, s, tuple(ratio * k for k in s), truncate)
    top = pair.select(*grid.axes, (F.col("n") - F.col("w")).alias("own"), (F.col("n") - F.col("w")).alias("v"))
    for axis in grid.axes:
        w = grid.along(axis).rowsBetween(-separation, separation)
        top = top.select(*grid.axes, "own", F.max("v").over(w).alias("v"))
    peaks = top.where((F.col("own") == F.col("v")) & (F.col("own") >= threshold))
    peaks = peaks.select(*grid.axes, spot_id(*map(F.col, grid.axes)).alias("id"))
    around = ball(grid.axes, radius)
    drawn = peaks.select("id", F.explode(F.array(*[F.struct(*[(F.col(a) + k).alias(a) for a, k in zip(grid.axes, o, strict=True)]) for o in around])).alias("o")).select("o.*", F.col("id").alias("v"))
    for a in grid.axes:
        drawn = drawn.where((F.col(a) >= 0) & (F.col(a) < grid.length(a)))
    both = grid.df.select(*grid.axes, F.lit(0).cast("long").alias("v")).unionByName(drawn)
    return Grid(both.groupBy(*grid.axes).agg(F.max("v").cast("long").alias("v")), replace(grid.meta, dtype="uint32", kind="label"))


def interest_points(grid: Grid, sigma: float = 1.8, threshold: float = 0.02, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Peaks of a difference of Gaussians over 3 voxels each way, off the faces, with places refined by parabolas.

    Two nearby Gaussians (a fourth of an octave apart), scaled so that responses do not depend on ``sigma``.
    """
    k = 2**0.25
    unit = Grid(grid.df.select(*grid.axes, ((F.col("v") - low) / (high - low)).alias("v")), grid.meta)
    pair = _blurred_pair(unit, sigma, sigma * k, 3.0)
    rows = pair.select(*grid.axes, ((F.col("n") - F.col("w")) / (k - 1)).alias("r"))
    top = rows.withColumn("m", F.col("r"))
    for a in grid.axes:
        top = top.withColumn("m", F.max("m").over(grid.along(a).rowsBetween(-1, 1)))
    for a in grid.axes:
        w = grid.along(a)
        before, after = F.lag("r", 1).over(w), F.lead("r", 1).over(w)
        curve = before + after - 2 * F.col("r")
        shift = F.when(curve != 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (before - after) / 2 / curve))).otherwise(0.0)
        top = top.withColumn(f"at_{a}", F.col(a) + shift)
    inner = F.lit(True)
    for a in grid.axes:
        inner = inner & (F.col(a) > 0) & (F.col(a) < grid.length(a) - 1)
    return top.where(inner & (F.col("r") == F.col("m")) & (F.col("r") >= threshold)).select(*grid.axes, *[f"at_{a}" for a in grid.axes], F.col("r").alias("response"))


def measure(labels: Grid) -> DataFrame:
    """For each label: voxels, volume, centroid and box, and whether it touches the array's faces."""
    size = prod(labels.meta.voxel_size)
    faces = F.lit(False)
    aggs = [F.count("*").alias("voxels"), (F.count("*") * float(size)).alias("volume")]
    for a in labels.axes:
        aggs += [F.avg(a).alias(f"mean_{a}"), F.min(a).alias(f"lo_{a}"), (F.max(a) + 1).alias(f"hi_{a}")]
        faces = faces | (F.col(a) == 0) | (F.col(a) == labels.length(a) - 1)
    return labels.df.where("v > 0").groupBy(F.col("v").alias("label")).agg(*aggs, F.max(faces.cast("int")).alias("touches"))
