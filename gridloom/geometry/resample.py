"""Arrays seen through a transform: output voxels look up input voxels.

Each output voxel becomes the corners that it is interpolated from, corners meet the input by an equi-join on
coordinates, and weighted sums bring them back: three relational steps, whatever the transform is.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..grid import Grid
from ..meta import ArrayMeta, same_grid
from ..operators.aggregate import downsample
from .transforms import Affine, Sequence, Transform


def voxel_to_world(meta: ArrayMeta) -> Affine:
    return Affine.scale_translation(meta.voxel_size, meta.translation)


def resample(source: Grid, target: ArrayMeta, backward: Transform | None = None, order: int | None = None, targets=None) -> Grid:
    """``source`` on the grid of ``target``; ``backward`` takes points of the target's world to the source's.

    Order 1 is linear with the edge repeated, order 0 nearest (labels and masks, unless told otherwise). Points outside the
    source, half a voxel past its centres, are 0; whole numbers are rounded half to even.
    """
    order = (0 if source.meta.kind in ("label", "mask") else 1) if order is None else order
    spark = source.df.sparkSession
    n_voxels = 1
    for n in target.shape:
        n_voxels *= n
    if targets is None:
        step, cols = n_voxels, []
        for a, n in zip(target.axes, target.shape, strict=True):
            step //= n
            cols.append((F.floor(F.col("id") / step) % n).cast("long").alias(a))
        targets = spark.range(n_voxels).select(*cols)
    chain: list[Transform] = [voxel_to_world(target)]
    if backward is not None:
        chain.append(backward)
    chain.append(voxel_to_world(source.meta).inverse())
    points = Sequence(tuple(chain)).apply(targets.select(*target.axes, *[F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate(target.axes)]))
    inside = F.lit(True)
    for i, n in enumerate(source.meta.shape):
        inside = inside & (F.col(f"p{i}") >= -0.5) & (F.col(f"p{i}") < n - 0.5) & ~F.isnan(f"p{i}")
    dims = range(len(source.axes))
    corners = []
    for k in range(1 << len(source.axes) if order else 1):
        parts, weight = [], F.lit(1.0)
        for i in dims:
            n, c = source.meta.shape[i], F.col(f"p{i}")
            low = F.floor(c) if order else F.floor(c + 0.5)
            up = k >> i & 1
            parts.append(F.greatest(F.lit(0), F.least(F.lit(n - 1), low + up)).cast("long").alias(f"s{i}"))
            if order:
                weight = weight * ((c - low) if up else (F.lit(1.0) - (c - low)))
        corners.append(F.struct(*parts, weight.alias("w")))
    spread = points.where(inside).select(*target.axes, F.explode(F.array(*corners)).alias("k")).select(*target.axes, "k.*").where("w != 0")
    values = source.df.select(*[F.col(a).alias(f"s{i}") for i, a in enumerate(source.axes)], F.col("v").alias("sv"))
    met = spread.join(values, [f"s{i}" for i in dims]).select(*target.axes, (F.col("w") * F.col("sv")).alias("v"))
    both = met.unionByName(targets.select(*target.axes, F.lit(0.0).alias("v")))
    total = F.sum("v")
    v = F.rint(total).cast("long") if "int" in source.meta.dtype else total
    return Grid(both.groupBy(*target.axes).agg(v.alias("v")), replace(target, dtype=source.meta.dtype, kind=source.meta.kind))


def at_voxel_size(grid: Grid, voxel_size: tuple[float, ...]) -> Grid:
    """The same extent in other voxels, sizes given for the last axes.

    Where an axis shrinks by a whole number, voxels are means of blocks (the last repeats its edge); the rest is linear. Labels and
    masks take the nearest voxel.
    """
    m = grid.meta
    size = (*m.voxel_size[: len(m.axes) - len(voxel_size)], *voxel_size)
    target = m.rescaled(size)
    by = [b / a for a, b in zip(m.voxel_size, size, strict=True)]
    whole = [round(r) if r > 1.5 and abs(r - round(r)) < 1e-6 else 1 for r in by]
    if m.kind not in ("label", "mask") and any(f > 1 for f in whole):
        grid = downsample(grid, whole, "mean")
    return grid if same_grid(grid.meta, target) else resample(grid, target)


def field_of(transform: Transform, target: ArrayMeta, spark, axis: str = "c") -> Grid:
    """A transform's displacements on a grid, a channel a component on a new leading axis."""
    n_voxels = 1
    for n in target.shape:
        n_voxels *= n
    step, cols = n_voxels, []
    for a, n in zip(target.axes, target.shape, strict=True):
        step //= n
        cols.append((F.floor(F.col("id") / step) % n).cast("long").alias(a))
    world = [(F.col(a) * s + t).alias(f"p{i}") for i, (a, s, t) in enumerate(zip(target.axes, target.voxel_size, target.translation, strict=True))]
    points = spark.range(n_voxels).select(*cols).select(*target.axes, *world)
    held = points.select("*", *[F.col(f"p{i}").alias(f"from{i}") for i in range(len(target.axes))])
    moved = transform.apply(held)
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias(axis), (F.col(f"p{i}") - F.col(f"from{i}")).alias("v")) for i in range(transform.n_out)])
    rows = moved.select(*target.axes, F.explode(parts).alias("s")).select(f"s.{axis}", *target.axes, "s.v")
    return Grid(rows, replace(target.with_leading(axis, transform.n_out), dtype="float32", kind=None))
