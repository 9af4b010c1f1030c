"""Operators over several channels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..grid import Grid
from .stencil import dilate

NAN = float("nan")


def channels(grid: Grid, picked: list[int], axis: str = "c"):
    """Channels of an array side by side, as columns ``c<i>``: one aggregation, no join."""
    n = grid.length(axis)
    if axis not in grid.axes or not all(0 <= i < n for i in picked):
        raise ValueError(f"channels {picked} aren't there")
    rest = [a for a in grid.axes if a != axis]
    rows = grid.df.where(F.col(axis).isin(list(set(picked))))
    return rows.groupBy(*rest).agg(*[F.max(F.when(F.col(axis) == i, F.col("v"))).alias(f"c{i}") for i in dict.fromkeys(picked)])


def normalized_difference(grid: Grid, pair: tuple[int, int], minus: tuple[int, int] | None = None, offset: float = 0.0, nodata: float | None = None, floor: float = 0.0, axis: str = "c") -> Grid:
    """``(a - b) / (a + b)`` of two channels, less that of another pair; NaN where a channel is not above 0, missing, or their sum is below ``floor``."""
    if len(pair) != 2 or (minus is not None and len(minus) != 2) or floor < 0:
        raise ValueError("pairs hold two channels and floor is 0 or more")

    def of(p):
        a, b = (F.col(f"c{i}") + offset for i in p)
        bad = (a <= 0) | (b <= 0) | (a + b < floor)
        if nodata is not None:
            bad = bad | (F.col(f"c{p[0]}") == nodata) | (F.col(f"c{p[1]}") == nodata)
        return F.when(bad, F.lit(NAN)).otherwise((a - b) / (a + b))

    v = of(pair) - of(minus) if minus else of(pair)
    side = channels(grid, [*pair, *(minus or ())], axis)
    meta = grid.meta.without(axis)
    return Grid(side.select(*meta.axes, v.alias("v")), replace(meta, dtype="float32", kind=None))


def contacts(grid: Grid, radius: float = 3.0, distance: float | None = None, a_low: float = 128, b_low: float = 128, axis: str = "c") -> Grid:
    """Voxels within ``radius`` of both channels' masks; ``distance`` is physical, by the finest spatial voxel size."""
    if axis not in grid.axes or grid.length(axis) < 2:
        raise ValueError("contacts need two channels")
    if distance is not None:
        sizes = dict(zip(grid.axes, grid.meta.voxel_size, strict=True))
        radius = distance / min(sizes[a] for a in grid.meta.spatial)
    if not 0 < radius <= 32:
        raise ValueError("radius must be above 0 and at most 32")
    low = F.when(F.col(axis) == 0, F.lit(float(a_low))).otherwise(F.lit(float(b_low)))
    both = grid.df.where(F.col(axis) < 2)
    masks = Grid(both.select(*grid.axes, (F.col("v") >= low).cast("long").alias("v")), grid.meta)
    near = dilate(masks, radius)
    rest = [a for a in grid.axes if a != axis]
    hit = near.df.groupBy(*rest).agg(F.min("v").cast("long").alias("v"))
    return Grid(hit, replace(grid.meta.without(axis), dtype="uint8", kind="mask"))
