"""Operators that change axes, levels and extents, and those that put arrays together."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..geometry.resample import resample
from ..grid import Grid
from ..meta import ArrayMeta, same_grid


def select(grid: Grid, pins: dict[str, int]) -> Grid:
    """Pin axes that are not spatial, and drop them."""
    meta, df = grid.meta, grid.df
    for axis, i in pins.items():
        if axis not in meta.axes:
            raise ValueError(f"no axis {axis}")
        if axis in meta.spatial:
            raise ValueError(f"{axis} is spatial and can't be pinned")
        if not 0 <= i < meta.shape[meta.axes.index(axis)]:
            raise ValueError(f"{axis} has no index {i}")
        df, meta = df.where(F.col(axis) == i).drop(axis), meta.without(axis)
    return Grid(df, meta)


def keep_levels(levels: list[Grid], kept: list[int]) -> list[Grid]:
    """Levels by number, finest first."""
    if len(set(kept)) != len(kept) or sorted(kept) != list(kept) or not all(0 <= i < len(levels) for i in kept):
        raise ValueError("levels must be distinct, ascending and there")
    return [levels[i] for i in kept]


def flip(grid: Grid, axes: list[str]) -> Grid:
    """Mirror: index ``i`` becomes ``n - 1 - i``."""
    if unknown := [a for a in axes if a not in grid.axes]:
        raise ValueError(f"no axis {unknown[0]}")
    cols = [(F.lit(grid.length(a) - 1) - F.col(a)).alias(a) if a in axes else F.col(a) for a in grid.axes]
    return Grid(grid.df.select(*cols, "v"), grid.meta)


def transpose(grid: Grid, order: list[str]) -> Grid:
    """Axes in another order."""
    if sorted(order) != sorted(grid.axes):
        raise ValueError("the order must name every axis once")
    at = [grid.axes.index(a) for a in order]
    pick = lambda t: tuple(t[i] for i in at)
    m = grid.meta
    return Grid(grid.df.select(*order, "v"), replace(m, axes=tuple(order), shape=pick(m.shape), chunk=pick(m.chunk), voxel_size=pick(m.voxel_size), units=pick(m.units), translation=pick(m.translation)))


def stack(grids: list[Grid], axis: str = "c") -> Grid:
    """Arrays on one grid as channels, types promoted: a union, the channel a literal that scans prune by."""
    if len(grids) < 2:
        raise ValueError("a stack needs two arrays or more")
    first = grids[0].meta
    for g in grids[1:]:
        if g.axes != first.axes or g.meta.units != first.units:
            raise ValueError("arrays of a stack need the same axes and units")
        if not same_grid(first, g.meta):
            raise ValueError("arrays of a stack need the same grid; resample first")
    parts = [g.df.select(F.lit(i).cast("long").alias(axis), *first.axes, F.col("v").cast("double").alias("v")) for i, g in enumerate(grids)]
    kinds = {g.meta.kind for g in grids}
    meta = replace(first.with_leading(axis, len(grids)), kind=kinds.pop() if len(kinds) == 1 else None)
    return Grid(reduce(lambda a, b: a.unionByName(b), parts), meta)


def stack_onto(grids: list[Grid], axis: str = "c") -> Grid:
    """Arrays on any grids as channels of the first one's: the others are sampled at the middles of its voxels, 0 outside of them.

    Labels and masks are sampled by the nearest voxel, the rest linearly.
    """
    first = grids[0].meta
    return stack([g if same_grid(first, g.meta) else resample(g, first) for g in grids], axis)


def frames(grids: list[Grid]) -> Grid:
    """Arrays as the steps of a new leading time axis."""
    return stack(grids, "t")


def rechunk(grid: Grid, chunk: tuple[int, ...]) -> Grid:
    """The same voxels, each with the chunk that holds it (``chunk_<axis>``), dealt out by chunk."""
    chunk = (*grid.meta.chunk[: len(grid.axes) - len(chunk)], *chunk)
    ids = [F.floor(F.col(a) / c).cast("long").alias(f"chunk_{a}") for a, c in zip(grid.axes, chunk, strict=True)]
    return Grid(grid.df.select(*grid.axes, *ids, "v"), replace(grid.meta, chunk=chunk))
