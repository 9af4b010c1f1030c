"""Overlapping blocks, blended by weight."""

from __future__ import annotations

from dataclasses import replace
from math import prod

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import ramp, tent
from ..grid import Grid
from ..meta import Box


def to_blocks(grid: Grid, overlap: int) -> DataFrame:
    """Every voxel with each block (its chunk grown by ``overlap``) that holds it: ``b_<axis>``, coordinates, ``v``.

    A voxel's blocks are a range of chunk indices on each axis, so copies are made by ``explode`` in generated code and
    no voxel meets a block that doesn't hold it.
    """
    df = grid.df
    for a, c, n in zip(grid.axes, grid.meta.chunk, grid.meta.shape, strict=True):
        last = -(-n // c) - 1
        lo = F.greatest(F.lit(0), F.floor((F.col(a) - overlap) / c))
        hi = F.least(F.lit(last), F.floor((F.col(a) + overlap) / c))
        df = df.withColumn(f"b_{a}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    return df


def blend(grid: Grid, overlap: int, shape: str = "tent", value=None) -> Grid:
    """Weighted mean of ``value`` (a function of the blocked table, giving column ``v`` for each block's voxel) over blocks."""
    if shape not in ("tent", "ramp"):
        raise ValueError("blend must be tent or ramp")
    blocks = to_blocks(grid, overlap)
    if value is not None:
        blocks = value(blocks)
    weight = F.lit(1.0)
    for a, c, n in zip(grid.axes, grid.meta.chunk, grid.meta.shape, strict=True):
        start = F.col(f"b_{a}") * c
        stop = F.least(F.lit(n), start + c)
        if shape == "tent":
            weight = weight * tent(F.col(a), start, stop, overlap)
        else:
            weight = weight * ramp(F.col(a), F.greatest(F.lit(0), start - overlap), F.least(F.lit(n), stop + overlap))
    rows = blocks.select(*grid.axes, (F.col("v") * weight).alias("wv"), weight.alias("w"))
    mean = F.sum("wv") / F.sum("w")
    return Grid(rows.groupBy(*grid.axes).agg((F.rint(mean) if "int" in grid.meta.dtype else mean).alias("v")), replace(grid.meta, kind=None))


def in_blocks(grid: Grid, kernel, halo: int, edge: str = "repeat", dtype: str = "float64") -> Grid:
    """Run ``kernel`` (a dense block in, a block of the same shape out) on each chunk with ``halo`` voxels around it.

    For what expressions can't say: chunks are gathered with their halo by one shuffle and handed over as numpy arrays, a
    chunk at a time. Past the array's edge the edge repeats, or zeros stand.
    """
    import numpy as np
    import pandas as pd

    axes, chunk, n = grid.axes, grid.meta.chunk, grid.meta.shape
    if prod(c + 2 * halo for c in chunk) > 1 << 28:
        raise MemoryError("a chunk with its halo would have over 2**28 voxels: take smaller chunks")
    keys = [f"b_{a}" for a in axes]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = Box.of_chunk(tuple(int(part[k].iloc[0]) for k in keys), chunk, n)
        held = own.pad((halo,) * len(axes)).clip(n)
        block = np.zeros(held.shape)
        block[tuple(part[a].to_numpy() - s for a, s in zip(axes, held.start, strict=True))] = part["v"].to_numpy()
        wide = [(s - (o - halo), (p + halo) - t) for o, p, s, t in zip(own.start, own.stop, held.start, held.stop, strict=True)]
        block = np.pad(block, wide, mode="edge" if edge == "repeat" else "constant")
        out = np.asarray(kernel(block))
        if out.shape != block.shape:
            raise ValueError(f"the kernel made {out.shape} of {block.shape}")
        inner = out[tuple(slice(halo, s - halo) for s in out.shape)]
        at = np.indices(inner.shape).reshape(len(axes), -1)
        return pd.DataFrame({a: at[i] + s for i, (a, s) in enumerate(zip(axes, own.start, strict=True))} | {"v": inner.ravel().astype(float)})

    rows = to_blocks(grid, halo).select(*keys, *axes, F.col("v").cast("double").alias("v"))
    df = rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{a} long" for a in axes) + ", v double")
    return Grid(df, replace(grid.meta, dtype=dtype, kind=None))
