"""Operators that look at one voxel: projections, no shuffle, all inside one stage of generated code."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..grid import Grid

#: Range of each integer type.
RANGES = {f"{u}int{b}": ((0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1)) for u in ("", "u") for b in (8, 16, 32, 64)}


def threshold(grid: Grid, low: float, high: float | None = None, value: int = 1) -> Grid:
    """``value`` where ``low <= v`` (and ``v < high``), else 0: a mask. NaN is outside."""
    if not 1 <= value <= 255:
        raise ValueError("value must be from 1 to 255")
    v = F.col("v")
    inside = ~F.isnan(v) & (v >= low)
    if high is not None:
        inside = inside & (v < high)
    return grid.map(F.when(inside, F.lit(value)).otherwise(0).cast("long"), "uint8", "mask")


def cast(grid: Grid, dtype: str, clip: bool = True) -> Grid:
    """Another type: clipped to an integer type's range, fractions cut off. Keeps the kind."""
    if dtype not in RANGES and dtype not in ("float32", "float64"):
        raise ValueError(f"unknown type {dtype}")
    v = F.col("v")
    if dtype in RANGES:
        lo, hi = RANGES[dtype]
        if clip:
            v = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))
        v = v.cast("long")
    elif dtype == "float32":
        v = v.cast("float").cast("double")
    return Grid(grid.df.select(*grid.axes, v.alias("v")), replace(grid.meta, dtype=dtype))


def scale(grid: Grid, factor: float, offset: float = 0.0) -> Grid:
    """``v * factor + offset``."""
    return grid.map(F.col("v") * factor + offset, "float64")


def normalize(grid: Grid, low: float, high: float) -> Grid:
    """``(v - low) / (high - low)``, kept within 0 and 1."""
    return grid.map(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - low) / (high - low))), "float64")


def nodata(grid: Grid, value: float) -> Grid:
    """NaN where a stored value stands for nothing."""
    return grid.map(F.when(F.col("v") == value, F.lit(float("nan"))).otherwise(F.col("v")))


def decode_packed(grid: Grid, factor: float, offset: float, missing: float | None = None) -> Grid:
    """Packed numbers: ``stored * factor + offset``, NaN where missing."""
    v = F.col("v") * factor + offset
    return grid.map(v if missing is None else F.when(F.col("v") == missing, F.lit(float("nan"))).otherwise(v), "float32")
