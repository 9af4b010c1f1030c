"""Operators that look at neighbours, on dense grids.

One axis at a time, by window functions over its lines: a neighbour ``k`` away is ``lag`` or ``lead``, and past the edge
the first or the last voxel of the line again (or 0). That is exact at any radius, needs no join, and one shuffle an axis.
"""

from __future__ import annotations

from dataclasses import replace
from math import ceil, exp

from pyspark.sql import Column, Window, functions as F

from ..grid import Grid


def neighbour(grid: Grid, axis: str, k: int, value: str = "v", edge: str = "repeat") -> Column:
    """The value ``k`` voxels further along ``axis``; past the edge the edge's own, or 0."""
    if edge not in ("repeat", "zero"):
        raise ValueError("edge must be repeat or zero")
    if k == 0:
        return F.col(value)
    w = grid.along(axis)
    there = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
    if edge == "zero":
        return F.coalesce(there, F.lit(0.0))
    past = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(there, (F.first(value) if k < 0 else F.last(value)).over(past))


def weighted(grid: Grid, axis: str, weights: dict[int, float], edge: str = "repeat") -> Grid:
    """Sum of neighbours along one axis by weight."""
    total = sum((neighbour(grid, axis, k, edge=edge) * w for k, w in sorted(weights.items())), F.lit(0.0))
    return Grid(grid.df.select(*grid.axes, total.alias("v")), replace(grid.meta, dtype="float32", kind=None))


def gaussian_weights(sigma: float, truncate: float = 3.0) -> dict[int, float]:
    radius = int(truncate * sigma + 0.5)
    raw = {k: exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    return {k: w / sum(raw.values()) for k, w in raw.items()}


def _sigmas(grid: Grid, sigma) -> dict[str, float]:
    return dict(zip(grid.meta.spatial[-len(sigma) :], sigma, strict=True)) if isinstance(sigma, (tuple, list)) else {a: sigma for a in grid.meta.spatial}


def gaussian(grid: Grid, sigma=1.0, truncate: float = 3.0, edge: str = "repeat") -> Grid:
    """Separable Gaussian over the spatial axes."""
    for axis, s in _sigmas(grid, sigma).items():
        if s <= 0 or not 1 <= truncate <= 6:
            raise ValueError("sigma must be above 0 and truncate from 1 to 6")
        grid = weighted(grid, axis, gaussian_weights(s, truncate), edge)
    return grid


def uniform(grid: Grid, size: int = 3, edge: str = "repeat") -> Grid:
    """Mean over a box; an even size leans to the low side."""
    if not 1 <= size <= 31:
        raise ValueError("size must be from 1 to 31")
    for axis in grid.meta.spatial:
        grid = weighted(grid, axis, {k: 1 / size for k in range(-(size // 2), size - size // 2)}, edge)
    return grid


def diff(grid: Grid, axis: int | str = 0, lag: int = 1) -> Grid:
    """``v`` less the value ``lag`` steps before; the first steps less the first."""
    axis = grid.axes[axis] if isinstance(axis, int) else axis
    if not 1 <= lag <= 64:
        raise ValueError("lag must be from 1 to 64")
    return Grid(grid.df.select(*grid.axes, (F.col("v") - neighbour(grid, axis, -lag)).alias("v")), replace(grid.meta, dtype="float32", kind=None))


def gradient(grid: Grid, sigma: float = 0.0, axes: tuple[str, ...] | None = None) -> Grid:
    """Central differences by physical distance, a channel an axis on a new leading ``c``."""
    axes = tuple(axes or grid.axes[-3:])
    if len(set(axes)) != len(axes) or not 0 <= sigma <= 16:
        raise ValueError("axes must differ and sigma lie within 0 and 16")
    base = grid
    if sigma:
        for a in axes:
            base = weighted(base, a, gaussian_weights(sigma))
    steps = dict(zip(grid.axes, grid.meta.voxel_size, strict=True))
    slopes = [F.struct(F.lit(i).cast("long").alias("c"), ((neighbour(base, a, 1) - neighbour(base, a, -1)) / (2 * steps[a])).alias("v")) for i, a in enumerate(axes)]
    rows = base.df.select(*grid.axes, F.array(*slopes).alias("all")).select(*grid.axes, F.explode("all").alias("s"))
    return Grid(rows.select("s.c", *grid.axes, "s.v"), replace(grid.meta.with_leading("c", len(axes)), dtype="float32", kind=None))


def _blurred_pair(grid: Grid, sigma, wide, truncate: float):
    """Two Gaussians of one grid side by side: each axis' windows serve both."""
    cols = grid.df.select(*grid.axes, F.col("v").cast("double").alias("v"), F.col("v").cast("double").alias("n"), F.col("v").cast("double").alias("w"))
    for axis, s in _sigmas(grid, sigma).items():
        g = Grid(cols, grid.meta)
        near = sum((neighbour(g, axis, k, "n") * x for k, x in sorted(gaussian_weights(s, truncate).items())), F.lit(0.0))
        far = sum((neighbour(g, axis, k, "w") * x for k, x in sorted(gaussian_weights(_sigmas(grid, wide)[axis], truncate).items())), F.lit(0.0))
        cols = cols.select(*grid.axes, "v", near.alias("n"), far.alias("w"))
    return cols


def dog(grid: Grid, sigma: float = 2.0, ratio: float = 1.6, gain: float = 4.0, truncate: float = 4.0) -> Grid:
    """Difference of Gaussians, times ``gain`` on 128, within 0 and 255, fractions cut off."""
    if sigma <= 0 or not 1 < ratio <= 4 or gain <= 0:
        raise ValueError("sigma and gain must be above 0, ratio above 1 and at most 4")
    cols = _blurred_pair(grid, sigma, sigma * ratio, truncate)
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("n") - F.col("w")) * gain + 128))
    return Grid(cols.select(*grid.axes, v.cast("long").alias("v")), replace(grid.meta, dtype="uint8", kind=None))


def _slopes(grid: Grid, z_factor: float):
    if z_factor <= 0:
        raise ValueError("z_factor must be above 0")
    y, x = grid.axes[-2:]
    sy, sx = grid.meta.voxel_size[-2:]
    rise = lambda a, s: (neighbour(grid, a, 1) - neighbour(grid, a, -1)) * (z_factor / (2 * s))
    return rise(y, sy), rise(x, sx)


def slope(grid: Grid, z_factor: float = 1.0) -> Grid:
    """Steepness in degrees over the last two axes, by physical distance."""
    dy, dx = _slopes(grid, z_factor)
    return Grid(grid.df.select(*grid.axes, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("v")), replace(grid.meta, dtype="float32", kind=None))


def hillshade(grid: Grid, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> Grid:
    """Light from ``azimuth`` and ``altitude`` (degrees): 1 to 255, 0 where not finite. Rows run south."""
    from math import cos, radians, sin

    if not 0 <= azimuth <= 360 or not 0 < altitude <= 90:
        raise ValueError("azimuth must be from 0 to 360, altitude above 0 and at most 90")
    dy, dx = _slopes(grid, z_factor)
    up, side = radians(altitude), radians(azimuth)
    east, north = sin(side) * cos(up), cos(side) * cos(up)
    rows = grid.df.select(*grid.axes, dy.alias("dy"), dx.alias("dx"))
    # the surface's normal is (-dx, north of it dy, 1); light and normal multiply
    lit = (F.lit(sin(up)) - F.col("dx") * east + F.col("dy") * north) / F.sqrt(F.lit(1.0) + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    v = F.when(F.isnan(lit) | lit.isNull(), F.lit(0)).otherwise(F.rint(F.greatest(F.lit(0.0), lit) * 254 + 1))
    return Grid(rows.select(*grid.axes, v.cast("long").alias("v")), replace(grid.meta, dtype="uint8", kind=None))


def extreme(grid: Grid, size: int, largest: bool = True, edge: str = "repeat") -> Grid:
    """Largest (or smallest) over a box of an odd size; for extremes a frame that ends at the edge is exact."""
    half = size // 2
    for axis in grid.meta.spatial:
        w = grid.along(axis).rowsBetween(-half, half)
        v = (F.max if largest else F.min)("v").over(w)
        if edge == "zero":
            inner = (F.col(axis) >= half) & (F.col(axis) < grid.length(axis) - half)
            v = F.when(inner, v).otherwise(F.greatest(v, F.lit(0)) if largest else F.least(v, F.lit(0)))
        grid = Grid(grid.df.select(*grid.axes, v.alias("v")), grid.meta)
    return grid


def box_mean(grid: Grid, window: int) -> Grid:
    """Mean over a box that shrinks at the edges."""
    for axis in grid.meta.spatial:
        w = grid.along(axis).rowsBetween(-(window // 2), window // 2)
        grid = Grid(grid.df.select(*grid.axes, F.avg("v").over(w).alias("v")), grid.meta)
    return grid


def local_maxima(grid: Grid, separation: int = 1, least: float | None = None) -> Grid:
    """Voxels that are the largest of their box; all of a plateau are."""
    top = grid.df.select(*grid.axes, "v", F.col("v").alias("own"))
    for axis in grid.meta.spatial:
        w = grid.along(axis).rowsBetween(-separation, separation)
        top = top.select(*grid.axes, F.max("v").over(w).alias("v"), "own")
    hit = F.col("own") == F.col("v")
    if least is not None:
        hit = hit & (F.col("own") >= least)
    return Grid(top.select(*grid.axes, hit.cast("long").alias("v")), replace(grid.meta, dtype="uint8", kind="mask"))


def ball(axes: tuple[str, ...], radius: float, spacing: dict[str, float] | None = None) -> list[tuple[int, ...]]:
    """Offsets within ``radius`` of the middle."""
    r = ceil(radius)
    out: list[tuple[int, ...]] = [()]
    for _ in axes:
        out = [(*o, k) for o in out for k in range(-r, r + 1)]
    return sorted(o for o in out if sum(k * k for k in o) <= radius * radius)


def dilate(grid: Grid, radius: float = 2) -> Grid:
    """Voxels within ``radius`` of a mask.

    Each set voxel is sent to its ball, and what arrives is counted by voxel before it is shuffled.
    """
    axes = grid.meta.spatial
    rest = [a for a in grid.axes if a not in axes]
    balls = ball(axes, radius)
    spread = F.explode(F.array(*[F.struct(*[F.lit(k).cast("long").alias(a) for a, k in zip(axes, o, strict=True)]) for o in balls])).alias("o")
    sent = grid.df.where("v > 0").select(*rest, *axes, spread)
    moved = sent.select(*rest, *[(F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes])
    for a in axes:
        moved = moved.where((F.col(a) >= 0) & (F.col(a) < grid.length(a)))
    hit = moved.withColumn("v", F.lit(1))
    both = grid.df.select(*grid.axes, F.lit(0).alias("v")).unionByName(hit)
    return Grid(both.groupBy(*grid.axes).agg(F.max("v").cast("long").alias("v")), replace(grid.meta, dtype="uint8", kind="mask"))


def erode(grid: Grid, radius: float = 2) -> Grid:
    """Voxels of a mask no voxel outside it is within ``radius`` of; past the edge the edge repeats."""
    turned = grid.map((F.col("v") <= 0).cast("long"))
    out = dilate(turned, radius)
    return Grid(out.df.select(*grid.axes, (F.lit(1) - F.col("v")).alias("v")), out.meta)


def morphology(grid: Grid, operation: str = "open", radius: int = 2) -> Grid:
    """Binary opening, closing, erosion or dilation with a ball."""
    if not 1 <= radius <= 16:
        raise ValueError("radius must be from 1 to 16")
    steps = {"erode": (erode,), "dilate": (dilate,), "open": (erode, dilate), "close": (dilate, erode)}
    if operation not in steps:
        raise ValueError(f"operation must be one of {sorted(steps)}")
    for step in steps[operation]:
        grid = step(grid, radius)
    return grid
