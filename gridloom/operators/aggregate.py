"""Operators that bring many voxels to one: partial sums on the map side, then one shuffle."""

from __future__ import annotations

from dataclasses import replace
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..grid import Grid
from ..storage import stored


def _factors(grid: Grid, factor) -> dict[str, int]:
    factor = [factor] * len(grid.meta.spatial) if isinstance(factor, int) else list(factor)
    if len(factor) > len(grid.axes) or any(f < 1 for f in factor):
        raise ValueError("factors must be 1 or more, one an axis at most")
    return dict(zip(grid.axes[-len(factor) :], factor, strict=True))


def _coarser(grid: Grid, factors: dict[str, int], **changes):
    m = grid.meta
    by = [factors.get(a, 1) for a in m.axes]
    size = tuple(v * f for v, f in zip(m.voxel_size, by, strict=True))
    moved = tuple(t + (b - a) / 2 for t, a, b in zip(m.translation, m.voxel_size, size, strict=True))
    shape = tuple(-(-n // f) for n, f in zip(m.shape, by, strict=True))
    return replace(m, shape=shape, voxel_size=size, translation=moved, chunk=tuple(min(c, n) for c, n in zip(m.chunk, shape, strict=True)), **changes)


def _blocks(grid: Grid, factors: dict[str, int]) -> list[Column]:
    return [F.floor(F.col(a) / factors.get(a, 1)).cast("long").alias(f"b_{a}") for a in grid.axes]


def _edge_weight(grid: Grid, factors: dict[str, int]) -> Column:
    """How often a voxel counts when the last block repeats its edge."""
    out = F.lit(1)
    for a, f in factors.items():
        n = grid.length(a)
        out = out * F.when(F.col(a) == n - 1, F.lit(1 + (-n) % f)).otherwise(1)
    return out


def downsample(grid: Grid, factor, mode: str = "auto") -> Grid:
    """Blocks of ``factor`` voxels: their mean, or their commonest value (labels and masks, unless told otherwise).

    The last block repeats its edge. Integer means round half to even; of values equally common the first in row order wins.
    """
    if mode not in ("auto", "mean", "mode"):
        raise ValueError("mode must be auto, mean or mode")
    if mode == "auto":
        mode = "mode" if grid.meta.kind in ("label", "mask") else "mean"
    factors = _factors(grid, factor)
    weight = _edge_weight(grid, factors)
    names = [F.col(f"b_{a}").alias(a) for a in grid.axes]
    keys = [f"b_{a}" for a in grid.axes]
    if mode == "mean":
        rows = grid.df.select(*_blocks(grid, factors), (F.col("v") * weight).alias("wv"), weight.alias("w"))
        mean = F.sum("wv") / F.sum("w")
        v = F.rint(mean).cast("long") if "int" in grid.meta.dtype else mean
        return Grid(rows.groupBy(*keys).agg(v.alias("v")).select(*names, "v"), _coarser(grid, factors))
    place = F.lit(0).cast("long")
    for a in grid.axes:
        place = place * factors.get(a, 1) + F.col(a) % factors.get(a, 1)
    rows = grid.df.select(*_blocks(grid, factors), "v", weight.alias("w"), place.alias("p"))
    counted = rows.groupBy(*keys, "v").agg(F.sum("w").alias("n"), F.min("p").alias("p"))
    best = counted.groupBy(*keys).agg(F.max_by("v", F.struct("n", (-F.col("p")).alias("q"))).alias("v"))
    return Grid(best.select(*names, "v"), _coarser(grid, factors))


def halve(grid: Grid) -> Grid:
    """Means of 2 along every axis; a last voxel without partner stays as it is."""
    factors = {a: 2 for a in grid.axes}
    rows = grid.df.select(*_blocks(grid, factors), "v").groupBy(*[f"b_{a}" for a in grid.axes]).agg(F.avg("v").alias("v"))
    return Grid(rows.select(*[F.col(f"b_{a}").alias(a) for a in grid.axes], "v"), _coarser(grid, factors, dtype="float32"))


def pyramid(grid: Grid, levels: int, factor=2) -> list[Grid]:
    """The array and its coarser levels."""
    out = [grid]
    for _ in range(levels - 1):
        out.append(downsample(out[-1], factor))
    return out


def chunk_summary(grid: Grid) -> DataFrame:
    """For each chunk: whether any voxel is not 0, voxels, and sum; what decides which chunks are written."""
    ids = [F.floor(F.col(a) / c).cast("long").alias(f"chunk_{a}") for a, c in zip(grid.axes, grid.meta.chunk, strict=True)]
    rows = grid.df.select(*ids, "v")
    return rows.groupBy(*[f"chunk_{a}" for a in grid.axes]).agg(F.max((F.col("v") != 0).cast("int")).alias("filled"), F.count("*").alias("voxels"), F.sum("v").alias("total"))


def percentile_range(grid: Grid, low: float = 0.5, high: float = 99.5) -> DataFrame:
    """Contrast limits: exact percentiles, linear between values; null for an array without values.

    Values are counted, and the counts dealt out in order; a number a partition tells which partitions hold the ranks that are asked for, and only there a running sum is made.
    """
    spark = grid.df.sparkSession
    counts = grid.df.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    dealt = stored(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "counts")
    totals = dict(sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()))
    ahead, whole = {}, 0
    for part, n in totals.items():
        ahead[part], whole = whole, whole + n
    asked = [p / 100 * (whole - 1) for p in (low, high)]
    ranks = sorted({r for p in asked for r in (floor(p), ceil(p))}) if whole else []
    parts = {max(p for p in ahead if ahead[p] <= r) for r in ranks}
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    known = spark.createDataFrame([(p, ahead[p]) for p in parts], "part int, ahead long")
    rows = dealt.where(F.col("part").isin(sorted(parts))).withColumn("upto", upto).join(F.broadcast(known), "part") if parts else None
    found: dict[int, float | None] = dict.fromkeys(ranks)
    if rows is not None:
        wanted = F.array(*[F.lit(r).cast("long") for r in ranks])
        stop, start = F.col("ahead") + F.col("upto"), F.col("ahead") + F.col("upto") - F.col("n")
        for row in rows.select("v", F.explode(F.filter(wanted, lambda r: (r >= start) & (r < stop))).alias("rank")).collect():
            found[row["rank"]] = float(row["v"])
    at = [None if not whole else found[floor(p)] + (found[ceil(p)] - found[floor(p)]) * (p - floor(p)) for p in asked]
    return spark.createDataFrame([tuple(at)], "low double, high double")


def intensity_moments(grid: Grid, floor_percent: float = 20.0) -> DataFrame:
    """Centroid and covariance, weighted by value, of voxels above a percentile of those not 0."""
    cut = grid.df.where("v != 0").agg(F.expr(f"percentile(v, {floor_percent / 100})").alias("cut"))
    rows = grid.df.join(F.broadcast(cut)).where("v > cut")  # the cut is one row
    aggs = [F.sum("v").alias("mass")]
    for i, a in enumerate(grid.axes):
        aggs.append((F.sum(F.col("v") * F.col(a)) / F.sum("v")).alias(f"mean_{a}"))
        for b in grid.axes[i:]:
            mean = F.sum(F.col("v") * F.col(a)) / F.sum("v") * (F.sum(F.col("v") * F.col(b)) / F.sum("v"))
            aggs.append((F.sum(F.col("v") * F.col(a) * F.col(b)) / F.sum("v") - mean).alias(f"cov_{a}{b}"))
    return rows.agg(*aggs)


def ncc(a: Grid, b: Grid) -> DataFrame:
    """Normalized cross-correlation of two arrays on one grid."""
    both = a.df.join(b.df.withColumnRenamed("v", "w"), list(a.axes))
    return both.agg(F.corr("v", "w").alias("ncc"))


def lncc(a: Grid, b: Grid, window: int = 5) -> DataFrame:
    """Mean squared local correlation over windows that are flat in neither array.

    All five moments share each axis' windows, so the pair is shuffled once an axis.
    """
    cols = a.df.join(b.df.withColumnRenamed("v", "w"), list(a.axes))
    cols = cols.select(*a.axes, "v", "w", (F.col("v") * F.col("v")).alias("vv"), (F.col("w") * F.col("w")).alias("ww"), (F.col("v") * F.col("w")).alias("vw"))
    for axis in a.meta.spatial:
        over = a.along(axis).rowsBetween(-(window // 2), window // 2)
        cols = cols.select(*a.axes, *[F.avg(c).over(over).alias(c) for c in ("v", "w", "vv", "ww", "vw")])
    var_v, var_w = F.col("vv") - F.col("v") * F.col("v"), F.col("ww") - F.col("w") * F.col("w")
    cov = F.col("vw") - F.col("v") * F.col("w")
    kept = cols.select(var_v.alias("a"), var_w.alias("b"), cov.alias("c")).where("a > 1e-9 and b > 1e-9")
    return kept.agg(F.avg(F.col("c") * F.col("c") / (F.col("a") * F.col("b"))).alias("lncc"), F.count("*").alias("windows"))


def rms_distance(pairs: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Root mean square of ``q_axis - p_axis``, centred over all pairs."""
    means = pairs.agg(*[F.avg(F.col(f"q_{a}") - F.col(f"p_{a}")).alias(f"m_{a}") for a in axes])
    off = sum(((F.col(f"q_{a}") - F.col(f"p_{a}") - F.col(f"m_{a}")) ** 2 for a in axes), F.lit(0.0))
    return pairs.join(F.broadcast(means)).agg(F.sqrt(F.avg(off)).alias("rms"))  # the means are one row
