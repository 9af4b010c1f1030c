"""Deformable registration: a displacement field that brings a moving image onto a fixed one.

The field ``u`` is held on a control lattice over the fixed image; the moving image is seen at ``affine(p + u(p))``. Gradient steps raise the squared
local correlation of the two less a penalty on the field's gradient, level by level, coarse to fine. An image is never whole in one place: it is
dealt out in blocks, each with the voxels that its correlation windows reach and the part of the moving image that it looks at. A step is one Spark
job: each task adds up what its blocks say of the lattice points that they reach, by the hand-derived adjoint of sampling, windows and correlation,
and the sums by point, a table of the lattice's size, come to the driver, where the step is made.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import tent
from ..geometry.resample import resample
from ..geometry.transforms import Affine, Field, Sequence
from ..grid import Grid
from ..meta import ArrayMeta, Box
from ..storage import stored

#: Windows whose intensities, from 0 to 1, vary less than this (as a variance) in either image say nothing.
FLAT = 1e-4
#: A lattice has so many points at most: it is sent to every task, and its gradient to the driver, at each step.
LATTICE_POINTS = 4_000_000
#: Levels that are fitted whole have so many voxels at most, and so many on each axis at least.
LEVEL_VOXELS = 1 << 25
LEVEL_LEAST = 16


@dataclass(frozen=True)
class Fit:
    """Steps and correlation window of each level (one for all, or one a level, coarse to fine), and what holds for all of them.

    ``spacing`` of control points and length of a ``step`` are in voxels of a level; ``block`` is how many voxels a block has on each axis.
    """

    steps: tuple[int, ...] = (100,)
    window: tuple[int, ...] = (7,)
    spacing: float = 4.0
    smooth: float = 1.0
    step: float = 0.5
    block: int = 64

    def __post_init__(self):
        if any(w < 1 or w % 2 == 0 for w in self.window):
            raise ValueError("windows are odd")

    def of(self, levels: int) -> list[tuple[int, int]]:
        """(steps, window) of each level."""
        given = [x * levels if len(x) == 1 else x for x in (self.steps, self.window)]
        if any(len(x) != levels for x in given):
            raise ValueError(f"steps and windows are one for all or one for each of {levels} levels")
        return list(zip(*given, strict=True))


@dataclass(frozen=True)
class Lattice:
    """Displacements at control points that span ``low`` to ``high`` evenly: ``values`` of shape (*points, axes)."""

    values: np.ndarray
    low: tuple[float, ...]
    high: tuple[float, ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return self.values.shape[:-1]

    @property
    def spacing(self) -> np.ndarray:
        return (np.array(self.high) - self.low) / (np.array(self.shape) - 1)

    def refined(self, shape: tuple[int, ...]) -> Lattice:
        """The same field at other control points, by linear interpolation."""
        out = self.values
        for a, n in enumerate(shape):
            out = np.moveaxis(np.tensordot(_weights(np.linspace(0, self.shape[a] - 1, n), self.shape[a]), out, (1, a)), 0, a)
        return replace(self, values=out)

    def field(self, spark) -> Field:
        """As a transform of points of the fixed image's world."""
        at = np.indices(self.shape).reshape(len(self.shape), -1)
        flat = self.values.reshape(-1, self.values.shape[-1])
        table = pd.DataFrame({f"g{i}": x for i, x in enumerate(at)} | {f"d{i}": flat[:, i] for i in range(flat.shape[1])})
        place = Affine.scale_translation(self.spacing, self.low)
        return Field(spark.createDataFrame(table), self.shape, place.inverse())


def control_shape(low, high, voxel_size, spacing: float) -> tuple[int, ...]:
    """Control points over an extent, at most ``spacing`` voxels apart, two on each axis at least."""
    steps = (np.asarray(high) - low) / (spacing * np.asarray(voxel_size, float))
    shape = tuple(max(2, math.ceil(s - 1e-6) + 1) for s in steps.tolist())
    if math.prod(shape) > LATTICE_POINTS:
        raise ValueError(f"a lattice of {shape} points: register coarser levels, or space the points further apart")
    return shape


def levels_to_fit(levels: list[ArrayMeta]) -> list[int]:
    """Levels (finest first) to fit whole, coarse to fine: those neither too small nor too large; the coarsest if there are none."""
    good = [i for i, m in enumerate(levels) if min(m.shape) >= LEVEL_LEAST and math.prod(m.shape) <= LEVEL_VOXELS]
    return good[::-1] or [len(levels) - 1]


def intensity_range(grid: Grid, low: float = 0.005, high: float = 0.995) -> tuple[float, float]:
    """The intensities that become 0 and 1."""
    a, b = grid.df.agg(F.percentile_approx("v", [low, high], 10_000)).first()[0]
    return float(a), float(b)


# dense kernels: one block, in numpy ---------------------------------------------------------------------------------


def _weights(at: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation at ``at`` between ``n`` points, as a matrix; beyond the ends their values hold."""
    at = np.clip(at, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    out = np.zeros((len(at), n))
    rows = np.arange(len(at))
    out[rows, low] = 1 - (at - low)
    if n > 1:
        out[rows, low + 1] += at - low
    return out


def _along(values: np.ndarray, matrices: list[np.ndarray]) -> np.ndarray:
    """A matrix applied along each of the first axes."""
    for a, m in enumerate(matrices):
        values = np.moveaxis(np.tensordot(m, values, (1, a)), 0, a)
    return values


def _window_sums(x: np.ndarray, half: int) -> np.ndarray:
    """Sums over windows of ``half`` voxels to each side, clipped at the block's faces."""
    for a in range(x.ndim):
        n = x.shape[a]
        sums = np.concatenate([np.zeros_like(x.take([0], a)), x.cumsum(a)], axis=a)
        i = np.arange(n)
        x = sums.take(np.minimum(i + half + 1, n), a) - sums.take(np.maximum(i - half, 0), a)
    return x


def _sampled(image: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear interpolation of ``image`` at positions ``at`` (axis last), and its gradient there."""
    d = image.ndim
    low = [np.clip(at[..., a].astype(int), 0, max(image.shape[a] - 2, 0)) for a in range(d)]
    part = [at[..., a] - low[a] for a in range(d)]
    value, slope = np.zeros(at.shape[:-1]), np.zeros(at.shape)
    for corner in itertools.product((0, 1), repeat=d):
        v = image[tuple(np.minimum(lo + c, n - 1) for lo, c, n in zip(low, corner, image.shape, strict=True))]
        w = [p if c else 1 - p for p, c in zip(part, corner, strict=True)]
        value += v * math.prod(w)
        for a in range(d):
            slope[..., a] += v * (1 if corner[a] else -1) * math.prod(w[:a] + w[a + 1 :])
    return value, slope


@dataclass
class Block:
    """One block of a level: its core, and dense pieces of both images with where they begin."""

    core: Box
    fixed_at: np.ndarray
    fixed: np.ndarray
    moving_at: np.ndarray
    moving: np.ndarray


@dataclass(frozen=True)
class Level:
    """What every task knows of a level: placements in numbers, and the affine from fixed to moving points."""

    fixed: ArrayMeta
    moving: ArrayMeta
    affine: Affine
    window: int

    def moving_index(self, points: np.ndarray) -> np.ndarray:
        """Moving voxel positions of fixed points."""
        there = points @ np.array(self.affine.matrix).T + np.array(self.affine.offset)
        return (there - np.array(self.moving.translation)) / np.array(self.moving.voxel_size)

    def points(self, box: Box) -> np.ndarray:
        axes = [np.arange(a, b) * s + t for a, b, s, t in zip(box.start, box.stop, self.fixed.voxel_size, self.fixed.translation, strict=True)]
        return np.stack(np.meshgrid(*axes, indexing="ij"), -1)

    def matrices(self, box: Box, lattice: Lattice) -> list[np.ndarray]:
        """How the voxels of a box read the lattice, an axis at a time."""
        return [_weights((np.arange(a, b) * s + t - lo) / h, n) for a, b, s, t, lo, h, n in zip(box.start, box.stop, self.fixed.voxel_size, self.fixed.translation, lattice.low, lattice.spacing, lattice.shape, strict=True)]

    def looked_at(self, box: Box, lattice: Lattice) -> np.ndarray:
        """Moving voxel positions of a box's voxels under a field."""
        return self.moving_index(self.points(box) + _along(lattice.values, self.matrices(box, lattice)))


class OutOfReach(Exception):
    """A block looks at moving voxels that it does not hold."""


def gradient(block: Block, level: Level, lattice: Lattice, seen_under: Lattice) -> tuple[float, np.ndarray, tuple[slice, ...]]:
    """What a block's core adds to the sum of squared local correlations, and to its gradient: values for a range of lattice points.

    Voxels count whose whole window lies in the moving image under ``seen_under``, the field that the level began with. Raises OutOfReach
    where the block's part of the moving image is too small for the field.
    """
    half = level.window // 2
    box = block.core.pad((half,) * len(block.core.start)).clip(level.fixed.shape)
    cut = tuple(slice(a - o, b - o) for a, b, o in zip(box.start, box.stop, block.fixed_at, strict=True))
    core = tuple(slice(a - o, b - o) for a, b, o in zip(block.core.start, block.core.stop, box.start, strict=True))
    fix = block.fixed[cut].astype(float)
    matrices = level.matrices(box, lattice)
    touched = [np.flatnonzero(m.any(axis=0)) for m in matrices]
    ranges = tuple(slice(int(t[0]), int(t[-1]) + 1) for t in touched)
    local = [m[:, r] for m, r in zip(matrices, ranges, strict=True)]
    last = np.array(level.moving.shape) - 1
    at = level.moving_index(level.points(box) + _along(lattice.values[ranges], local))
    held = np.clip(at, 0, last)
    own = held - block.moving_at
    if (own < 0).any() or (np.floor(own) > np.array(block.moving.shape) - np.where(block.moving_at + block.moving.shape > last, 1, 2)).any():
        raise OutOfReach
    mov, slope = _sampled(block.moving.astype(float), own)
    slope *= held == at  # past the moving image's faces its edge holds
    began = level.looked_at(box, seen_under)
    inside = ((began >= 0) & (began <= last)).all(axis=-1).astype(float)

    n = _window_sums(np.ones_like(fix), half)
    mean = lambda x: _window_sums(x, half) / n
    mi, mj = mean(fix), mean(mov)
    vi, vj, cov = mean(fix * fix) - mi * mi, mean(mov * mov) - mj * mj, mean(fix * mov) - mi * mj
    counted = np.zeros(fix.shape, bool)
    counted[core] = True
    counted &= (vi > FLAT) & (vj > FLAT) & (_window_sums(1 - inside, half) < 0.5)
    vi, vj = np.where(counted, vi, 1.0), np.where(counted, vj, 1.0)
    total = float((cov * cov / (vi * vj))[counted].sum())
    # d(cov^2 / (vi vj)): by the covariance, and by the moving image's variance; each spreads over its window
    by_cov, by_var = np.where(counted, 2 * cov / (vi * vj), 0.0) / n, np.where(counted, -cov * cov / (vi * vj * vj), 0.0) / n
    spread = lambda x: _window_sums(x, half)
    to_value = fix * spread(by_cov) - spread(by_cov * mi) + 2 * (mov * spread(by_var) - spread(by_var * mj))
    to_point = (slope * to_value[..., None]) @ (np.array(level.affine.matrix) / np.array(level.moving.voxel_size)[:, None])
    return total, _along(to_point, [m.T for m in local]), ranges


def roughness(lattice: Lattice) -> tuple[float, np.ndarray]:
    """Mean squared gradient of a field, and its gradient."""
    total, out = 0.0, np.zeros_like(lattice.values)
    for a, h in enumerate(lattice.spacing.tolist()):
        step = np.diff(lattice.values, axis=a) / h
        total += float((step * step).mean())
        by = 2 * step / (h * step.size)
        pad = [(0, 0)] * lattice.values.ndim
        out += np.pad(by, [*pad[:a], (1, 0), *pad[a + 1 :]]) - np.pad(by, [*pad[:a], (0, 1), *pad[a + 1 :]])
    return total, out


@dataclass
class Adam:
    """Steps of adaptive moments (Kingma and Ba) on one array."""

    rate: float
    first: float = 0.9
    second: float = 0.999
    count: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def step(self, values: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.count += 1
        self.mean = self.first * self.mean + (1 - self.first) * slope
        self.square = self.second * self.square + (1 - self.second) * slope * slope
        return values - self.rate * (self.mean / (1 - self.first**self.count)) / (np.sqrt(self.square / (1 - self.second**self.count)) + 1e-8)


# images dealt out ---------------------------------------------------------------------------------------------------


def _pieces(grid: Grid, size: int, scale: tuple[float, float]) -> DataFrame:
    """An image as dense pieces of ``size`` voxels on each axis: ``cell`` (its number), ``data`` (float32, from 0 to 1)."""
    axes, shape = grid.axes, grid.meta.shape
    counts = [-(-n // size) for n in shape]
    cell = F.lit(0).cast("long")
    for a, n in zip(axes, counts, strict=True):
        cell = cell * n + F.floor(F.col(a) / size)
    low, high = scale
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - low) / max(high - low, 1e-12)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["cell"].iloc[0])
        box = Box.of_chunk(tuple(int(i) for i in np.unravel_index(number, counts)), (size,) * len(shape), shape)
        dense = np.zeros(box.shape, np.float32)
        dense[tuple(part[a].to_numpy() - s for a, s in zip(axes, box.start, strict=True))] = part["v"].to_numpy()
        return pd.DataFrame({"cell": [number], "data": [dense.tobytes()]})

    rows = grid.df.select(cell.alias("cell"), *axes, v.alias("v"))
    return rows.groupBy("cell").applyInPandas(pack, "cell long, data binary")


def _joined(box: Box, parts: dict[int, bytes], shape: tuple[int, ...], size: int) -> np.ndarray:
    """A box out of the pieces that it meets."""
    counts, out = [-(-n // size) for n in shape], np.zeros(box.shape, np.float32)
    for number, data in parts.items():
        own = Box.of_chunk(tuple(int(i) for i in np.unravel_index(number, counts)), (size,) * len(shape), shape)
        low, high = np.maximum(own.start, box.start), np.minimum(own.stop, box.stop)
        if (high > low).all():
            piece = np.frombuffer(data, np.float32).reshape(own.shape)
            out[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, box.start, strict=True))] = piece[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, own.start, strict=True))]
    return out


def _cells_of(box: Box, shape: tuple[int, ...], size: int) -> list[int]:
    counts = [-(-n // size) for n in shape]
    spans = [range(a // size, -(-b // size)) for a, b in zip(box.start, box.stop, strict=True)]
    return [int(np.ravel_multi_index(i, counts)) for i in itertools.product(*spans)]


@dataclass
class Pair:
    """Both images of a level, dealt out; ``block`` voxels on each axis are a block, and so is a stored piece.

    A block holds the moving image ``margin`` voxels further than it looks when it is dealt.
    """

    level: Level
    fixed: DataFrame
    moving: DataFrame
    block: int
    margin: float = 6.0
    blocks: DataFrame | None = field(default=None)

    @staticmethod
    def of(fixed: Grid, moving: Grid, affine: Affine, window: int, block: int, scales) -> Pair:
        level = Level(fixed.meta, moving.meta, affine, window)
        cut = [stored(_pieces(g, block, s), "pieces") for g, s in zip((fixed, moving), scales, strict=True)]
        return Pair(level, *cut, block)

    @property
    def counts(self) -> list[int]:
        return [-(-n // self.block) for n in self.level.fixed.shape]

    def core(self, number: int) -> Box:
        index = tuple(int(i) for i in np.unravel_index(number, self.counts))
        return Box.of_chunk(index, (self.block,) * len(index), self.level.fixed.shape)

    def boxes(self, number: int, lattice: Lattice, halo: int) -> tuple[Box, Box]:
        """What a block needs of the fixed image, and of the moving one under a field."""
        own = self.core(number).pad((halo,) * len(lattice.shape)).clip(self.level.fixed.shape)
        last = np.array(self.level.moving.shape) - 1
        at = np.clip(self.level.looked_at(own, lattice).reshape(-1, len(last)), 0, last)
        low, high = np.floor(at.min(axis=0) - self.margin).astype(int), np.floor(at.max(axis=0) + self.margin).astype(int) + 2
        return own, Box(tuple(low.tolist()), tuple(high.tolist())).clip(self.level.moving.shape)

    def deal(self, lattice: Lattice, halo: int) -> DataFrame:
        """``number``, ``fixed``, ``moving``: both images' parts that each block needs under ``lattice``, as the bytes of ``boxes``."""
        pair = replace(self, fixed=None, moving=None, blocks=None)
        size, shapes = self.block, (self.level.fixed.shape, self.level.moving.shape)

        def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(n, i, c) for n in batch.column("id").to_pylist() for i, b in enumerate(pair.boxes(n, lattice, halo)) for c in _cells_of(b, shapes[i], size)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["number", "image", "cell"])

        def join(part: pd.DataFrame) -> pd.DataFrame:
            number = int(part["number"].iloc[0])
            out = {"number": [number]}
            for i, (name, box) in enumerate(zip(("fixed", "moving"), pair.boxes(number, lattice, halo), strict=True)):
                held = part[part["image"] == i]
                out[name] = [_joined(box, dict(zip(held["cell"], held["data"], strict=True)), shapes[i], size).tobytes()]
            return pd.DataFrame(out)

        spark = self.fixed.sparkSession
        wanted = spark.range(math.prod(self.counts)).mapInArrow(needs, "number long, image long, cell long")
        images = self.fixed.withColumn("image", F.lit(0).cast("long")).unionByName(self.moving.withColumn("image", F.lit(1).cast("long")))
        met = wanted.join(images, ["image", "cell"]).select("number", "image", "cell", "data")
        dealt = met.groupBy("number").applyInPandas(join, "number long, fixed binary, moving binary")
        return stored(dealt, "blocks", "none")

    def opened(self, number: int, fixed: bytes, moving: bytes, lattice: Lattice, halo: int) -> Block:
        own, there = self.boxes(number, lattice, halo)
        return Block(self.core(number), np.array(own.start), np.frombuffer(fixed, np.float32).reshape(own.shape), np.array(there.start), np.frombuffer(moving, np.float32).reshape(there.shape))

    def slope(self, dealt_under: Lattice, lattice: Lattice, seen_under: Lattice) -> tuple[float, np.ndarray] | None:
        """The mean squared local correlation and its gradient by lattice point, in one job; None if blocks must be dealt anew."""
        pair, half = replace(self, fixed=None, moving=None, blocks=None), self.level.window // 2
        known = self.fixed.sparkSession.sparkContext.broadcast((dealt_under, lattice, seen_under))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealt, now, began = known.value
            sums, total, short = np.zeros(now.values.shape), 0.0, 0
            for batch in batches:
                for row in batch.to_pylist():
                    block = pair.opened(row["number"], row["fixed"], row["moving"], dealt, half)
                    try:
                        value, slope, ranges = gradient(block, pair.level, now, began)
                    except OutOfReach:
                        short += 1
                        continue
                    total += value
                    sums[ranges] += slope
            flat = sums.reshape(-1, sums.shape[-1])
            nodes = np.flatnonzero(flat.any(axis=1))
            cols = [np.r_[flat[nodes, i], (total, short, *[0.0] * flat.shape[1])[i]] for i in range(flat.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[nodes, -1]), *map(pa.array, cols)], names=["node", *(f"s{i}" for i in range(flat.shape[1]))])

        d = lattice.values.shape[-1]
        schema = "node long, " + ", ".join(f"s{i} double" for i in range(d))
        sums = self.blocks.mapInArrow(run, schema).groupBy("node").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)]).toPandas()
        known.unpersist()
        whole = sums[sums["node"] < 0]
        if whole["s1"].sum() > 0:
            return None
        out, nodes, n = np.zeros((math.prod(lattice.shape), d)), sums[sums["node"] >= 0], math.prod(self.level.fixed.shape)
        out[nodes["node"]] = nodes[[f"s{i}" for i in range(d)]]
        return float(whole["s0"].sum()) / n, out.reshape(lattice.values.shape) / n

    def fitted(self, start: Lattice, steps: int, smooth: float, step: float, watch=None) -> tuple[Lattice, float, float]:
        """``start`` after gradient steps, and the mean squared local correlation before and after them."""
        half = self.level.window // 2
        now, dealt, first, value = start, start, None, 0.0
        self.blocks = self.deal(start, half)
        rule = Adam(step * float(np.mean(self.level.fixed.voxel_size)))
        for _ in range(steps):
            found = self.slope(dealt, now, start)
            if found is None:
                dealt = now
                self.blocks = self.deal(now, half)
                found = self.slope(dealt, now, start)
            value, up = found
            first = value if first is None else first
            now = replace(now, values=rule.step(now.values, smooth * roughness(now)[1] - up))
            if watch:
                watch(now)
        return now, first or 0.0, value


# registration -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Registered:
    """A fitted field with what it was fitted to: ``transform`` takes the fixed image's points to the moving image's."""

    lattice: Lattice
    affine: Affine
    fixed: list[Grid]
    moving: list[Grid]
    correlation: tuple[tuple[float, float], ...] = ()
    frames: tuple[Lattice, ...] = ()

    def transform(self, lattice: Lattice | None = None) -> Sequence:
        spark = self.fixed[0].df.sparkSession
        return Sequence(((lattice or self.lattice).field(spark), self.affine))

    def image(self, level: int = 0, lattice: Lattice | None = None, order: int | None = None) -> Grid:
        """The moving image on the fixed one's grid; every level comes from the same field."""
        return resample(self.moving[min(level, len(self.moving) - 1)], self.fixed[level].meta, self.transform(lattice), order)

    def pair(self, level: int = 0) -> Grid:
        """Fixed and registered image as channels."""
        from .axes import stack

        fixed = self.fixed[level]
        return stack([fixed, replace(self.image(level), meta=fixed.meta)], "c")

    def displacements(self, level: int = 0) -> Grid:
        """The field on the fixed image's grid, a component a channel."""
        from ..geometry.resample import field_of

        return field_of(self.lattice.field(self.fixed[0].df.sparkSession), self.fixed[level].meta, self.fixed[0].df.sparkSession)


def _extent(meta: ArrayMeta) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """From the first voxels' outer faces to the last ones'."""
    low = tuple(t - s / 2 for t, s in zip(meta.translation, meta.voxel_size, strict=True))
    return low, tuple(a + n * s for a, n, s in zip(low, meta.shape, meta.voxel_size, strict=True))


def register(fixed: list[Grid], moving: list[Grid], affine: Affine | None = None, fit: Fit = Fit(), levels: list[int] | None = None, frames: int = 0) -> Registered:
    """Fit a field that brings ``moving`` onto ``fixed`` (levels, finest first, of like voxel sizes), starting from ``affine`` alone.

    ``levels`` are fitted coarse to fine, by default ``levels_to_fit``; with no steps the affine is all. With ``frames`` so many fields on the
    way are kept, the first without any displacement and the last the result. Only the lattice and its gradient come to the driver.
    """
    d = len(fixed[0].axes)
    affine = affine or Affine.of(np.eye(d))
    levels = levels_to_fit([g.meta for g in fixed]) if levels is None else levels
    plan = fit.of(len(levels))
    low, high = _extent(fixed[0].meta)
    lattice = Lattice(np.zeros((*(2,) * d, d)), low, high)
    every, kept = sum(n for n, _ in plan), [lattice]
    scales = [intensity_range(g) for g in (fixed[levels[0]], moving[min(levels[0], len(moving) - 1)])] if every else None
    wanted = {round(k * every / (frames - 1)) for k in range(1, frames)} if frames > 1 else set()
    made, said = 0, []

    def watch(now: Lattice) -> None:
        nonlocal made
        made += 1
        if made in wanted:
            kept.append(now)

    for number, (steps, window) in zip(levels, plan, strict=True):
        if not steps:
            continue
        one, other = fixed[number], moving[min(number, len(moving) - 1)]
        lattice = lattice.refined(control_shape(low, high, one.meta.voxel_size, fit.spacing))
        pair = Pair.of(one, other, affine, window, fit.block, scales)
        lattice, before, after = pair.fitted(lattice, steps, fit.smooth, fit.step, watch)
        said.append((before, after))
    return Registered(lattice, affine, fixed, moving, tuple(said), tuple(kept if frames else ()))


def refined_field(done: Registered, level: int = 0, fit: Fit = Fit(), halo: int = 8, overlap: int | None = None) -> DataFrame:
    """The field fitted further on one level, block by block: coordinates of the level's voxels and displacements ``d0..``.

    Every block with ``halo`` voxels around it is fitted by itself in one task, from ``done``'s field, at control points that lie where the whole
    level's would; neighbouring blocks' fields are blended with tent weights over ``overlap`` voxels (by default half the halo). Blocks are independent, so a
    level of any size is fitted with memory for a block in each task.
    """
    one, other = done.fixed[level], done.moving[min(level, len(done.moving) - 1)]
    (steps, window), *_ = fit.of(1)
    overlap = halo // 2 if overlap is None else overlap
    if overlap > halo:
        raise ValueError("blocks can't be blended further than they are fitted")
    scales = [intensity_range(g) for g in (one, other)]
    pair = Pair.of(one, other, done.affine, window, fit.block, scales)
    axes, shape, d = one.axes, one.meta.shape, len(one.axes)
    # no step of Adam is longer than (1 - first) / sqrt(1 - second) = 3.2 times its rate, so no block looks further than this
    pair.margin += 3.2 * steps * fit.step
    dealt = pair.deal(done.lattice, halo + window // 2)
    bare = replace(pair, fixed=None, moving=None, blocks=None)
    start, begin = done.lattice, np.array(_extent(one.meta)[0])
    whole = control_shape(*_extent(one.meta), one.meta.voxel_size, fit.spacing)
    apart = (np.array(_extent(one.meta)[1]) - begin) / (np.array(whole) - 1)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = row["number"]
                block = bare.opened(number, row["fixed"], row["moving"], start, halo + window // 2)
                own = bare.core(number)
                wide = own.pad((halo,) * d).clip(shape)
                block.core = wide
                faces = [(np.array(x) - 0.5) * np.array(one_size) + np.array(one_place) for x in (wide.start, wide.stop)]
                low = np.maximum(np.floor((faces[0] - begin) / apart + 1e-9), 0).astype(int)
                high = np.minimum(np.ceil((faces[1] - begin) / apart - 1e-9), np.array(whole) - 1).astype(int)
                matrices = [_weights(np.arange(a, b + 1) * h / s, n) for a, b, h, s, n in zip(low, high, apart, start.spacing, start.shape, strict=True)]
                now = began = Lattice(_along(start.values, matrices), tuple(begin + low * apart), tuple(begin + high * apart))
                rule, n = Adam(fit.step * float(np.mean(one_size))), math.prod(wide.shape)
                for _ in range(steps):
                    _, up, ranges = gradient(block, bare.level, now, began)
                    slope = fit.smooth * roughness(now)[1]
                    slope[ranges] -= up / n
                    now = replace(now, values=rule.step(now.values, slope))
                seen = own.pad((overlap,) * d).clip(shape)
                u = _along(now.values, bare.level.matrices(seen, now)).reshape(-1, d)
                at = np.indices(seen.shape).reshape(d, -1)
                index = np.unravel_index(number, bare.counts)
                cols = [pa.array(x + s) for x, s in zip(at, seen.start, strict=True)] + [pa.array(np.full(len(u), i)) for i in index] + [pa.array(u[:, i]) for i in range(d)]
                yield pa.RecordBatch.from_arrays(cols, names=[*axes, *(f"b_{a}" for a in axes), *(f"d{i}" for i in range(d))])

    one_size, one_place = one.meta.voxel_size, one.meta.translation
    schema = ", ".join([*(f"{a} long" for a in axes), *(f"b_{a} long" for a in axes), *(f"d{i} double" for i in range(d))])
    parts = dealt.repartition("number").mapInArrow(solve, schema)
    weight = F.lit(1.0)
    for a, n in zip(axes, shape, strict=True):
        begins = F.col(f"b_{a}") * fit.block
        weight = weight * tent(F.col(a), begins, F.least(F.lit(n), begins + fit.block), overlap)
    blended = parts.withColumn("w", weight).groupBy(*axes)
    return blended.agg(*[(F.sum(F.col(f"d{i}") * F.col("w")) / F.sum("w")).alias(f"d{i}") for i in range(d)])
