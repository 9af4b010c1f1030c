"""Pipelines: a source and a list of operators, known before anything runs.

A spec is plain data. From it follow every stage's digest (an edit changes those after it, none before), the box that each
stage needs for a box of the result, and the chunks that a read would compute.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..geometry.resample import at_voxel_size
from ..grid import Grid
from ..meta import ArrayMeta, Box, level_for, nearest_level
from ..operators import aggregate, axes, combine, pointwise, segment, stencil
from ..storage import stored


@dataclass(frozen=True)
class Op:
    """An operator as a spec can name it: its function, its halo, how it changes the grid, whether its stage is kept.

    One with a ``voxel_size`` (of the last axes), such as a model trained at one resolution, runs on arrays of that size only; see ``at_one_size``.
    """

    name: str
    apply: Callable[..., Grid]
    halo: Callable[[dict, ArrayMeta], tuple[int, ...]] = lambda params, meta: (0,) * len(meta.axes)
    factor: Callable[[dict, ArrayMeta], tuple[int, ...]] = lambda params, meta: (1,) * len(meta.axes)
    cache: bool = False
    voxel_size: tuple[float, ...] | None = None


OPS: dict[str, Op] = {}


def register(op: Op) -> Op:
    """Make an operator known by name; names can't be taken twice."""
    if op.name in OPS:
        raise ValueError(f"there is an operator {op.name} already")
    OPS[op.name] = op
    return op


def load_plugins(group: str = "gridloom.ops") -> None:
    """Operators of other packages; one that can't be loaded is passed over with a warning."""
    for point in importlib.metadata.entry_points(group=group):
        try:
            register(point.load())
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"operator {point.name} can't be loaded: {e}", stacklevel=2)


def _everywhere(n: Callable[[dict], int]):
    return lambda params, meta: tuple(n(params) if a in meta.spatial else 0 for a in meta.axes)


def _factors(params: dict, meta: ArrayMeta) -> tuple[int, ...]:
    f = params.get("factor", 2)
    f = [f] * len(meta.spatial) if isinstance(f, int) else list(f)
    return (1,) * (len(meta.axes) - len(f)) + tuple(f)


for _op in (
    Op("threshold", pointwise.threshold),
    Op("cast", pointwise.cast),
    Op("scale", pointwise.scale),
    Op("normalize", pointwise.normalize),
    Op("gaussian", stencil.gaussian, _everywhere(lambda p: ceil(p.get("sigma", 1.0) * p.get("truncate", 3.0)))),
    Op("uniform", stencil.uniform, _everywhere(lambda p: p.get("size", 3) // 2 + 1)),
    Op("diff", stencil.diff, lambda p, m: tuple(p.get("lag", 1) if i == p.get("axis", 0) else 0 for i in range(len(m.axes)))),
    Op("dog", stencil.dog, _everywhere(lambda p: ceil(4 * p.get("sigma", 2.0) * p.get("ratio", 1.6)) + 1)),
    Op("slope", stencil.slope, _everywhere(lambda p: 1)),
    Op("hillshade", stencil.hillshade, _everywhere(lambda p: 1)),
    Op("morphology", stencil.morphology, _everywhere(lambda p: 2 * p.get("radius", 2) + 1)),
    Op("label", segment.label, cache=True),
    Op("downsample", aggregate.downsample, factor=_factors),
    Op("normalized_difference", combine.normalized_difference),
    Op("contacts", combine.contacts, _everywhere(lambda p: ceil(p.get("radius", 3.0)) + 1)),
):
    register(_op)


def digest(*parts) -> str:
    """Twelve hex digits of the parts' canonical JSON."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Spec:
    """``source`` names a table or another pipeline; ``ops`` are (name, parameters)."""

    source: str
    ops: tuple[tuple[str, dict], ...] = ()
    select: dict = field(default_factory=dict)
    token: str = ""

    @staticmethod
    def of(data: dict) -> Spec:
        unknown = set(data) - {"source", "ops", "select", "token"}
        if unknown:
            raise ValueError(f"unknown in a spec: {sorted(unknown)}")
        ops = []
        for o in data.get("ops", ()):
            params = {k: v for k, v in o.items() if k != "op"}
            if o["op"] not in OPS:
                raise ValueError(f"no operator {o['op']}")
            ops.append((o["op"], params))
        return Spec(data["source"], tuple(ops), dict(data.get("select", {})), data.get("token", ""))


class Pipeline:
    """A spec over an opened source."""

    def __init__(self, spec: Spec, source: Grid):
        self.spec = spec
        self.source = axes.select(source, spec.select) if spec.select else source

    @property
    def stages(self) -> list[str]:
        """Digests: the source's, then one after each operator."""
        out = [digest(self.spec.source, self.spec.select, self.spec.token, self.source.meta.shape, self.source.meta.axes)]
        for name, params in self.spec.ops:
            out.append(digest(out[-1], name, params))
        return out

    @property
    def digest(self) -> str:
        return self.stages[-1]

    def metas(self) -> list[ArrayMeta]:
        """What each stage's array will be, without computing any."""
        out = [self.source.meta]
        for name, params in self.spec.ops:
            m, f = out[-1], OPS[name].factor(params, out[-1])
            if any(k > 1 for k in f):
                shape = tuple(-(-n // k) for n, k in zip(m.shape, f, strict=True))
                m = replace(m, shape=shape, voxel_size=tuple(v * k for v, k in zip(m.voxel_size, f, strict=True)), chunk=tuple(min(c, n) for c, n in zip(m.chunk, shape, strict=True)))
            out.append(m)
        return out

    def boxes(self, box: Box) -> list[Box]:
        """The box needed of each stage for ``box`` of the result: grown by halos, scaled by factors, clipped."""
        metas = self.metas()
        out = [box.clip(metas[-1].shape)]
        for (name, params), m in reversed(list(zip(self.spec.ops, metas, strict=False))):
            op, b = OPS[name], out[0]
            f = op.factor(params, m)
            if name == "label":
                out.insert(0, m.box)  # components may reach anywhere
                continue
            wide = Box(tuple(a * k for a, k in zip(b.start, f, strict=True)), tuple(s * k for s, k in zip(b.stop, f, strict=True)))
            out.insert(0, wide.pad(op.halo(params, m)).clip(m.shape))
        return out

    def read(self, box: Box | None = None, keep: dict[str, DataFrame] | None = None) -> Grid:
        """The result in ``box``. Only the dilated box of the source is scanned; stages in ``keep`` (by digest) are used, not computed.

        Boxes are cut from the whole array's coordinates, so an edge is an edge of the array only where the box touches
        it: a stage sees its halo, or the array's true edge.
        """
        metas = self.metas()
        boxes = self.boxes(box or metas[-1].box)
        grid = self.source.read(boxes[0])
        grid = Grid(grid.df, replace(metas[0], shape=metas[0].shape))
        for (name, params), stage in zip(self.spec.ops, self.stages[1:], strict=True):
            if keep is not None and stage in keep and box is None:
                grid = Grid(keep[stage], grid.meta)
                continue
            grid = OPS[name].apply(grid, **params)
            if OPS[name].cache and keep is not None and box is None:
                keep[stage] = stored(grid.df, f"stage-{stage}")
                grid = Grid(keep[stage], grid.meta)
        return grid.read(boxes[-1]) if box is not None else grid

    def plan(self, spark: SparkSession, box: Box, held: dict[str, set[tuple[int, ...]]] | None = None) -> DataFrame:
        """For each stage the chunks a read of ``box`` needs, those held, and those left to compute."""
        rows = []
        for i, (stage, m, b) in enumerate(zip(self.stages, self.metas(), self.boxes(box), strict=True)):
            need = [()]
            for r in m.chunks_covering(b):
                need = [(*x, k) for x in need for k in r]
            have = len(set(need) & (held or {}).get(stage, set()))
            rows.append((i, stage, len(need), have, len(need) - have))
        return spark.createDataFrame(rows, "stage long, digest string, needed long, held long, missing long")


class Registry:
    """Pipelines by name; one may be the source of another (``dataset://name``). An edit renews what depends on it."""

    def __init__(self, spark: SparkSession, open_source: Callable[[str], Grid]):
        self.spark, self.open_source = spark, open_source
        self.specs: dict[str, Spec] = {}
        self.versions: dict[str, int] = {}
        self.listeners: list[Callable[[str, int], None]] = []

    def upstreams(self, name: str) -> set[str]:
        """All pipelines that a pipeline reads, at any remove."""
        out, waiting = set(), [name]
        while waiting:
            spec = self.specs.get(waiting.pop())
            if spec and spec.source.startswith("dataset://") and (up := spec.source.removeprefix("dataset://")) not in out:
                out.add(up)
                waiting.append(up)
        return out

    def dependents(self, name: str) -> set[str]:
        return {n for n in self.specs if name in self.upstreams(n)}

    def put(self, name: str, spec: Spec) -> list[str]:
        """Add or edit; returns the pipelines that changed, ``name`` first. Cycles and unknown names are refused."""
        if spec.source.startswith("dataset://") and (up := spec.source.removeprefix("dataset://")) not in self.specs and up != name:
            raise ValueError(f"no dataset {up}")
        before = self.specs.get(name)
        self.specs[name] = spec
        if name in self.upstreams(name):
            self.specs.pop(name)
            if before:
                self.specs[name] = before
            raise ValueError(f"{name} would read itself")
        changed = [name, *sorted(self.dependents(name))]
        for n in changed:
            self.versions[n] = self.versions.get(n, 0) + 1
            self.open(n).df.createOrReplaceTempView(n)
            for listen in self.listeners:
                listen(n, self.versions[n])
        return changed

    def remove(self, name: str) -> None:
        if users := self.dependents(name):
            raise ValueError(f"{sorted(users)} read {name}")
        self.specs.pop(name)
        self.spark.catalog.dropTempView(name)

    def pipeline(self, name: str) -> Pipeline:
        if name not in self.specs:
            raise ValueError(f"no dataset {name}")
        spec = self.specs[name]
        up = spec.source.removeprefix("dataset://")
        return Pipeline(spec, self.open(up) if up != spec.source else self.open_source(spec.source))

    def open(self, name: str) -> Grid:
        return self.pipeline(name).read()


def coverage(grid: Grid, held: DataFrame) -> DataFrame:
    """One row a chunk: 1 where it is held (``held`` has ``chunk_<axis>``), else 0."""
    keys = [f"chunk_{a}" for a in grid.axes]
    counts = [-(-n // c) for n, c in zip(grid.meta.shape, grid.meta.chunk, strict=True)]
    total = 1
    for n in counts:
        total *= n
    step, cols = total, []
    for k, n in zip(keys, counts, strict=True):
        step //= n
        cols.append((F.floor(F.col("id") / step) % n).cast("long").alias(k))
    every = held.sparkSession.range(total).select(*cols)
    return every.join(held.select(*keys).distinct().withColumn("own", F.lit(1)), keys, "left").select(*keys, F.coalesce("own", F.lit(0)).cast("long").alias("held"))


def coverage_levels(levels: list[ArrayMeta], held: list[DataFrame]) -> DataFrame:
    """``level``, chunk indices, ``bits``: of every level's chunks, finest level first.

    Bit 1: the chunk is held (``held`` of its level has ``chunk_<axis>``). Bit 2: all chunks of the finest level under it are, whether it is held or not. The finest chunks are listed
    by a range and each names the chunks over it, whose least flag is the second bit: one aggregation a level.
    """
    fine, spark = levels[0], held[0].sparkSession
    keys = [f"chunk_{a}" for a in fine.axes]
    own = coverage(Grid(held[0], fine), held[0])
    out = own.select(F.lit(0).cast("long").alias("level"), *keys, (F.col("held") * 3).alias("bits"))
    for k, meta in enumerate(levels[1:], 1):
        over = own
        for a, key, n, c, m, d, size, wide in zip(fine.axes, keys, fine.shape, fine.chunk, meta.shape, meta.chunk, fine.voxel_size, meta.voxel_size, strict=True):
            ratio = float(size / wide)
            low = F.floor(F.floor(F.col(key) * c * ratio + 1e-9) / d)
            last = F.least(F.ceil(F.least((F.col(key) + 1) * c, F.lit(n)) * ratio - 1e-9), F.lit(m)) - 1
            over = over.withColumn(f"over_{a}", F.explode(F.sequence(F.least(low, F.floor(last / d)).cast("long"), F.floor(last / d).cast("long"))))
        whole = over.groupBy(*[F.col(f"over_{a}").alias(key) for a, key in zip(fine.axes, keys, strict=True)]).agg(F.min("held").alias("all"))
        met = coverage(Grid(held[k], meta), held[k]).join(whole, keys, "left")
        out = out.unionByName(met.select(F.lit(k).cast("long").alias("level"), *keys, (F.col("held") + 2 * F.coalesce("all", F.lit(0))).alias("bits")))
    return out


def at_one_size(spec: Spec, levels: list[Grid], coarse: str = "none", input_level: str = "resample", rtol: float = 0.05) -> list[Pipeline]:
    """The pipelines of a spec with an operator of one voxel size, over an image's ``levels`` (finest first): the level that it runs on, and coarser ones.

    The operator gets the level whose voxels are of its size within ``rtol``. Where there is none, ``input_level`` says what then: ``resample`` brings the coarsest finer level (the finest, if all are coarser)
    to that size, ``nearest`` takes the level of the nearest size as it is, ``exact`` raises ValueError. With ``coarse`` ``compute`` the operator's result is averaged down to each coarser level of the image, as far as its voxels grow by whole
    numbers, and the operators after it run on that; with ``none`` there is the one level. A box read of a pipeline scans that level of the source only. Raises ValueError where no operator, or more than one,
    has a size.
    """
    if coarse not in ("none", "compute") or input_level not in ("resample", "nearest", "exact"):
        raise ValueError("coarse is none or compute, input_level resample, nearest or exact")
    sized = [i for i, (name, _) in enumerate(spec.ops) if OPS[name].voxel_size is not None]
    if len(sized) != 1:
        raise ValueError(f"{len(sized)} operators have a voxel size, where one is wanted")
    want = OPS[spec.ops[sized[0]][0]].voxel_size
    metas = [g.meta for g in levels]
    sizes = [m.voxel_size[len(m.axes) - len(want) :] for m in metas]
    spatial = [replace(m, axes=m.axes[-len(want) :], shape=m.shape[-len(want) :], chunk=m.chunk[-len(want) :], voxel_size=s, units=m.units[-len(want) :], translation=m.translation[-len(want) :]) for m, s in zip(metas, sizes, strict=True)]
    at = level_for(spatial, want, rtol)
    at = 0 if at is None else at
    exact = all(abs(a - b) <= rtol * b for a, b in zip(sizes[at], want, strict=True))
    if not exact and input_level == "exact":
        raise ValueError(f"no level has voxels of {want} within {rtol:.0%}: {sizes}")
    if not exact and input_level == "nearest":
        at, exact = nearest_level(spatial, want), True
    source = levels[at] if exact else at_voxel_size(levels[at], want)
    out, ops = [Pipeline(spec, source)], list(spec.ops)
    for k in range(at + 1, len(levels) if coarse == "compute" else at + 1):
        step = [max(1, round(b / a)) for a, b in zip(sizes[k - 1], sizes[k], strict=True)]
        if all(f == 1 for f in step):
            break
        down = [("downsample", {"factor": list(step), "mode": "mean"})]
        ops = [*ops[: sized[0] + len(out)], *down, *spec.ops[sized[0] + 1 :]]
        out.append(Pipeline(replace(spec, ops=type(spec.ops)(ops)), source))
    return out
