"""Groups of stored arrays: image pyramids, fields and scenes of OME-Zarr metadata, coordinates kept beside an array.

Metadata are small files read on the driver; voxels are read by ``stores`` in tasks.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..geometry.resample import resample
from ..geometry.transforms import Affine, Field, Scene, Transform, parse, simplified
from ..grid import Grid
from ..meta import SPATIAL, ArrayMeta
from . import stores

#: Names of the metadata's versions, by the store format that carries them.
VERSIONS = {"zarr2": "0.4", "zarr3": "0.5"}
#: Kinds of axes whose indices are components of vectors.
VECTORS = {"displacement": False, "coordinate": True}


def attributes(spark: SparkSession, path: str) -> dict:
    """A node's attributes, those of its ``ome`` part where it has one."""
    found = (stores.small_json(spark, f"{path}/zarr.json") or {}).get("attributes") or stores.small_json(spark, f"{path}/.zattrs") or stores.small_json(spark, f"{path}/attributes.json") or {}
    return found.get("ome", found)


def _joined(root: str, path: str) -> str:
    return f"{root.rstrip('/')}/{path.strip('/')}".rstrip("/")


def _product(steps: list[dict], n: int) -> Affine:
    """Closed-form steps as one affine."""
    out = simplified(parse({"type": "sequence", "transformations": [{"type": "identity"}, *steps]}, n)).parts
    if len(out) != 1 or not isinstance(out[0], Affine):
        raise ValueError("a level is placed by affines only")
    return out[0]


def _placed(meta: ArrayMeta, axes: list, place: Affine) -> ArrayMeta:
    """A level's meta by its axes and the affine from indices to the middles of voxels."""
    m = np.array(place.matrix)
    if np.any(m - np.diag(np.diag(m))):
        raise ValueError("the axes of a level that is turned or sheared have no voxel size; open it by its scene")
    names = tuple(a["name"] if isinstance(a, dict) else a for a in axes) or meta.axes
    units = tuple((a.get("unit") or "") if isinstance(a, dict) else "" for a in axes) or meta.units
    return replace(meta, axes=names, units=units, voxel_size=tuple(np.diag(m).tolist()), translation=place.offset)


def _levels(spark: SparkSession, path: str) -> tuple[list, list[tuple[str, Affine]]] | None:
    """The axes of an image and its levels (path, affine from indices), or None where no pyramid is described."""
    groups = attributes(spark, path).get("multiscales")
    if not groups:
        return None
    group = groups[0]
    if not group.get("datasets"):
        raise ValueError(f"the pyramid at {path} has no levels")
    systems = group.get("coordinateSystems")
    axes = (systems[0] if systems else group).get("axes") or []
    shared = [] if systems else group.get("coordinateTransformations") or []
    return axes, [(d["path"], _product([*(d.get("coordinateTransformations") or []), *shared], len(axes))) for d in group["datasets"]]


def open_levels(spark: SparkSession, path: str) -> list[Grid]:
    """A pyramid's levels, finest first: those that its metadata name, else arrays ``s0``, ``s1``, ...; an array alone is one level."""
    described = _levels(spark, path)
    if described is None:
        numbered = []
        while stores.exists(spark, f"{path}/s{len(numbered)}"):
            numbered.append(f"{path}/s{len(numbered)}")
        if numbered and not stores.exists(spark, f"{path}/info"):
            return [stores.read(spark, p) for p in numbered]
        return [stores.read(spark, path, scale=k) for k in range(max(1, stores.scales(path)))]
    axes, levels = described
    label = "image-label" in attributes(spark, path) or "/labels/" in path
    out = []
    for name, place in levels:
        g = stores.read(spark, _joined(path, name))
        meta = _placed(g.meta, axes, place)
        df = g.df.select(*[F.col(a).alias(b) for a, b in zip(g.axes, meta.axes, strict=True)], "v")
        out.append(Grid(df, replace(meta, kind="label") if label else meta))
    return out


def write_levels(levels: list[Grid], path: str, form: str = "zarr3", compressor: str = "zstd") -> DataFrame:
    """A pyramid as arrays ``s0``, ``s1``, ... under one group; returns ``level`` and what was written of it."""
    if form not in ("zarr2", "zarr3", "n5"):
        raise ValueError("pyramids are written as zarr2, zarr3 or n5")
    first = levels[0].meta
    kinds = {"t": "time", "c": "channel"}
    axes = [{"name": a, "type": kinds.get(a, "space"), **({"unit": u} if u else {})} for a, u in zip(first.axes, first.units, strict=True)]
    datasets = [
        {"path": f"s{k}", "coordinateTransformations": [{"type": "scale", "scale": g.meta.voxel_size}, {"type": "translation", "translation": g.meta.translation}]} for k, g in enumerate(levels)
    ]
    about = {"axes": axes, "datasets": datasets}
    if form == "zarr2":
        files = {".zgroup": {"zarr_format": 2}, ".zattrs": {"multiscales": [about | {"version": VERSIONS[form]}]}}
    elif form == "zarr3":
        files = {"zarr.json": {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": VERSIONS[form], "multiscales": [about]}}}}
    else:
        files = {"attributes.json": {"n5": "2.0.0", "multiscales": [about]}}
    stores.put_json(path, files)
    done = [stores.write(g, f"{path}/s{k}", form, compressor).select(F.lit(k).cast("long").alias("level"), "*") for k, g in enumerate(levels)]
    return reduce(DataFrame.unionByName, done)


def open_field(spark: SparkSession, path: str, order: int = 1) -> Field:
    """A stored field, of displacements or of coordinates: its vector axis becomes columns, by one aggregation over lattice points."""
    attrs, described = attributes(spark, path), _levels(spark, path)
    if described:
        axes, ((name, _), *_rest) = described
        array, steps = _joined(path, name), attrs["multiscales"][0]["datasets"][0].get("coordinateTransformations") or []
    else:
        systems = attrs.get("coordinateSystems")
        axes, array, steps = (systems[0] if systems else attrs).get("axes") or [], path, attrs.get("coordinateTransformations") or []
    g = stores.read(spark, array)
    n = len(g.axes)
    kinds = [a.get("type") if isinstance(a, dict) else None for a in axes]
    vector = next((i for i, k in enumerate(kinds) if k in VECTORS), n - 1)
    absolute = VECTORS.get(kinds[vector], False) if kinds else False
    keep = [i for i in range(n) if i != vector]
    try:  # of the grid's axes and the vectors', or of the grid's alone
        whole = _product(steps, n)
        place = Affine.of(np.array(whole.matrix)[np.ix_(keep, keep)], np.array(whole.offset)[keep])
    except (ValueError, IndexError):
        place = _product(steps, n - 1)
    parts = [F.max(F.when(F.col(g.axes[vector]) == k, F.col("v"))).alias(f"d{k}") for k in range(g.meta.shape[vector])]
    lattice = g.df.groupBy(*[F.col(g.axes[i]).alias(f"g{k}") for k, i in enumerate(keep)]).agg(*parts)
    return Field(lattice, tuple(g.meta.shape[i] for i in keep), place.inverse(), absolute, order)


def stored_transforms(spark: SparkSession, root: str):
    """For ``parse``: what a document's ``path`` names, a field or the numbers of a matrix."""

    def opened(kind: str, path: str, spec: dict):
        if kind in ("displacements", "coordinates"):
            f = open_field(spark, _joined(root, path), 0 if spec.get("interpolation") == "nearest" else 1)
            return replace(f, absolute=kind == "coordinates")
        g = stores.read(spark, _joined(root, path))  # the numbers of one matrix
        numbers = np.zeros(g.meta.shape)
        for *at, v in g.df.select(*g.axes, "v").collect():
            numbers[tuple(at)] = v
        return numbers.tolist()

    return opened


def _node(ref, base: str) -> str:
    """A system's name in a scene: ``path#name``, the path empty for the scene's own systems."""
    if isinstance(ref, dict):
        return f"{(ref.get('path') or base).strip('/')}#{ref.get('name') or ''}"
    return f"{base}#{ref or ''}"


def read_scene(spark: SparkSession, path: str) -> Scene:
    """The systems and transforms of a scene's document, with those of every image that it names; ``path#name`` names a system."""
    attrs = attributes(spark, path)
    own = attrs.get("scene") or (attrs if "coordinateTransformations" in attrs else {})
    edges = own.get("coordinateTransformations") or []
    images = dict.fromkeys(str(r["path"]).strip("/") for e in edges for r in (e.get("input"), e.get("output")) if isinstance(r, dict) and r.get("path"))
    sizes = {_node(s["name"], ""): len(s.get("axes") or []) for s in own.get("coordinateSystems") or []}
    listed = [(path, "", edges)]
    for image in images:
        group = (attributes(spark, _joined(path, image)).get("multiscales") or [{}])[0]
        sizes |= {_node(s["name"], image): len(s.get("axes") or []) for s in group.get("coordinateSystems") or []}
        listed.append((_joined(path, image), image, group.get("coordinateTransformations") or [] if group.get("coordinateSystems") else []))
    scene = Scene()
    for root, base, transforms in listed:
        for t in transforms:
            a, b = _node(t.get("input"), base), _node(t.get("output"), base)
            if a.endswith("#") or b.endswith("#"):
                raise ValueError(f"a transform of the scene at {path} names no input or no output")
            n_in, n_out = sizes.get(a), sizes.get(b)
            scene.add(a, b, parse(t, n_in, stored_transforms(spark, root), n_out))
    return scene


def open_scene(spark: SparkSession, path: str, image: str, target: str, onto: ArrayMeta | None = None, order: int | None = None, approximate: bool = False) -> list[Grid]:
    """An image of a scene in another of its systems, level by level.

    ``target`` is ``path#name``. The grid is ``onto``, else the levels of the image that the target belongs to, else the image's own levels.
    """
    levels = open_levels(spark, _joined(path, image))
    intrinsic = _intrinsic(spark, _joined(path, image))
    back: Transform = read_scene(spark, path).transform(target, f"{image.strip('/')}#{intrinsic}", approximate)
    owner = target.partition("#")[0]
    grids = [onto] if onto else [g.meta for g in (open_levels(spark, _joined(path, owner)) if owner else levels)]
    # of the image's levels the coarsest that has no larger voxels than the grid asks for
    size = lambda m: float(np.prod([v for a, v in zip(m.axes, m.voxel_size, strict=True) if a in SPATIAL] or m.voxel_size))
    fit = lambda m: max((g for g in levels if size(g.meta) <= size(m) * (1 + 1e-6)), key=lambda g: size(g.meta), default=levels[0])
    return [resample(fit(m), m, back, order) for m in grids]


def _intrinsic(spark: SparkSession, path: str) -> str:
    """The name of the system that an image's levels are placed in."""
    group = attributes(spark, path)["multiscales"][0]
    first = (group["datasets"][0].get("coordinateTransformations") or [{}])[0].get("output")
    name = first.get("name") if isinstance(first, dict) else first
    systems = [s["name"] for s in group.get("coordinateSystems") or [{"name": "physical"}]]
    return name if name in systems else systems[0]


def place_by_coordinates(grid: Grid, coordinates: dict[str, DataFrame], rtol: float = 0.01) -> Grid:
    """Voxel sizes and places from 1-D coordinates, tables of index ``i`` and coordinate ``v``, by axis.

    An axis whose coordinates are not evenly spaced (within ``rtol``) and increasing, or too few or too many, keeps what it has.
    """
    size, place = list(grid.meta.voxel_size), list(grid.meta.translation)
    for axis, rows in coordinates.items():
        k, n = grid.axes.index(axis), grid.length(axis)
        ends = F.min(F.struct("i", "v")).alias("a"), F.max(F.struct("i", "v")).alias("z"), F.count("v").alias("n")
        r = rows.where("v is not null").agg(*ends).first()
        if r.n != n or n < 2:
            continue
        step = (r.z.v - r.a.v) / (n - 1)
        if not step > 0:
            continue
        ideal = F.lit(float(r.a.v)) + (F.col("i") - F.lit(r.a.i)) * F.lit(float(step))
        if rows.agg(F.max(F.abs(F.col("v") - ideal))).first()[0] <= rtol * step:
            size[k], place[k] = step, r.a.v
    return Grid(grid.df, replace(grid.meta, voxel_size=tuple(size), translation=tuple(place)))

