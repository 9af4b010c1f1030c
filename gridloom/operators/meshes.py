"""Surfaces of arrays."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import morton
from ..grid import Grid
from ..meta import ArrayMeta


def terrain_mesh(grid: Grid, exaggeration: float = 1.0, spacing: float = 1.0) -> DataFrame:
    """Two triangles for each cell of four finite heights: ``y``, ``x``, ``half``, three corners ``(z, y, x)``.

    A row's right and lower neighbours come from two windows; no join.
    """
    y, x = grid.axes
    rows = grid.df.select(F.col(y).alias("y"), F.col(x).alias("x"), (F.col("v") * exaggeration).alias("a")).withColumn("b", F.lead("a").over(Window.partitionBy("y").orderBy("x")))
    below = Window.partitionBy("x").orderBy("y")
    rows = rows.withColumns({"c": F.lead("a").over(below), "d": F.lead("b").over(below)}).where("b is not null and c is not null and d is not null")
    for k in "abcd":
        rows = rows.where(~F.isnan(k))

    def corner(k: str, dy: int, dx: int):
        return F.array(F.col(k), (F.col("y") + dy) * spacing, (F.col("x") + dx) * spacing)

    halves = F.array(F.struct(F.lit(0).alias("half"), corner("a", 0, 0).alias("p"), corner("c", 1, 0).alias("q"), corner("b", 0, 1).alias("r")), F.struct(F.lit(1).alias("half"), corner("b", 0, 1).alias("p"), corner("c", 1, 0).alias("q"), corner("d", 1, 1).alias("r")))
    return rows.select("y", "x", F.explode(halves).alias("h")).select("y", "x", "h.*")


def surface_faces(mask: Grid) -> DataFrame:
    """The faces between a mask's voxels and what is outside it: voxel, axis and side; the array's faces close it."""
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).cast("long").alias("side")) for a in mask.axes for s in (-1, 1)])
    here = mask.df.where("v > 0").select(*mask.axes)
    asked = here.select(*mask.axes, F.explode(sides).alias("f")).select(*mask.axes, "f.*")
    moved = asked.select("*", *[(F.col(a) + F.when(F.col("axis") == a, F.col("side")).otherwise(0)).alias(f"n_{a}") for a in mask.axes])
    there = here.select(*[F.col(a).alias(f"n_{a}") for a in mask.axes])
    return moved.join(there, [f"n_{a}" for a in mask.axes], "left_anti").select(*mask.axes, "axis", "side")


def surface_band(mask: Grid, reach: int = 2) -> DataFrame:
    """Voxels near the surface: within ``reach`` both set and unset voxels lie; outside the array nothing is set."""
    rows = mask.df.select(*mask.axes, (F.col("v") > 0).cast("long").alias("hi"), (F.col("v") > 0).cast("long").alias("lo"))
    for a in mask.axes:
        w = Window.partitionBy(*[b for b in mask.axes if b != a]).orderBy(a).rowsBetween(-reach, reach)
        inner = (F.col(a) >= reach) & (F.col(a) < mask.length(a) - reach)
        rows = rows.select(*mask.axes, F.max("hi").over(w).alias("hi"), F.when(inner, F.min("lo").over(w)).otherwise(0).alias("lo"))
    return rows.where("hi > lo").select(*mask.axes)


def octree_nodes(mask: Grid, size: int, levels: int) -> DataFrame:
    """Nodes of each level that hold surface, in Z-order: ``level``, ``order``, node coordinates and voxels of surface."""
    band = surface_band(mask)
    each = band.select(*mask.axes, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    at = [F.floor(F.col(a) / (F.lit(size) * F.expr("shiftleft(1, level)"))).cast("long").alias(a) for a in mask.axes]
    nodes = each.select("level", *at).groupBy("level", *mask.axes).agg(F.count("*").alias("surface"))
    return nodes.select("level", morton([F.col(a) for a in mask.axes], 16).alias("order"), *mask.axes, "surface")


def mesh_level(levels: list[ArrayMeta], most: int = 512) -> int:
    """The finest level with no side longer than ``most``, or else the coarsest."""
    return next((i for i, m in enumerate(levels) if max(m.shape) <= most), len(levels) - 1)


def cell_triangles(code: int) -> list[tuple[tuple[int, ...], ...]]:
    """The surface in a cell of eight corners, of which those in the bits of ``code`` are set: triangles, in halves of a cell.

    Corner ``i`` lies at the bits of ``i`` (4: z, 2: y, 1: x). A cell is cut into six tetrahedra, one for each order in which a
    way to the opposite corner takes the axes, so that cells cut the face between them alike. Triangles turn to the unset side.
    """
    at = lambda i: np.array([i >> 2 & 1, i >> 1 & 1, i & 1])
    out = []
    for first, second, third in permutations((4, 2, 1)):
        corners = [0, first, first | second, first | second | third]
        held, free = ([c for c in corners if (code >> c & 1) == side] for side in (1, 0))
        if not held or not free:
            continue
        cut = [[tuple((at(h) + at(f)).tolist()) for f in free] for h in held]  # middles of edges between the sides
        if len(held) == 2:
            (a, b), (c, d) = cut
            found = [(a, b, d), (a, d, c)]
        else:
            found = [tuple(p for row in cut for p in row)]
        outward = np.mean([at(c) for c in free], axis=0) - np.mean([at(c) for c in held], axis=0)
        for p, q, r in found:
            turned = np.cross(np.subtract(q, p), np.subtract(r, p)) @ outward < 0
            out.append((p, r, q) if turned else (p, q, r))
    return out


def surface(mask: Grid) -> DataFrame:
    """Triangles between a mask's set voxels and all others: the cell (its lowest corner's voxel), ``part``, corners ``p``, ``q``, ``r`` in voxels.

    Set voxels alone are dealt out to the eight cells that they are corners of, so work follows the mask; the array's faces
    close the surface. The table of triangles has a fixed number of rows.
    """
    z, y, x = mask.axes
    corner = [F.struct((F.col(z) - (i >> 2 & 1)).alias(z), (F.col(y) - (i >> 1 & 1)).alias(y), (F.col(x) - (i & 1)).alias(x), F.lit(1 << i).alias("bit")) for i in range(8)]
    cells = mask.df.where("v > 0").select(F.explode(F.array(*corner)).alias("c")).select("c.*")
    codes = cells.groupBy(z, y, x).agg(F.bit_or("bit").alias("code")).where("code < 255")
    rows = [(code, k, *[[float(v) / 2 for v in p] for p in t]) for code in range(1, 255) for k, t in enumerate(cell_triangles(code))]
    table = mask.df.sparkSession.createDataFrame(rows, "code int, part long, p array<double>, q array<double>, r array<double>")
    met = codes.join(F.broadcast(table), "code")
    moved = [F.array(*[F.col(k)[i] + F.col(a) for i, a in enumerate((z, y, x))]).alias(k) for k in "pqr"]
    return met.select(z, y, x, "part", *moved)


def fragments(mask: Grid) -> DataFrame:
    """The surface by chunk, encoded: ``chunk_<axis>``, ``vertices``, ``triangles``, ``data``.

    Little-endian: number of vertices (32 bits), their places in the world as x, y, z (32-bit floats), three 32-bit numbers of
    vertices a triangle. A cell goes to its lowest corner's chunk, one below the array to the first.
    """
    axes, meta = mask.axes, mask.meta
    keys = [f"chunk_{a}" for a in axes]
    ids = [F.floor(F.greatest(F.col(a), F.lit(0)) / c).cast("long").alias(k) for a, c, k in zip(axes, meta.chunk, keys, strict=True)]
    tri = surface(mask).select(*ids, *axes, "part", *[F.col(k)[i].alias(f"{k}{i}") for k in "pqr" for i in range(3)])
    corners = [f"{k}{i}" for k in "pqr" for i in range(3)]
    size, place = np.array(meta.voxel_size), np.array(meta.translation)

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*axes, "part"])
        points, index = np.unique(part[corners].to_numpy().reshape(-1, 3), axis=0, return_inverse=True)
        world = (points * size + place)[:, ::-1].astype("<f4")
        data = np.array([len(points)], "<u4").tobytes() + world.tobytes() + index.reshape(-1).astype("<u4").tobytes()
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "vertices": [len(points)], "triangles": [len(part)], "data": [data]})

    return tri.groupBy(*keys).applyInPandas(encode, ", ".join(f"{k} long" for k in keys) + ", vertices long, triangles long, data binary")


def quantized(triangles: DataFrame, axes: tuple[str, ...], size: int, bits: int = 16) -> DataFrame:
    """Triangles by node of ``size`` cells a side, corners as whole numbers of ``bits`` from the node's low face to its high one.

    Nodes count from the cell one below the array, the lowest that can hold surface, so none is cut.
    """
    node = {a: F.floor((F.col(a) + 1) / size).cast("long") for a in axes}
    top = (1 << bits) - 1
    step = lambda k, i, a: F.rint((F.col(k)[i] + 1 - node[a] * size) / size * top).cast("long")
    return triangles.select(*[node[a].alias(f"node_{a}") for a in axes], *axes, "part", *[F.array(*[step(k, i, a) for i, a in enumerate(axes)]).alias(k) for k in "pqr"])
