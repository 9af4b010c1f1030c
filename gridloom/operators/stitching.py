"""Tiles put together: overlaps, matched points, translations, fused images."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.neighbours import nearest_join
from ..functions.scalar import half_cosine
from ..geometry.transforms import Affine
from ..grid import Grid
from ..meta import Box
from ..storage import stored
from .fitting import placed_tiles, ransac


def tile_overlaps(tiles: DataFrame, axes: tuple[str, ...], margin: float = 0.0, cell: float | None = None) -> DataFrame:
    """Pairs of tiles (``tile``, ``lo_<axis>``, ``hi_<axis>``) whose boxes, grown by ``margin``, overlap: ``a`` < ``b`` and the overlap's box.

    Tiles are binned by cells of all axes, so that only tiles of one cell are compared; a pair counts in the cell where its overlap begins.
    """
    cell = cell or 256.0
    grown = tiles.select("tile", *[(F.col(f"lo_{a}") - margin).alias(f"lo_{a}") for a in axes], *[(F.col(f"hi_{a}") + margin).alias(f"hi_{a}") for a in axes])
    binned, keys = grown, [f"cell_{a}" for a in axes]
    for ax, key in zip(axes, keys, strict=True):
        binned = binned.withColumn(key, F.explode(F.sequence(F.floor(F.col(f"lo_{ax}") / cell), F.floor(F.col(f"hi_{ax}") / cell))))
    left = binned.select(*keys, F.col("tile").alias("a"), *[F.col(c).alias(f"a_{c}") for c in grown.columns[1:]])
    right = binned.select(*keys, F.col("tile").alias("b"), *[F.col(c).alias(f"b_{c}") for c in grown.columns[1:]])
    met = left.join(right, keys).where("a < b")
    for ax, key in zip(axes, keys, strict=True):
        met = met.where((F.col(f"a_lo_{ax}") < F.col(f"b_hi_{ax}")) & (F.col(f"b_lo_{ax}") < F.col(f"a_hi_{ax}")))
        met = met.where(F.floor(F.greatest(f"a_lo_{ax}", f"b_lo_{ax}") / cell) == F.col(key))
    boxes = [c for ax in axes for c in (F.greatest(f"a_lo_{ax}", f"b_lo_{ax}").alias(f"lo_{ax}"), F.least(f"a_hi_{ax}", f"b_hi_{ax}").alias(f"hi_{ax}"))]
    return met.select("a", "b", *boxes)


def _apart(df: DataFrame, other: DataFrame, xs: list[str]) -> float:
    """A distance that is further than any two points of one group are: what parts groups in one more coordinate."""
    row = df.select(*xs).unionByName(other.select(*xs)).agg(*[f(x) for x in xs for f in (F.min, F.max)]).first()
    return 2.0 * sum((row[2 * i + 1] or 0.0) - (row[2 * i] or 0.0) for i in range(len(xs))) + 1.0


def nearest(points: DataFrame, axes: tuple[str, ...], k: int, reach: float | None = None) -> DataFrame:
    """Each point's ``k`` nearest others of its tile, at any distance or within ``reach``: ``tile``, ``id``, ``nth``, offsets ``d_<axis>``."""
    # numbers in the order of ids, so that ties fall alike however the table is parted
    own = stored(points.orderBy("tile", "id").select(F.monotonically_increasing_id().alias("uid"), F.col("tile").cast("long").alias("tile"), "id", *[F.col(a).cast("double").alias(a) for a in axes]), "points")
    apart = _apart(own, own, list(axes))
    placed = own.select(F.col("uid").alias("id"), F.array(F.col("tile") * apart, *axes).alias("x"))
    found = nearest_join(placed, placed, k, others=True).where(F.col("d2") < apart * apart)
    if reach is not None:
        found = found.where(F.col("d2") <= reach * reach)
    other = own.select(F.col("uid").alias("point"), *[F.col(a).alias(f"o_{a}") for a in axes])
    met = found.join(own.withColumnRenamed("uid", "query"), "query").join(other, "point")
    return met.select("tile", "id", "nth", *[(F.col(f"o_{a}") - F.col(a)).alias(f"d_{a}") for a in axes])


def descriptors(points: DataFrame, axes: tuple[str, ...], neighbours: int = 3, reach: float | None = None, redundancy: int = 0) -> DataFrame:
    """For each point the offsets to ``neighbours`` of its nearest ``neighbours + redundancy``, one array for every such choice; points with fewer have none."""
    most = neighbours + redundancy
    near = nearest(points, axes, most, reach)
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.array(*[F.col(f"d_{a}") for a in axes]).alias("d")))), lambda s: s["d"])
    rows = near.groupBy("tile", "id").agg(F.count("*").alias("n"), sorted_.alias("all")).where(F.col("n") == most)
    choices = F.array(*[F.concat(*[F.col("all")[i] for i in c]) for c in combinations(range(most), neighbours)])
    return rows.join(points.select("tile", "id", *axes), ["tile", "id"]).select("tile", "id", *axes, F.explode(choices).alias("shape"))


def match(a: DataFrame, b: DataFrame, axes: tuple[str, ...], significance: float = 3.0, group: bool = False) -> DataFrame:
    """Points whose descriptors are mutually nearest, and ``significance`` times nearer than any other point's: ``ia``, ``ib``, ``p_<axis>``, ``q_<axis>``.

    Nearest and second nearest are sought among all descriptors, at any distance. With ``group`` a tile of ``a`` is matched with the tile of that number of ``b`` only, and
    ``tile`` is returned too.
    """
    sides, most = [], 1
    for df in (a, b):
        own = df.orderBy("tile", "id").select(F.monotonically_increasing_id().alias("did"), (F.col("tile") if group else F.lit(0)).cast("long").alias("tile"), "id", *axes, "shape")
        sides.append(stored(own, "descriptors"))
        most = max(most, sides[-1].groupBy("tile", "id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1)
    size = sides[0].select(F.size("shape")).union(sides[1].select(F.size("shape"))).first()
    if size is None:
        empty = a.select(F.col("id").alias("ia"), F.col("id").alias("ib"), *[F.col(x).alias(f"p_{x}") for x in axes], *[F.col(x).alias(f"q_{x}") for x in axes])
        return (empty.withColumn("tile", F.lit(0).cast("long")) if group else empty).where("false")
    flat = [s.select("tile", *[F.col("shape")[i].alias(f"x{i}") for i in range(size[0])]) for s in sides]
    apart = _apart(*flat, [f"x{i}" for i in range(size[0])])
    x = F.concat(F.array(F.col("tile") * apart), F.col("shape")).alias("x")
    placed = [s.select(F.col("did").alias("id"), x) for s in sides]

    def towards(one: int, other: int) -> DataFrame:
        """The distance of each point to the points that its descriptors come nearest to, ranked."""
        met = nearest_join(placed[one], placed[other], most + 1).where(F.col("d2") < apart * apart)
        met = met.join(sides[one].select(F.col("did").alias("query"), "tile", F.col("id").alias("own")), "query").join(sides[other].select(F.col("did").alias("point"), F.col("id").alias("other")), "point")
        pairs = met.groupBy("tile", "own", "other").agg(F.min("d2").alias("d2"))
        by = Window.partitionBy("tile", "own").orderBy("d2", "other")
        return pairs.withColumns({"nth": F.row_number().over(by), "second": F.lead("d2").over(by)}).where("nth = 1")

    ab, ba = towards(0, 1), towards(1, 0).select("tile", F.col("own").alias("other"), F.col("other").alias("own"))
    kept = ab.where(F.col("second").isNull() | (F.col("d2") * significance**2 <= F.col("second"))).join(ba, ["tile", "own", "other"], "left_semi")
    ends = [s.select("tile", F.col("id").alias(i), *[F.col(c).alias(f"{n}_{c}") for c in axes]).dropDuplicates(["tile", i]) for s, i, n in zip(sides, ("own", "other"), "pq", strict=True)]
    out = kept.join(ends[0], ["tile", "own"]).join(ends[1], ["tile", "other"])
    return out.select(*(["tile"] if group else []), F.col("own").alias("ia"), F.col("other").alias("ib"), *[f"p_{c}" for c in axes], *[f"q_{c}" for c in axes])


def vote_translation(matches: DataFrame, axes: tuple[str, ...], epsilon: float = 5.0) -> DataFrame:
    """The translation most matches agree on, refitted to them: ``t_<axis>``, ``inliers``.

    Every match votes for the cell of its own offset and for those next to it; the cell with most votes is the model that random
    trials would look for, found in one aggregation.
    """
    off = matches.select(*[(F.col(f"q_{a}") - F.col(f"p_{a}")).alias(f"t_{a}") for a in axes])
    votes = off
    for a in axes:
        c = F.floor(F.col(f"t_{a}") / epsilon)
        votes = votes.withColumn(f"c_{a}", F.explode(F.array(c - 1, c, c + 1)))
    cells = votes.groupBy(*[f"c_{a}" for a in axes]).agg(F.count("*").alias("n"), *[F.avg(f"t_{a}").alias(f"m_{a}") for a in axes])
    best = cells.orderBy(F.desc("n"), *[f"c_{a}" for a in axes]).limit(1)
    near = off.join(F.broadcast(best))  # one row
    for a in axes:
        near = near.where(F.abs(F.col(f"t_{a}") - F.col(f"m_{a}")) <= epsilon)
    return near.agg(*[F.avg(f"t_{a}").alias(f"t_{a}") for a in axes], F.count("*").alias("inliers"))


def fuse(tiles: list[tuple[Grid, tuple[int, ...]]], band: float = 8.0, box: Box | None = None) -> DataFrame:
    """Tiles at whole-voxel places, weighted by half a cosine from their faces on the last two axes: coordinates and ``v``.

    Of a ``box`` of the fused array only tiles that reach it are read, and of those only what lies in it.
    """
    axes, parts = tiles[0][0].axes, []
    for grid, place in tiles:
        if box is not None:
            own = box.moved(tuple(-p for p in place)).clip(grid.meta.shape)
            if own.empty:
                continue
            part = grid.read(own).df
        else:
            part = grid.df
        weight = F.lit(1.0)
        for a in axes[-2:]:
            n = grid.length(a)
            weight = weight * half_cosine(F.least(F.col(a) + 0.5, F.lit(n - 0.5) - F.col(a)), band)
        parts.append(part.select(*[(F.col(a) + p).alias(a) for a, p in zip(grid.axes, place, strict=True)], (F.col("v") * weight).alias("wv"), weight.alias("w")))
    if not parts:
        return tiles[0][0].df.where("false").select(*axes, F.col("v").cast("double").alias("v"))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(*axes).agg((F.sum("wv") / F.sum("w")).alias("v"))


def stitch(tiles: DataFrame, points: DataFrame, axes: tuple[str, ...], margin: float = 0.0, model: str = "translation", epsilon: float = 5.0, neighbours: int = 3, redundancy: int = 1, significance: float = 3.0, least: int = 6, ratio: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The whole run: corrections of tiles, and a report of every overlapping pair.

    ``tiles`` are boxes as in ``tile_overlaps``, ``points`` (``tile``, ``id``, axes) interest points where the stage put them. Of each pair the points within the overlap are matched,
    a ``model`` is fitted to the matches that agree on one, and all tiles are moved at once so that kept pairs agree (``placed_tiles``).

    Corrections: ``tile``, ``t_<axis>``, ``joined`` (whether a kept pair holds it). Report: ``a``, ``b``, ``points_a``, ``points_b``, ``candidates``, ``inliers``, ``kept``,
    ``error`` and ``error_max`` (distance of the corrected ends of its inliers; null for pairs that are not kept), ``dropped`` (its link contradicted others).
    """
    pairs = stored(tile_overlaps(tiles, axes, margin).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = []
    for side in ("a", "b"):
        met = points.join(pairs, points["tile"] == pairs[side])
        for x in axes:
            met = met.where((F.col(x) >= F.col(f"lo_{x}")) & (F.col(x) <= F.col(f"hi_{x}")))
        sides.append(stored(met.select(F.col("pair").alias("tile"), "id", *axes), "overlap-points"))
    shapes = [descriptors(p, axes, neighbours, None, redundancy) for p in sides]
    matches = stored(match(*shapes, axes, significance, group=True).withColumnRenamed("tile", "pair"), "matches")
    fits = stored(ransac(matches, axes, model, epsilon, least=least, ratio=ratio, seed=seed, group="pair"), "fits")
    near = stored(_inliers_of(matches, fits.where("kept"), axes, epsilon), "inliers")
    means = [F.avg(f"{n}_{x}").alias(f"{n}_{x}") for n in "pq" for x in axes]
    links = near.groupBy("pair").agg(F.count("*").alias("weight"), *means).join(pairs.select("pair", "a", "b"), "pair")
    links = links.select("a", "b", "pair", F.col("weight").cast("double").alias("weight"), *[(F.col(f"p_{x}") - F.col(f"q_{x}")).alias(f"o_{x}") for x in axes])
    placed, used = placed_tiles(tiles.select("tile"), links, axes, epsilon)
    ends = near.join(pairs.select("pair", "a", "b"), "pair")
    for side in ("a", "b"):
        ends = ends.join(placed.select(F.col("tile").alias(side), *[F.col(f"t_{x}").alias(f"{side}_{x}") for x in axes]), side)
    gap = F.sqrt(sum(((F.col(f"p_{x}") + F.col(f"a_{x}") - F.col(f"q_{x}") - F.col(f"b_{x}")) ** 2 for x in axes), F.lit(0.0)))
    errors = ends.groupBy("pair").agg(F.avg(gap).alias("error"), F.max(gap).alias("error_max"))
    counts = [p.groupBy(F.col("tile").alias("pair")).agg(F.count("*").alias(f"points_{s}")) for p, s in zip(sides, "ab", strict=True)]
    out = pairs.select("pair", "a", "b")
    for more in (*counts, fits.select("pair", F.col("n").alias("candidates"), "inliers", "kept"), errors, used.select("pair", F.col("dropped"))):
        out = out.join(more, "pair", "left")
    zero = ("points_a", "points_b", "candidates", "inliers")
    report = out.select("a", "b", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero], F.coalesce("kept", F.lit(False)).alias("kept"), "error", "error_max", F.coalesce("dropped", F.lit(False)).alias("dropped"))
    return placed, report


def _inliers_of(matches: DataFrame, fits: DataFrame, axes: tuple[str, ...], epsilon: float) -> DataFrame:
    """Matches that the model of their pair brings within ``epsilon``."""
    d = len(axes)
    rows = matches.join(fits.select("pair", "model"), "pair")
    off = [sum((F.col(f"p_{b}") * F.col("model")[i * (d + 1) + j] for j, b in enumerate(axes)), F.col("model")[i * (d + 1) + d]) - F.col(f"q_{a}") for i, a in enumerate(axes)]
    return rows.where(sum((o * o for o in off), F.lit(0.0)) <= epsilon * epsilon).drop("model")


@dataclass(frozen=True)
class Tile:
    """A tile of a project: its name, shape and voxel size (z, y, x), and where the stage put it, from voxels to the world."""

    setup: int
    name: str
    shape: tuple[int, ...]
    voxel_size: tuple[float, ...]
    stage: Affine


#: Fixed value: the name of what a stitching run adds to the stage's own placement.
STITCHED = "Stitching Transform"


def tiles_of_project(xml: str, channel: int = 0, timepoint: int = 0) -> list[Tile]:
    """The tiles of one channel in a stitching project's XML, without what earlier stitching added outermost.

    Projects list axes as x, y, z and the outermost transform first.
    """
    root = ElementTree.fromstring(xml)
    numbers = lambda text, kind=float: tuple(map(kind, text.split()))
    flip = np.eye(3)[::-1]
    placed = {}
    for view in root.iter("ViewRegistration"):
        if int(view.get("timepoint", 0)) != timepoint:
            continue
        steps = [(t.findtext("Name", "").strip(), np.array(numbers(t.findtext("affine"))).reshape(3, 4)) for t in view.findall("ViewTransform")]
        if steps and steps[0][0] == STITCHED:
            steps = steps[1:]
        inward = [Affine.of(flip @ m[:, :3] @ flip, flip @ m[:, 3]) for _, m in reversed(steps)]
        placed[int(view.get("setup"))] = reduce(Affine.then, inward, Affine.of(np.eye(3)))
    out = []
    for s in root.iter("ViewSetup"):
        number = int(s.findtext("id"))
        if int(s.findtext("attributes/channel", "0")) == channel and number in placed:
            size = numbers(s.findtext("voxelSize/size", "1 1 1"))[::-1]
            out.append(Tile(number, s.findtext("name", ""), numbers(s.findtext("size"), int)[::-1], size, placed[number]))
    return out
