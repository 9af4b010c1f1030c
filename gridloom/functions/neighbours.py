"""Nearest neighbours, exactly, by a join that adapts to where the points lie.

Points in one place are one spot, which holds as many of their ids as a query can ask for; queries in one place ask once. Space is cut by a k-d tree of a
bounded sample of the spots, so leaves hold like numbers of them wherever they crowd. A query first meets the spots of its own leaf; the distance of the last
neighbour found there is a bound, and the query then meets the spots of every other leaf within it. Leaves, and queries in one leaf, are dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import stored

#: Spots of a leaf, and of a block that is compared at once; spots that the tree is made from, so leaves number an eighth of it at most.
LEAF = 2048
SAMPLE = 100_000


@dataclass(frozen=True)
class KdTree:
    """Cuts by level: node ``i`` of a level has the children ``2 i`` and ``2 i + 1`` of the next; leaves are the nodes of the last."""

    axes: tuple[np.ndarray, ...]
    cuts: tuple[np.ndarray, ...]

    @staticmethod
    def of(sample: np.ndarray, depth: int) -> KdTree:
        """Halves of the sample, each across the axis where it is widest."""
        axes, cuts, parts = [], [], [sample]
        for _ in range(depth):
            axis = np.array([int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0 for p in parts])
            cut = np.array([_cut(p[:, a]) if len(p) else 0.0 for p, a in zip(parts, axis, strict=True)])
            axes.append(axis)
            cuts.append(cut)
            parts = [q for p, a, c in zip(parts, axis, cut, strict=True) for q in (p[p[:, a] <= c], p[p[:, a] > c])]
        return KdTree(tuple(axes), tuple(cuts))

    @property
    def leaves(self) -> int:
        return 1 << len(self.cuts)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for axis, cut in zip(self.axes, self.cuts, strict=True):
            node = 2 * node + (x[row, axis[node]] > cut[node])
        return node

    def within(self, x: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf whose cell is within a row's squared radius."""
        row, node, off = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(x.shape)
        for axis, cut in zip(self.axes, self.cuts, strict=True):
            along = axis[node]
            by = x[row, along] - cut[node]
            far = off.copy()
            far[np.arange(len(row)), along] = np.abs(by)
            go = (far * far).sum(axis=1) <= radius2[row]
            near = 2 * node + (by > 0)
            row, node, off = np.concatenate([row, row[go]]), np.concatenate([near, (near ^ 1)[go]]), np.concatenate([off, far[go]])
        return row, node


def _cut(x: np.ndarray) -> float:
    """The median, or what comes next below it where nothing lies above, so that neither half is empty."""
    cut, top = float(np.median(x)), x.max()
    return float(x[x < top].max()) if cut == top and x.min() < top else cut


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _as_lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _best(queries, x, points, y, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` nearest of a block of points: query, point, squared distance."""
    d2 = np.zeros((len(x), len(y)))
    for a in range(x.shape[1]):
        d2 += (x[:, a, None] - y[None, :, a]) ** 2
    n = min(k, len(points))
    # of equals those with the smallest ids: all that are as near as the n-th are looked at
    last = np.partition(d2, n - 1, axis=1)[:, n - 1]
    row, col = np.nonzero((d2 <= last[:, None]) & np.isfinite(d2))
    order = np.lexsort((points[col], d2[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[nth < n], col[nth < n]
    return queries[row], points[col], d2[row, col]


def _meeting(k: int):
    """Rows (``key``, ``side``, ``id``, ``x``) in order of ``key``: queries (side 0) meet the points of their key (side 1)."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        side, ids, x = np.asarray(t["side"]), np.asarray(t["id"]), _matrix(t["x"])
        q, p = side == 0, side == 1
        for at in range(0, int(q.sum()) if p.any() else 0, 512):
            own = np.flatnonzero(q)[at : at + 512]
            found = _best(ids[own], x[own], ids[p], x[p], k)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["query", "point", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            if not len(keys):
                continue
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if keys[a] != key and held:
                    yield from solve(held)
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(held)

    return run


def _meet(asks: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """``asks`` (``leaf``, ``id``, ``x``) meet ``placed`` points of their leaf, block by block."""
    size = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).cast("int").alias(name))
    blocks = stored(size(asks, "rows").join(size(placed, "cols"), "leaf"), "blocks")
    number = lambda row, col: F.col("leaf") * (1 << 40) + row.cast("long") * (1 << 20) + col.cast("long")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(blocks, "leaf").withColumn("row", of("rows")).withColumn("col", every("cols")).select(number(F.col("row"), F.col("col")).alias("key"), F.lit(0).alias("side"), "id", "x")
    right = placed.join(blocks, "leaf").withColumn("col", of("cols")).withColumn("row", every("rows")).select(number(F.col("row"), F.col("col")).alias("key"), F.lit(1).alias("side"), "id", "x")
    dealt = left.unionByName(right).repartition("key").sortWithinPartitions("key", "side")
    return dealt.mapInArrow(_meeting(k), "query long, point long, d2 double")


def _first(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query").orderBy("d2", "point"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def nearest_join(queries: DataFrame, points: DataFrame, k: int, others: bool = False) -> DataFrame:
    """``query``, ``nth`` (from 1), ``point``, ``d2``: the ``k`` nearest points of every query, at any distance, of equals the smallest ids.

    Both tables have ``id`` (long, of its own for each row) and ``x`` (array<double> of one length). With ``others`` a point of the query's own id does not
    count. A query gets fewer rows where there are fewer points. The tree is made of ``SAMPLE`` spots at most; it decides how the work is parted, not what is found.

    However many points share a place, only the smallest ids there can be among a query's nearest, and all queries of a place have the same nearest but for their own id.
    """
    most = k + others  # a query's own point may be among them
    nth = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    firsts = points.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    spots = stored(firsts.select(F.col("ids")[0].alias("id"), "x", "ids"), "spots")
    asking = stored(queries.groupBy("x").agg(F.min("id").alias("id")).select("id", "x"), "asking")
    found = _nearest_spots(asking, spots.select("id", "x"), most)
    each = found.join(spots.select(F.col("id").alias("point"), "ids"), "point").select("query", F.explode("ids").alias("point"), "d2")
    near = each.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "point"))), 1, most).alias("near"))
    answers = stored(near.join(asking, near["query"] == asking["id"]).select("x", "near"), "answers")
    own = queries.join(answers, "x").select(F.col("id").alias("query"), "near")
    if others:
        own = own.withColumn("near", F.slice(F.filter("near", lambda p: p["point"] != F.col("query")), 1, k))
    listed = own.select("query", F.posexplode("near").alias("at", "p"))
    return listed.select("query", (F.col("at") + 1).alias("nth"), "p.point", "p.d2")


def _nearest_spots(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """``query``, ``point``, ``d2`` of ``nearest_join`` where no two queries and no two points lie in one place; both are tables in the shared folder."""
    n = points.count()
    if not n:
        return queries.select(F.col("id").alias("query"), F.col("id").alias("point"), F.lit(0.0).alias("d2")).where("false")
    drawn = points if n <= SAMPLE else points.sample(min(1.0, 1.2 * SAMPLE / n), seed=7)
    sample = np.array([r["x"] for r in drawn.select("x").limit(SAMPLE).collect()], float)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / LEAF)))), int(np.log2(max(1, len(sample) / 8)))))
    tree, d = KdTree.of(sample, depth), sample.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_matrix(batch.column("x")))), batch.column("id"), batch.column("x")], names=["leaf", "id", "x"])

    schema = "leaf long, id long, x array<double>"
    placed = stored(points.mapInArrow(place, schema), "placed")
    found = stored(_first(_meet(queries.mapInArrow(place, schema), placed, k), k), "near")
    sides = [f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
    boxes = sorted(placed.groupBy("leaf").agg(F.count("*").alias("n"), *sides).collect(), key=lambda r: r["leaf"])  # an eighth of the sample at most
    held = np.array([r["leaf"] for r in boxes])
    counts, low, high = np.array([r["n"] for r in boxes]), *(np.array([[r[f"{s}{i}"] for i in range(d)] for r in boxes]) for s in ("lo", "hi"))
    index = np.full(tree.leaves, -1)
    index[held] = np.arange(len(held))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, bound = _matrix(batch.column("x")), batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            for i in np.flatnonzero(np.isnan(bound)).tolist():  # too few in its leaf: as far as the boxes that surely hold enough
                far = (np.maximum(np.abs(x[i] - low), np.abs(x[i] - high)) ** 2).sum(axis=1)
                order = np.argsort(far)
                enough = int(np.searchsorted(np.cumsum(counts[order]), k))
                bound[i] = far[order[enough]] if enough < len(order) else np.inf
            bound = bound * (1 + 1e-12)  # rounding may put a point a little further than its cell
            row, leaf = tree.within(x, bound)
            own = tree.leaf(x)
            box = index[leaf]
            row, leaf, box = (v[(box >= 0) & (leaf != own[row])] for v in (row, leaf, box))
            gap = np.maximum(np.maximum(low[box] - x[row], x[row] - high[box]), 0)
            ok = (gap * gap).sum(axis=1) <= bound[row]
            yield pa.RecordBatch.from_arrays([pa.array(leaf[ok]), batch.column("id").take(pa.array(row[ok])), _as_lists(x[row[ok]])], names=["leaf", "id", "x"])

    last = found.groupBy("query").agg(F.count("*").alias("n"), F.max("d2").alias("d2")).select(F.col("query").alias("id"), F.when(F.col("n") >= k, F.col("d2")).alias("bound"))
    asks = stored(queries.join(last, "id", "left").select("id", "x", "bound").mapInArrow(widen, schema), "asks")
    more = _meet(asks, placed, k)
    return _first(found.select("query", "point", "d2").unionByName(more), k).select("query", "point", "d2")
