"""Embedding near-dedup by NN-descent.

A graph of each vector's nearest neighbours is refined by joins with the neighbours' neighbours until an audit against brute
force finds it complete. Lists that are full of links are enlarged: to their component's vectors, and to those of other components
that can be near enough, compared block by block, so that a group of any size gives counts, never pairs. Edges at or above the threshold are kept, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored
from ..functions.components import connected_components

#: Neighbours in a list, rounds at most, and the recall of links that ends the rounds.
NEIGHBOURS = 12
ROUNDS = 8
RECALL = 0.99
#: The audit asks so many vectors each of large and of small components, and of those in none at least so many and at most so many.
AUDITED = 400
AUDITED_LOOSE = 20_000
#: Rows compared together, in the first lists and in components.
FIRST_BLOCK = 1024
BLOCK = 256
#: Directions of a cross-polytope hash: which of them a vector is most along, or against, is log2(2 * DIRECTIONS) bits of its place.
DIRECTIONS = 16


def usable(v: Column) -> Column:
    """Whether a vector can link: not null, all components finite, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(values: np.ndarray) -> np.ndarray:
    big = np.abs(values).max(axis=1, keepdims=True)
    x = values / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, kind).reshape(len(column), -1)


def _edges(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.asarray(sim, np.float64))], names=["a", "b", "sim"])


def _best_of_block(ids: np.ndarray, x: np.ndarray, k: int):
    """For each row of a block its k most alike others."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    if not k:
        return ids[:0], ids[:0], sim[0, :0]
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    top = top.ravel()
    return ids[rows], ids[top], sim[rows, top]


def orders_for(n: int, missed: float = 0.005) -> int:
    """How many orders of ``n`` vectors leave a pair at cosine 0.9 apart in all of them with a chance of ``missed``.

    In one order such a pair is in one block with a chance that was measured, on random vectors of 64 components, as 0.55 at 10 blocks, 0.4 at 50 and
    0.28 at 400, so it falls with the power 0.2 of the number of blocks (7 orders at 10,000 vectors, 11 at 50,000, 92 at 10**9). Closer pairs meet more often.
    """
    met = min(0.55, 0.4 * (max(1, n) / (50 * FIRST_BLOCK)) ** -0.2)
    return max(2, math.ceil(math.log(missed) / math.log1p(-met)))


def first_lists(nodes: DataFrame, k: int, n: int, seed: int = 0, orders: int | None = None) -> DataFrame:
    """``a``, ``b``, ``sim``: neighbours within blocks of several orders of ``nodes`` (``n`` rows), in single precision.

    An order goes by cross-polytope hashes, as many as part ``n`` rows into blocks, and within equal ones by a projection. Only ids and codes are
    sorted, all orders in one job; a row's place in its order tells its block, so blocks hang on the vectors alone. Orders of another ``seed`` are others.
    """
    orders = orders or orders_for(n)
    depth = max(1, math.ceil(math.log2(max(2, n / FIRST_BLOCK)) / math.log2(2 * DIRECTIONS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), np.float32) if len(batch) else np.zeros((0, 1), np.float32)
            rng = np.random.default_rng(1000 + seed)
            codes, lines = np.zeros((orders, len(x)), np.int64), np.zeros((orders, len(x)), np.float32)
            for r in range(orders):
                for _ in range(depth):
                    along = x @ rng.normal(size=(x.shape[1], DIRECTIONS)).astype(np.float32)
                    most = np.abs(along).argmax(axis=1)
                    codes[r] = codes[r] * 2 * DIRECTIONS + 2 * most + (along[np.arange(len(x)), most] > 0)
                lines[r] = x @ rng.normal(size=x.shape[1]).astype(np.float32)
            number = np.repeat(np.arange(orders, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.asarray(batch.column("id")), orders)), pa.array(number), pa.array(codes.ravel()), pa.array(lines.ravel())], names=["id", "number", "code", "line"])

    sorted_ = nodes.mapInArrow(place, "id long, number int, code long, line float").orderBy("number", "code", "line", "id")
    row = F.monotonically_increasing_id()
    placed = stored(sorted_.select("id", "number", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "places")
    held = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number a task
    ahead = dict(zip(sorted(held), np.r_[0, np.cumsum([held[p] for p in sorted(held)])].tolist(), strict=False))
    known = nodes.sparkSession.createDataFrame(list(ahead.items()), "part long, ahead long")
    place_in = F.col("ahead") + F.col("nth") - F.col("number") * F.lit(n)
    keyed = placed.join(known, "part").select("id", (F.col("number").cast("long") * (n // FIRST_BLOCK + 1) + F.floor(place_in / FIRST_BLOCK)).alias("key"))
    vectors = nodes.select("id", F.col("v").cast("array<float>").alias("v"))

    def compare(part: pa.Table):
        return _edges(*_best_of_block(np.asarray(part["id"]), _matrix(part["v"].combine_chunks(), np.float32), k))

    dealt = keyed.join(vectors, "id").repartition("key").sortWithinPartitions("key", "id").select("key", "id", "v")
    return dealt.mapInArrow(_by_key(compare), "a long, b long, sim double")


def _top(edges: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return edges.where("a != b").dropDuplicates(["a", "b"]).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _local_joins(k: int):
    """Rows (``u``, ``id``, ``v``) in order of ``u``: members of one neighbourhood are compared with each other."""

    def solve(ids, vs):
        x = _matrix(pa.concat_arrays(vs))
        return _edges(*_best_of_block(np.concatenate(ids), x, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, ids, vs = None, [], []
        for batch in batches:
            keys = np.asarray(batch.column("u"))
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if keys[a] != u:
                    if sum(map(len, ids)) > 1:
                        yield solve(ids, vs)
                    u, ids, vs = keys[a], [], []
                ids.append(np.asarray(batch.column("id").slice(a, b - a)))
                vs.append(batch.column("v").slice(a, b - a))
        if sum(map(len, ids)) > 1:
            yield solve(ids, vs)

    return run


def refine(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: every vector's neighbours and those it is neighbour of meet, and each keeps the best it met.

    A vector meets its own neighbours again, so all that stays is compared in double precision here.
    """
    back = graph.select(F.col("b").alias("u"), F.col("a").alias("id"), "sim")
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "id"))
    back = back.withColumn("nth", nth).where(F.col("nth") <= k).select("u", "id")
    near = graph.select(F.col("a").alias("u"), F.col("b").alias("id")).unionByName(back).distinct()
    near = near.unionByName(nodes.select(F.col("id").alias("u"), "id"))
    met = near.join(nodes, "id").repartition("u").sortWithinPartitions("u", "id").select("u", "id", "v")
    found = met.mapInArrow(_local_joins(k), "a long, b long, sim double")
    return _top(found, k)


class Audit(NamedTuple):
    """Recall of links by vector: an estimate, a lower bound that chance leaves it above nineteen times in twenty, and whether a link was seen at all."""

    recall: float
    at_least: float
    seen: bool


def audited(nodes: DataFrame, parts: DataFrame, threshold: float, k: int = NEIGHBOURS, queries: int = AUDITED, loose: int = AUDITED_LOOSE) -> Audit:
    """How much of a vector's links, by brute force, the components (``parts``) join.

    The mean over all vectors that have links, and the mean over those in components of more than ``k`` by themselves and over the others, whichever
    is worst. ``queries`` vectors are asked of large components and as many of small ones. Of those in none, who could all have lost their links, as many are
    asked as show whether one in a hundred of the linked vectors is missing, ``loose`` at most; with no more than that all are asked, and nothing is estimated.
    Each stratum counts by its size. Where no link is seen, ``seen`` is false and the recall of those asked is 1.
    """
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    of = nodes.join(parts.withColumnRenamed("node", "id"), "id", "left").join(sizes, "component", "left")
    kind = F.when(F.col("size") > k, 2).when(F.col("size") > 1, 1).otherwise(0)
    of = of.select("id", "v", F.coalesce("component", "id").alias("component"), kind.alias("kind"))
    strata = {r["kind"]: r["count"] for r in of.groupBy("kind").count().collect()}
    linked = strata.get(1, 0) + strata.get(2, 0)
    wanted = {0: min(loose, max(queries, 300 * strata.get(0, 0) // max(1, linked))), 1: queries, 2: queries}
    asked = [r for x, n in strata.items() for r in of.where(F.col("kind") == x).orderBy(F.xxhash64("id"), "id").limit(min(n, wanted[x])).collect()]
    if not asked:
        return Audit(1.0, 1.0, False)
    ids, own_part = (np.array([r[c] for r in asked], np.int64) for c in ("id", "component"))
    x = np.array([r["v"] for r in asked]).reshape(len(ids), -1)
    shared = nodes.sparkSession.sparkContext.broadcast((ids, own_part, x))  # `loose` and twice `queries` vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own_part, x = shared.value
        links, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                y, other, component = _matrix(part.column("v")).T, np.asarray(part.column("id")), np.asarray(part.column("component"))
                for q in range(0, len(ids), 1024):
                    own = slice(q, q + 1024)
                    linked = (x[own] @ y >= threshold) & (ids[own, None] != other)
                    links[own] += linked.sum(axis=1)
                    found[own] += (linked & (own_part[own, None] == component)).sum(axis=1)
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(found[some])], names=["id", "links", "found"])

    truth = of.select("id", "component", "v").mapInArrow(run, "id long, links long, found long").groupBy("id").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
    kinds = {r["id"]: r["kind"] for r in asked}
    missed: dict[int, list[float]] = {x: [] for x in strata}
    for r in truth.collect():
        missed[kinds[r["id"]]].append(1 - r["found"] / r["links"])
    weight = {x: n / min(n, wanted[x]) for x, n in strata.items()}
    held = sum(weight[x] * len(m) for x, m in missed.items())
    if not held:
        return Audit(1.0, 1.0 if all(w == 1 for w in weight.values()) else 0.0, False)
    # what chance may have kept from a stratum that was not asked whole: a count of x stands for up to x + 1 + 2 * sqrt(x + 1)
    more = {x: 0.0 if weight[x] == 1 else 1 + 2 * math.sqrt(1 + sum(m)) for x, m in missed.items()}

    def recall(among: tuple[int, ...], chance: float) -> float:
        lost = sum(weight[x] * (sum(missed[x]) + chance * more[x]) for x in among if x in missed)
        of_all = sum(weight[x] * (len(missed[x]) + chance * more[x]) for x in among if x in missed)
        return 1 - lost / of_all if of_all else 1.0

    groups = (0, 1, 2), (2,), (0, 1)
    return Audit(min(recall(g, 0) for g in groups), recall((0, 1, 2), 1), True)


def audit(nodes: DataFrame, parts: DataFrame, threshold: float, k: int = NEIGHBOURS, queries: int = AUDITED, loose: int = AUDITED_LOOSE) -> float:
    """The estimate of ``audited``."""
    return audited(nodes, parts, threshold, k, queries, loose).recall


def neighbour_graph(nodes: DataFrame, threshold: float, k: int = NEIGHBOURS, rounds: int = ROUNDS, recall: float = RECALL, queries: int = AUDITED, loose: int = AUDITED_LOOSE) -> tuple[DataFrame, DataFrame, Audit]:
    """The refined lists (``a``, ``b``, ``sim``), the components of their links and of those they hide, and the audit.

    Every round adds orders of its own and refines the lists. Rounds end when the audit's lower bound is ``recall``, or its estimate is and the
    last round found no new linked vector; a round that gains nothing also doubles the lists. Raises RuntimeError when ``rounds`` leave the
    estimate below ``recall``, rather than return links that the audit knows to be incomplete.
    """
    n = nodes.count()
    graph, got, linked = None, Audit(0.0, 0.0, False), -1
    for done in range(rounds):
        fresh = first_lists(nodes, max(2, k // 2), n, seed=done)
        graph = stored(_top(fresh if graph is None else graph.unionByName(fresh), k), "graph")
        for _ in range(2):
            graph = stored(refine(graph, nodes, k), "graph")
        parts = linked_parts(graph, nodes, threshold, k)
        before, got = got, audited(nodes, parts, threshold, k, queries, loose)
        known, linked = linked, parts.count()
        if got.at_least >= recall or (got.recall >= recall and linked == known):
            return graph, parts, got
        if got.recall <= before.recall:
            k *= 2
    if got.recall >= recall:
        return graph, parts, got
    raise RuntimeError(f"recall {got.recall:.4f} of links after {rounds} rounds, {recall} wanted")


def linked_parts(graph: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """``node``, ``component`` over the lists' links and over those between vectors whose ``k`` entries all are links."""
    links = graph.where(F.col("sim") >= threshold).select("a", "b")
    parts = stored(connected_components(links), "parts")
    full = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id")
    members = stored(nodes.join(parts.withColumnRenamed("node", "id"), "id").join(full, "id").select("component", "id", "v"), "full")
    hidden = stored(hidden_links(members, threshold), "hidden")
    return stored(connected_components(links.unionByName(hidden)), "parts") if hidden.count() else parts


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """``members`` (of ``component``) once for each pair of blocks of their component that they are in: ``key``, ``side`` (2: a block with itself)."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return _in_pairs(members.join(sizes, "component"))


def _in_pairs(members: DataFrame) -> DataFrame:
    """``members`` of components in so many ``blocks``, as ``_dealt`` gives them."""
    placed = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("key", F.concat_ws(":", "component", low, high)).withColumn("side", side.cast("int")).drop("blocks", "own", "other")


def hidden_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: for every two components with links between their ``members`` (``component``, ``id``, ``v``), some of these links.

    A list full of links may end before it leaves its component, so these components are searched whole. Each is a ball around one of its
    members; a link needs balls no further apart than the threshold's angle, and its vectors no further than that from the other ball.
    All balls are compared, block by block, and then what is left of each two components, again by blocks, each giving a link at most.
    """
    reach = float(np.arccos(min(max(threshold, -1.0), 1.0))) + 1e-6
    centres = members.groupBy("component").agg(F.min_by("v", "id").alias("centre"))
    wide = members.join(centres, "component").groupBy("component").agg(F.max(_angle(_dot(F.col("v"), F.col("centre")))).alias("radius"))
    balls = stored(centres.join(wide, "component").select(F.col("component").alias("id"), F.col("centre").alias("v"), "radius"), "balls")

    def near(part: pa.Table):
        ids, side, radius = (np.asarray(part[c]) for c in ("id", "side", "radius"))
        x = _matrix(part["v"].combine_chunks())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        angle = np.arccos(np.clip(x[left] @ x[right].T, -1, 1))
        p, q = np.nonzero((angle <= radius[left][:, None] + radius[right][None, :] + reach) & (ids[left][:, None] != ids[right][None, :]))
        p, q = ids[left[p]], ids[right[q]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["p", "q"])

    blocks = max(1, -(-balls.count() // (4 * block)))
    keyed = _in_pairs(balls.select("*", F.lit(0).alias("component"), F.lit(blocks).alias("blocks"))).select("key", "side", "id", "radius", "v")
    pairs = stored(keyed.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_by_key(near), "p long, q long").distinct(), "near")

    def towards(own: str, other: str, side: int) -> DataFrame:
        ball = balls.select(F.col("id").alias(other), F.col("v").alias("centre"), "radius")
        met = members.join(pairs.join(ball, other), F.col("component") == F.col(own))
        met = met.where(_angle(_dot(F.col("v"), F.col("centre"))) <= F.col("radius") + reach)
        return met.select("p", "q", F.lit(side).alias("side"), "id", "v")

    met = stored(towards("p", "q", 0).unionByName(towards("q", "p", 1)), "met")
    blocks = lambda side: F.ceil(F.count(F.when(F.col("side") == side, 1)) / block).cast("int")
    sizes = met.groupBy("p", "q").agg(blocks(0).alias("n0"), blocks(1).alias("n1")).where("n0 > 0 and n1 > 0")
    placed = met.join(sizes, ["p", "q"])
    mine, theirs = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), theirs - 1)))
    low, high = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    keyed = placed.select(F.concat_ws(":", "p", "q", low, high).alias("key"), "side", "id", "v")

    def best(part: pa.Table):
        ids, side = np.asarray(part["id"]), np.asarray(part["side"])
        x = _matrix(part["v"].combine_chunks())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sim = x[left] @ x[right].T
        p, q = np.unravel_index(sim.argmax(), sim.shape) if sim.size else (0, 0)
        kept = slice(0, int(sim.size > 0 and sim[p, q] >= threshold))
        return pa.RecordBatch.from_arrays([pa.array(ids[left[[p]] if sim.size else []][kept], pa.int64()), pa.array(ids[right[[q]] if sim.size else []][kept], pa.int64())], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_by_key(best), "a long, b long")


def _counts(threshold: float):
    """Rows (``side``, ``id``, ``mult``, ``v``) of a pair of blocks: links of each row to the other side's, by multiplicity."""

    def solve(part: pa.Table):
        ids, mult = np.asarray(part["id"]), np.asarray(part["mult"])
        side = np.asarray(part["side"])
        x = _matrix(part["v"].combine_chunks())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block with itself
        linked = x[left] @ x[right].T >= threshold
        linked &= ids[left][:, None] != ids[right][None, :]
        n = np.zeros(len(ids), np.int64)
        n[left] += linked @ mult[right]
        if side[0] != 2:
            n[right] += linked.T @ mult[left]
        return pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(n)], names=["id", "n"])

    return solve


def _by_key(solve):
    """Rows in order of ``key``: ``solve`` of each key's, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = batch.column("key").to_pylist()
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or (i > start and keys[i] != keys[start]):
                    if i > start:
                        if keys[start] != key and held:
                            yield solve(pa.Table.from_batches(held))
                            held = []
                        key = keys[start]
                        held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def link_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``id``, ``n``: how many others of its component each vector links to, copies counted.

    ``members`` has ``component``, ``id``, ``mult``, ``v``. Where all vectors of a component are within half the threshold's angle of
    one of them, all link to all, and nothing is compared; so most groups of near copies, however large, cost a sum. Another
    component is parted into blocks of about ``block`` vectors, and each pair of blocks is one small product; a row goes to as many
    products as its component has blocks.
    """
    reach = float(np.arccos(min(max(threshold, -1.0), 1.0))) - 1e-6
    centres = members.groupBy("component").agg(F.min_by("v", "id").alias("centre"))
    far = F.max(_angle(_dot(F.col("v"), F.col("centre")))).alias("far")
    sizes = members.join(centres, "component").groupBy("component").agg(far, F.sum("mult").alias("all"))
    sizes = stored(sizes.select("component", "all", (F.col("far") * 2 <= reach).alias("tight")), "sizes")
    placed = members.join(sizes, "component")
    tight = placed.where("tight").select("id", (F.col("all") - F.col("mult")).alias("n"))
    keyed = _dealt(placed.where("not tight").drop("all", "tight"), block).select("key", "side", "id", "mult", "v")
    sums = keyed.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_by_key(_counts(threshold)), "id long, n long")
    return tight.unionByName(sums.groupBy("id").agg(F.sum("n").alias("n")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = NEIGHBOURS, rounds: int = ROUNDS, recall: float = RECALL, queries: int = AUDITED) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    Cosine in double precision; a vector that is null or zero, or holds a null or non-finite component, links with nothing.
    Vectors of each length are a graph of their own. Equal vectors are one node with a multiplicity. Further columns are not
    read; an empty table gives an empty one.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = stored(rows.select("vec_id", F.when(usable(F.col("v")), F.col("v")).alias("v")), "vectors")
    classes = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")), "classes")
    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("v").alias("d")).count().collect()}
    shared = sorted(d for d, n in sizes.items() if n > 1)
    lone = classes.where(~F.size("v").isin(shared)) if shared else classes
    of = lone.select("v", F.col("id").alias("component_id"), (F.col("mult") - 1).alias("n_links"))
    for d in shared:
        of = of.unionByName(_linked(classes.where(F.size("v") == d), threshold, k, rounds, recall, queries))
    out = rows.join(of, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _linked(classes: DataFrame, threshold: float, k: int, rounds: int, recall: float, queries: int) -> DataFrame:
    """``v``, ``component_id``, ``n_links`` of distinct vectors (``v``, ``id``, ``mult``) of one length."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _unit(_matrix(batch.column("v")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mult"), flat, batch.column("v")], names=["id", "mult", "v", "raw"])

    nodes = stored(classes.select("id", "mult", "v").mapInArrow(unit, "id long, mult long, v array<double>, raw array<double>"), "nodes")
    _, parts, _ = neighbour_graph(nodes.select("id", "v"), threshold, k, rounds, recall, queries)
    members = nodes.join(parts, nodes["id"] == parts["node"]).select("component", "id", "mult", "v")
    counts = link_counts(members, threshold)
    of = nodes.join(parts.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    return of.select(F.col("raw").alias("v"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
