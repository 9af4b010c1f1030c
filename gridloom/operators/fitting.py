"""Models fitted to matched points, and tiles placed by them.

Spark sums moments of the matches, a fixed number of them however many matches there are; the small systems that remain are
solved with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.components import connected_components
from ..geometry.transforms import Affine
from ..grid import Grid
from ..storage import stored
from .aggregate import intensity_moments, ncc

MODELS = ("translation", "rigid", "affine")


def moments(matches: DataFrame, axes: tuple[str, ...]) -> tuple[float, np.ndarray]:
    """Number of matches, and sums of products of (1, p, q)."""
    cols = [F.lit(1.0), *[F.col(f"p_{a}") for a in axes], *[F.col(f"q_{a}") for a in axes]]
    n = len(cols)
    row = matches.agg(*[F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"m{i}_{j}"] or 0.0
    return out[0, 0], out


def _needed(model: str, d: int) -> int:
    """Matches that a model needs at least."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    return {"translation": 1, "rigid": d, "affine": d + 1}[model]


def _of_moments(m: np.ndarray, d: int, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and offset of the model that takes ``p`` nearest ``q``, from sums of products of (1, p, q)."""
    n = m[0, 0]
    p, q = m[0, 1 : d + 1] / n, m[0, d + 1 :] / n
    if model == "translation":
        return np.eye(d), q - p
    cross = m[1 : d + 1, d + 1 :] - n * np.outer(p, q)
    if model == "rigid":
        u, _, vt = np.linalg.svd(cross)
        keep = np.eye(d)
        keep[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T))
        a = vt.T @ keep @ u.T
    else:
        a = np.linalg.lstsq(m[1 : d + 1, 1 : d + 1] - n * np.outer(p, p), cross, rcond=None)[0].T
    return a, q - a @ p


def fit(matches: DataFrame, axes: tuple[str, ...], model: str = "affine") -> Affine:
    """The translation, rigid motion (without mirroring) or affine that takes ``p`` nearest ``q``."""
    least = _needed(model, len(axes))
    n, m = moments(matches, axes)
    if n < least:
        raise ValueError(f"{int(n)} matches are too few for a {model} model")
    return Affine.of(*_of_moments(m, len(axes), model))


def inliers(matches: DataFrame, axes: tuple[str, ...], model: Affine, epsilon: float) -> DataFrame:
    """The matches that a model brings within ``epsilon``."""
    d2 = F.lit(0.0)
    for a, row, o in zip(axes, model.matrix, model.offset, strict=True):
        at = sum((F.col(f"p_{b}") * float(m) for b, m in zip(axes, row, strict=True)), F.lit(float(o)))
        d2 = d2 + (at - F.col(f"q_{a}")) ** 2
    return matches.where(d2 <= epsilon * epsilon)


def robust_fit(matches: DataFrame, axes: tuple[str, ...], start: Affine, model: str = "affine", epsilon: float = 5.0, least: int = 6, rounds: int = 20) -> tuple[Affine, int]:
    """``start`` refitted to its inliers until they stay the same; ValueError if fewer than ``least`` are left."""
    count = -1
    for _ in range(rounds):
        near = inliers(matches, axes, start, epsilon)
        now = near.count()
        if now < least:
            raise ValueError(f"{now} matches agree, fewer than {least}")
        if now == count:
            break
        start, count = fit(near, axes, model), now
    return start, count


#: Matches of a group that random samples are drawn from, at most, and rows of a group that are counted together.
POOL = 4000
COUNTED = 50_000


def ransac(matches: DataFrame, axes: tuple[str, ...], model: str = "rigid", epsilon: float = 5.0, trials: int = 1000, least: int = 6, ratio: float = 0.1, seed: int = 0, group: str | None = None, rounds: int = 20) -> DataFrame:
    """The model that most matches agree with, of each ``group`` or of all: the group, ``model`` (rows of matrix and offset), ``inliers``, ``n``, ``kept``.

    ``trials`` models are fitted to random smallest samples (of at most ``POOL`` matches of a group, the first by a hash, so that reruns agree); all matches of the group count
    for each of them, in one aggregation over shares of the group, and the one with most matches within ``epsilon``, the first of equals, is refitted to these until they stay.
    Groups without enough matches, or where fewer than ``least`` or than ``ratio`` of them agree, are not kept; their model is null if there never was one.
    """
    d, k = len(axes), _needed(model, len(axes))
    cols = [f"{n}_{a}" for n in "pq" for a in axes]
    key = F.col(group) if group else F.lit(0).cast("long")
    rows = stored(matches.select(key.cast("long").alias("grp"), *[F.col(c).cast("double").alias(c) for c in cols]), "matches")
    counts = stored(rows.groupBy("grp").agg(F.count("*").alias("n")), "counts")
    by = Window.partitionBy("grp").orderBy(F.xxhash64(*cols), *cols)
    pool = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= POOL)

    def propose(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < k:
            return pd.DataFrame({"grp": [], "models": []}).astype({"grp": "int64", "models": "object"})
        rng, at = np.random.default_rng([seed, abs(int(part["grp"].iloc[0]))]), part.sort_values("nth")[cols].to_numpy()
        made = np.zeros((trials, d, d + 1))
        for t in range(trials):
            pick = at[rng.choice(len(at), k, replace=False)]
            full = np.c_[np.ones(k), pick]
            a, o = _of_moments(full.T @ full, d, model)
            made[t] = np.c_[a, o]
        return pd.DataFrame({"grp": [part["grp"].iloc[0]], "models": [made.tobytes()]})

    models = stored(pool.groupBy("grp").applyInPandas(propose, "grp long, models binary"), "models")
    shares = counts.select("grp", F.ceil(F.col("n") / COUNTED).cast("int").alias("shares"))
    left = rows.join(shares, "grp").withColumn("share", F.pmod(F.xxhash64(*cols), F.col("shares")).cast("int")).select("grp", "share", *cols)
    right = models.join(shares, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "models")

    def count(own: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(tried):
            return pd.DataFrame({"grp": [], "trial": [], "agree": []}).astype("int64")
        m = np.frombuffer(tried["models"].iloc[0]).reshape(-1, d, d + 1)
        x, agree = own[cols].to_numpy(), np.zeros(len(m), np.int64)
        for at in range(0, len(x), 2048):
            p, q = x[at : at + 2048, :d], x[at : at + 2048, d:]
            gap = np.einsum("tij,nj->tni", m[:, :, :d], p) + m[:, None, :, d] - q
            agree += ((gap * gap).sum(axis=2) <= epsilon * epsilon).sum(axis=1)
        return pd.DataFrame({"grp": own["grp"].iloc[0], "trial": np.arange(len(m)), "agree": agree})

    agreed = left.groupBy("grp", "share").cogroup(right.groupBy("grp", "share")).applyInPandas(count, "grp long, trial long, agree long")
    best = agreed.groupBy("grp", "trial").agg(F.sum("agree").alias("agree")).groupBy("grp").agg(F.max(F.struct("agree", (-F.col("trial")).alias("trial"))).alias("b"))

    def pick(batches):
        for part in batches:
            chosen = [np.frombuffer(b).reshape(-1, d * (d + 1))[-t].tolist() for b, t in zip(part["models"], part["trial"], strict=True)]
            yield pd.DataFrame({"grp": part["grp"], "model": chosen, "inliers": part["agree"]})

    now = best.select("grp", "b.*").join(models, "grp").select("grp", "models", "trial", "agree").mapInPandas(pick, "grp long, model array<double>, inliers long")
    now = stored(now, "fits")
    full = [F.lit(1.0), *map(F.col, cols)]
    width = len(full)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    for _ in range(rounds):
        off = [sum((F.col(f"p_{b}") * F.col("model")[i * (d + 1) + j] for j, b in enumerate(axes)), F.col("model")[i * (d + 1) + d]) - F.col(f"q_{a}") for i, a in enumerate(axes)]
        near = rows.join(now.select("grp", "model"), "grp").where(sum((o * o for o in off), F.lit(0.0)) <= epsilon * epsilon)
        sums = near.groupBy("grp").agg(F.count("*").alias("agree"), F.array(*[F.sum(full[i] * full[j]) for i, j in pairs]).alias("m"))

        def refit(batches):
            for part in batches:
                out = []
                for n, m, before in zip(part["agree"], part["m"], part["model"], strict=True):
                    if not n >= k:  # none left, or too few
                        out.append(list(before))
                        continue
                    whole = np.zeros((width, width))
                    for (i, j), v in zip(pairs, m, strict=True):
                        whole[i, j] = whole[j, i] = v
                    a, o = _of_moments(whole, d, model)
                    out.append(np.c_[a, o].ravel().tolist())
                yield pd.DataFrame({"grp": part["grp"], "model": out, "inliers": part["agree"].fillna(0).astype("int64"), "moved": part["agree"].fillna(0) != part["inliers"]})

        step = now.join(sums, "grp", "left").select("grp", "model", "inliers", "agree", "m").mapInPandas(refit, "grp long, model array<double>, inliers long, moved boolean")
        now = stored(step, "fits")
        if now.where("moved").isEmpty():
            break
    out = counts.join(now.drop("moved"), "grp", "left")
    inliers = F.coalesce("inliers", F.lit(0)).cast("long")
    kept = F.col("model").isNotNull() & (inliers >= max(k, least)) & (inliers >= ratio * F.col("n"))
    return out.select(*([F.col("grp").alias(group)] if group else []), "model", inliers.alias("inliers"), "n", kept.alias("kept"))


def placed_tiles(tiles: DataFrame, links: DataFrame, axes: tuple[str, ...], epsilon: float = 5.0, near: float = 1e-9, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Corrections ``tile``, ``t_<axis>``, ``joined`` that make all links agree best, and ``links`` with ``residual`` and ``dropped``.

    ``links`` (``a``, ``b``, ``weight``, ``o_<axis>``): how far ``b`` must move beyond ``a``. Weighted least squares by conjugate gradients: each step is a join of the tiles with their links and
    a sum by tile, so neither tiles nor links come to the driver. Of each group of linked tiles the one with the smallest number stays. While links of a group miss by more
    than ``epsilon``, the one that misses most (the first of equals) is dropped and the group is solved again. Tiles without links stay.
    """
    t = [f"t_{a}" for a in axes]
    links = stored(links.withColumn("link", F.monotonically_increasing_id()).withColumn("dropped", F.lit(False)), "links")
    names = tiles.select("tile").distinct()
    while True:
        live = links.where("not dropped")
        solved = _conjugate(names, live, axes, near, rounds)
        groups = connected_components(live.select("a", "b")).withColumnRenamed("node", "tile")
        of = solved.join(groups, "tile", "left")
        anchors = of.where(F.col("tile") == F.col("component")).select("component", *[F.col(c).alias(f"at_{c}") for c in t])
        placed = of.join(anchors, "component", "left")
        placed = stored(placed.select("tile", *[F.coalesce(F.col(c) - F.col(f"at_{c}"), F.lit(0.0)).alias(c) for c in t], F.col("component").isNotNull().alias("joined"), "component"), "placed")
        ends = links
        for side in ("a", "b"):
            ends = ends.join(placed.select(F.col("tile").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in t], F.col("component").alias(f"{side}_group")), side)
        gap = F.sqrt(sum(((F.col(f"b_{c}") - F.col(f"a_{c}") - F.col(f"o_{a}")) ** 2 for c, a in zip(t, axes, strict=True)), F.lit(0.0)))
        missed = ends.withColumn("residual", gap)
        worst = missed.where((F.col("residual") > epsilon) & ~F.col("dropped")).groupBy("a_group").agg(F.max(F.struct("residual", (-F.col("link")).alias("link"))).alias("w"))
        worst = stored(worst.select((-F.col("w.link")).alias("link"), F.lit(True).alias("out")), "worst")
        if worst.isEmpty():
            kept = missed.select(*links.columns, "residual").drop("link")
            return placed.drop("component"), kept
        links = stored(links.join(worst, "link", "left").withColumn("dropped", F.col("dropped") | F.coalesce("out", F.lit(False))).drop("out"), "links")


def _conjugate(names: DataFrame, links: DataFrame, axes: tuple[str, ...], near: float, rounds: int) -> DataFrame:
    """``tile``, ``t_<axis>``: a least-squares solution of the links, all axes side by side."""
    t, r, p = ([f"{n}_{a}" for a in axes] for n in ("t", "r", "p"))
    both = links.select(F.col("a").alias("tile"), "weight", *[(-F.col(f"o_{a}")).alias(f"o_{a}") for a in axes]).unionByName(links.select(F.col("b").alias("tile"), "weight", *[f"o_{a}" for a in axes]))
    start = both.groupBy("tile").agg(*[F.sum(F.col("weight") * F.col(f"o_{a}")).alias(f"r_{a}") for a in axes])
    state = names.join(start, "tile", "left").select("tile", *[F.lit(0.0).alias(c) for c in t], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in r], *[F.coalesce(c, F.lit(0.0)).alias(q) for c, q in zip(r, p, strict=True)])
    state = stored(state, "state")
    rr = first = np.array(state.agg(*[F.sum(F.col(c) ** 2) for c in r]).first(), float) if not state.isEmpty() else np.zeros(len(axes))
    for _ in range(rounds):
        if not (rr > near * near * np.maximum(first, 1e-300)).any():
            break
        at = lambda side: state.select(F.col("tile").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in p])
        met = links.select("a", "b", "weight").join(at("a"), "a").join(at("b"), "b")
        flow = [(F.col("weight") * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(f"f_{c}") for c in p]
        flows = met.select("a", "b", *flow)
        out = flows.select(F.col("b").alias("tile"), *[f"f_{c}" for c in p]).unionByName(flows.select(F.col("a").alias("tile"), *[(-F.col(f"f_{c}")).alias(f"f_{c}") for c in p]))
        image = out.groupBy("tile").agg(*[F.sum(f"f_{c}").alias(f"f_{c}") for c in p])
        full = stored(state.join(image, "tile", "left").na.fill(0.0), "image")
        curve = np.array(full.agg(*[F.sum(F.col(c) * F.col(f"f_{c}")) for c in p]).first(), float)
        step = np.where(curve > 0, rr / np.where(curve > 0, curve, 1), 0.0).tolist()
        moved = [(F.col(c) + F.col(q) * s).alias(c) for c, q, s in zip(t, p, step, strict=True)]
        left = [(F.col(c) - F.col(f"f_{q}") * s).alias(c) for c, q, s in zip(r, p, step, strict=True)]
        half = stored(full.select("tile", *moved, *left, *p), "state")
        new = np.array(half.agg(*[F.sum(F.col(c) ** 2) for c in r]).first(), float)
        ratio = np.where(rr > 0, new / np.where(rr > 0, rr, 1), 0.0).tolist()
        state = half.select("tile", *t, *r, *[(F.col(c) + F.col(q) * b).alias(q) for c, q, b in zip(r, p, ratio, strict=True)])
        rr = new
    return state.select("tile", *t)


def place_tiles(links: list[tuple[int, int, np.ndarray, float]], tiles: list[int]) -> dict[int, np.ndarray]:
    """A translation for every tile from measured ones between pairs: weighted least squares, the first tile of each group held.

    ``links``: tile a, tile b, the offset that b needs against a, weight. Tiles are few (a plate, not its voxels).
    """
    d = len(links[0][2]) if links else 3
    group = {t: t for t in tiles}
    for _ in tiles:
        for a, b, *_rest in links:
            group[a] = group[b] = min(group[a], group[b])
    index = {t: i for i, t in enumerate(tiles)}
    lhs, rhs = np.zeros((len(tiles), len(tiles))), np.zeros((len(tiles), d))
    for a, b, off, w in links:
        i, j = index[a], index[b]
        lhs[i, i] += w
        lhs[j, j] += w
        lhs[i, j] -= w
        lhs[j, i] -= w
        rhs[i] -= w * np.asarray(off)
        rhs[j] += w * np.asarray(off)
    for t in tiles:
        if group[t] == t:  # the anchor
            lhs[index[t], :], lhs[index[t], index[t]], rhs[index[t]] = 0, 1, 0
    solved = np.linalg.solve(lhs, rhs)
    return {t: solved[index[t]] for t in tiles}


def affine_by_moments(fixed: Grid, moving: Grid, order: int = 1) -> tuple[Affine, float]:
    """The affine from fixed to moving voxels that matches centroids and covariances: of the turns by half that keep
    handedness, the one with the best correlation. Returns it with its correlation."""
    from dataclasses import replace

    from ..geometry.resample import resample, voxel_to_world

    def shape(g: Grid) -> tuple[np.ndarray, np.ndarray]:
        r = intensity_moments(g).first()
        mean = np.array([r[f"mean_{a}"] for a in g.axes])
        cov = np.array([[r[f"cov_{a}{b}"] if f"cov_{a}{b}" in r.asDict() else r[f"cov_{b}{a}"] for b in g.axes] for a in g.axes])
        return mean, cov

    (mf, cf), (mm, cm) = shape(fixed), shape(moving)
    (wf, vf), (wm, vm) = np.linalg.eigh(cf), np.linalg.eigh(cm)
    d, best = len(mf), None
    for k in range(1 << d):
        signs = np.array([-1.0 if k >> i & 1 else 1.0 for i in range(d)])
        a = vm @ np.diag(signs * np.sqrt(np.maximum(wm, 1e-9) / np.maximum(wf, 1e-9))) @ vf.T
        if np.linalg.det(a) <= 0:
            continue
        t = Affine.of(a, mm - a @ mf)
        world = voxel_to_world(fixed.meta).inverse().then(t).then(voxel_to_world(moving.meta))
        seen = resample(Grid(moving.df, replace(moving.meta, kind=None)), fixed.meta, world, order)
        score = ncc(fixed, seen).first()[0] or -1.0
        if best is None or score > best[1]:
            best = (t, float(score))
    return best
