"""Exact nearest neighbours, matches, robust fits, placement, and the whole stitching run, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import neighbours
from gridloom.functions.neighbours import KdTree, nearest_join
from gridloom.operators import fitting, stitching


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, x array<double>")


def by_hand(q, p, k, others):
    d2 = sum((q[:, a, None] - p[None, :, a]) ** 2 for a in range(q.shape[1]))
    out = {}
    for i in range(len(q)):
        order = [j for j in np.lexsort((np.arange(len(p)), d2[i])).tolist() if not (others and i == j)][:k]
        out[i] = [(j, d2[i, j]) for j in order]
    return out


def clumps(rng, n, d):
    """Some points crowded, some spread, some on one spot."""
    x = np.concatenate([rng.normal(size=(n // 2, d)) * 0.01, rng.uniform(-50, 50, (n - n // 2 - 40, d)), np.zeros((40, d)) + 3.0])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize(("d", "others"), [(2, True), (3, False), (6, True)])
def test_nearest_are_those_of_brute_force(spark, monkeypatch, d, others):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    rng = np.random.default_rng(d)
    x = clumps(rng, 700, d)
    q = x if others else np.concatenate([x[:80] + 0.1, rng.uniform(-400, 400, (40, d))])
    want = by_hand(q, x, 5, others)
    got = {}
    for r in nearest_join(table(spark, q), table(spark, x), 5, others).orderBy("query", "nth").collect():
        got.setdefault(r["query"], []).append((r["point"], r["d2"]))
    assert got.keys() == want.keys()
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] and np.allclose([v for _, v in got[i]], [v for _, v in want[i]]) for i in want)


def test_fewer_points_than_asked_for(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 2)
    x = np.arange(18.0).reshape(9, 2)
    got = nearest_join(table(spark, x), table(spark, x), 20, others=True)
    assert got.count() == 9 * 8 and got.agg(F.max("nth")).first()[0] == 8
    assert nearest_join(table(spark, x), table(spark, x[:0]), 3).count() == 0 and nearest_join(table(spark, x[:0]), table(spark, x), 3).count() == 0


def test_one_spot_is_dealt_out(spark, monkeypatch):
    """All points in one place: blocks of a leaf, not one task, and ties by id."""
    monkeypatch.setattr(neighbours, "LEAF", 50)
    x = np.ones((400, 2))
    got = nearest_join(table(spark, x), table(spark, x), 3, others=True).collect()
    want = {i: [j for j in range(5) if j != i][:3] for i in range(400)}
    assert all(want[r["query"]][r["nth"] - 1] == r["point"] for r in got) and len(got) == 1200


def test_cells_within_a_radius():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    tree = KdTree.of(x, 5)
    leaf = tree.leaf(x)
    q, r2 = rng.normal(size=(40, 3)), rng.uniform(0, 1, 40)
    row, cell = tree.within(q, r2)
    found = set(zip(row.tolist(), cell.tolist(), strict=True))
    assert len(found) == len(row)
    d2 = ((q[:, None] - x[None]) ** 2).sum(-1)
    assert all((i, leaf[j]) in found for i, j in zip(*np.nonzero(d2 <= r2[:, None]), strict=True))
    assert len(found) < 40 * tree.leaves


def points_of(spark, tiles):
    rows = [(t, i, *map(float, p)) for t, pts in tiles.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "tile long, id long, y double, x double")


def test_nearest_within_tiles(spark):
    rng = np.random.default_rng(4)
    tiles = {3: rng.uniform(0, 100, (60, 2)), 8: rng.uniform(0, 100, (50, 2)), 9: rng.uniform(0, 100, (2, 2))}
    got = {}
    for r in stitching.nearest(points_of(spark, tiles), ("y", "x"), 3).collect():
        got.setdefault((r["tile"], r["id"]), {})[r["nth"]] = (r["d_y"], r["d_x"])
    for t, p in tiles.items():
        for i, near in by_hand(p, p, 3, True).items():
            assert len(got[t, i]) == min(3, len(p) - 1)
            assert all(np.allclose(got[t, i][n + 1], p[j] - p[i]) for n, (j, _) in enumerate(near))


def match_by_hand(a, b, neighbours, redundancy, significance):
    """Descriptor by descriptor."""
    from itertools import combinations

    def shapes(p):
        k = neighbours + redundancy
        if len(p) <= k:
            return np.zeros((0, 2 * neighbours)), np.zeros(0, int)
        near = by_hand(p, p, k, True)
        rows = [(np.concatenate([p[near[i][c][0]] - p[i] for c in pick]), i) for i in range(len(p)) for pick in combinations(range(k), neighbours)]
        return np.array([r for r, _ in rows]), np.array([i for _, i in rows])

    (da, oa), (db, ob) = shapes(a), shapes(b)
    if not len(da) or not len(db):
        return set()
    d = np.sqrt(((da[:, None] - db[None]) ** 2).sum(-1))
    by = np.full((len(a), len(b)), np.inf)
    np.minimum.at(by, (oa[:, None], ob[None, :]), d)
    out = set()
    for i in range(len(a)):
        order = np.argsort(by[i], kind="stable")
        j = int(order[0])
        if by[i, j] < np.inf and by[i, j] * significance <= (by[i, order[1]] if len(order) > 1 else np.inf) and int(np.argmin(by[:, j])) == i:
            out.add((i, j))
    return out


@pytest.mark.parametrize("redundancy", [0, 1])
def test_matches_are_those_of_brute_force(spark, monkeypatch, redundancy):
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(6)
    p = rng.uniform(0, 300, (120, 2))
    q = np.concatenate([p[:90] + (12.0, -7.0) + rng.normal(size=(90, 2)) * 0.2, rng.uniform(0, 300, (40, 2))])
    a, b = (stitching.descriptors(points_of(spark, {0: x}), ("y", "x"), 3, None, redundancy) for x in (p, q))
    got = {(r["ia"], r["ib"]) for r in stitching.match(a, b, ("y", "x"), 2.0).collect()}
    want = match_by_hand(p, q, 3, redundancy, 2.0)
    assert got == want and len(want) > 12


def matches_of(spark, p, q, pair=None):
    rows = pd.DataFrame(np.c_[p, q], columns=["p_y", "p_x", "q_y", "q_x"])
    return spark.createDataFrame(rows if pair is None else rows.assign(pair=pair))


def test_a_turn_is_found_among_outliers(spark):
    """Seven of ten matches are wrong."""
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 500, (400, 2))
    c, s = np.cos(0.4), np.sin(0.4)
    q = p @ np.array([[c, s], [-s, c]]) + (30.0, -12.0) + rng.normal(size=p.shape) * 0.3
    q[120:] = rng.uniform(0, 500, (280, 2))
    for model in ("rigid", "affine"):
        r = fitting.ransac(matches_of(spark, p, q), ("y", "x"), model, 2.0, trials=1500, seed=1).first()
        m = np.array(r["model"]).reshape(2, 3)
        assert r["kept"] and r["n"] == 400 and 115 <= r["inliers"] <= 130
        assert np.allclose(m[:, :2], [[c, -s], [s, c]], atol=5e-3) and np.allclose(m[:, 2], (30, -12), atol=1.0)
    again = [fitting.ransac(matches_of(spark, p, q).repartition(n), ("y", "x"), "rigid", 2.0, seed=5).first()["model"] for n in (1, 5)]
    assert np.allclose(*again)


def test_groups_are_fitted_apart_and_poor_ones_are_not_kept(spark, monkeypatch):
    monkeypatch.setattr(fitting, "COUNTED", 30)
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (100, 2))
    parts = [matches_of(spark, p, p + (5.0, 1.0), 1), matches_of(spark, p[:50], p[:50] + (-9.0, 2.0), 2), matches_of(spark, p[:20], rng.uniform(0, 1e4, (20, 2)), 3), matches_of(spark, p[:1], p[:1], 4)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r["pair"]: r for r in fitting.ransac(rows, ("y", "x"), "rigid", 1.0, trials=200, group="pair").collect()}
    assert np.allclose(got[1]["model"], [1, 0, 5, 0, 1, 1], atol=1e-6) and got[1]["inliers"] == 100 and got[1]["kept"]
    assert np.allclose(got[2]["model"], [1, 0, -9, 0, 1, 2], atol=1e-6) and got[2]["kept"]
    assert not got[3]["kept"] and got[4]["model"] is None and not got[4]["kept"] and got[4]["n"] == 1
    with pytest.raises(ValueError):
        fitting.ransac(rows, ("y", "x"), "bent")


def test_tiles_are_placed_as_by_least_squares(spark):
    rng = np.random.default_rng(5)
    true = rng.normal(size=(9, 2)) * 10
    links = [(a, b, float(rng.integers(1, 9)), *(true[b] - true[a] + rng.normal(size=2) * 0.1).tolist()) for a, b in [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3), (4, 5), (5, 6), (4, 6)]]
    wrong = (0, 2, 3.0, 70.0, -40.0)
    names = spark.createDataFrame([(i,) for i in range(9)], "tile long")
    df = spark.createDataFrame([*links, wrong], "a long, b long, weight double, o_y double, o_x double")
    placed, used = fitting.placed_tiles(names, df, ("y", "x"), 3.0)
    got = {r["tile"]: r for r in placed.collect()}
    want = fitting.place_tiles([(a, b, np.array(o), w) for a, b, w, *o in links], list(range(9)))
    assert all(np.allclose((got[i]["t_y"], got[i]["t_x"]), want[i], atol=1e-6) for i in range(9))
    assert [got[i]["joined"] for i in range(9)] == [True] * 7 + [False] * 2
    assert [(r["a"], r["b"]) for r in used.where("dropped").collect()] == [(0, 2)] and used.count() == 9


def test_six_tiles_come_together(spark):
    """A 2 x 3 plate, each tile a few voxels off: placed within half a voxel, with a report of every overlap."""
    rng = np.random.default_rng(8)
    world = rng.uniform(0, (220, 320), (900, 2))
    off = np.round(rng.uniform(-4, 4, (6, 2)), 2)
    off[0] = 0
    boxes, points = [], []
    for t in range(6):
        lo = np.array([t // 3 * 100.0, t % 3 * 100.0])
        hi = lo + 120
        boxes.append((t, *lo.tolist(), *hi.tolist()))
        seen = world[((world >= lo) & (world <= hi)).all(1)]
        points += [(t, i, *(p + off[t] + rng.normal(size=2) * 0.05).tolist()) for i, p in enumerate(seen)]
    tiles = spark.createDataFrame([(t, a, c, b, d) for t, a, b, c, d in boxes], "tile long, lo_y double, hi_y double, lo_x double, hi_x double")
    pts = spark.createDataFrame(points, "tile long, id long, y double, x double")
    placed, report = stitching.stitch(tiles, pts, ("y", "x"), margin=5.0, epsilon=2.0, least=4)
    got = {r["tile"]: r for r in placed.collect()}
    assert all(abs(got[t]["t_y"] + off[t][0]) < 0.5 and abs(got[t]["t_x"] + off[t][1]) < 0.5 and got[t]["joined"] for t in range(6))
    rows = report.collect()
    pairs = {(r["a"], r["b"]) for r in rows}
    assert {(0, 1), (1, 2), (3, 4), (4, 5), (0, 3), (1, 4), (2, 5)} <= pairs and len(rows) == len(pairs) == 11
    kept = [r for r in rows if r["kept"]]
    assert len(kept) >= 7 and all(r["error"] < 0.5 and r["error_max"] < 2 and r["inliers"] <= r["candidates"] <= min(r["points_a"], r["points_b"]) for r in kept)
    assert all(r["error"] is None for r in rows if not r["kept"])
