"""Nearest neighbours and matches where many points lie in one place, and of tables a little over the sample."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import neighbours
from gridloom.functions.neighbours import KdTree, nearest_join
from gridloom.operators import stitching

from .test_stitching_run import by_hand, match_by_hand, points_of, table


def test_tables_a_little_over_the_sample(spark, monkeypatch):
    """Between one and 1.2 times the sample, the whole table is drawn."""
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "SAMPLE", 100)
    x = np.random.default_rng(11).uniform(0, 50, (110, 2))
    want = by_hand(x, x, 3, True)
    got = nearest_join(table(spark, x), table(spark, x), 3, others=True).collect()
    assert len(got) == 330 and all(want[r["query"]][r["nth"] - 1][0] == r["point"] for r in got)


def test_copies_are_compared_once(spark, monkeypatch):
    """Spots, not points, meet: work does not grow with the square of what lies in one place."""
    monkeypatch.setattr(neighbours, "LEAF", 8)
    asked, meet = [], neighbours._meet

    def counted(asks, *rest):
        asked.append(asks.groupBy("id").count().count())
        return meet(asks, *rest)

    monkeypatch.setattr(neighbours, "_meet", counted)
    rng = np.random.default_rng(12)
    places = rng.uniform(-9, 9, (30, 3))
    x = places[np.r_[np.zeros(300, int), np.arange(30), rng.integers(0, 30, 70)]][rng.permutation(400)]
    for others in (True, False):
        want = by_hand(x, x, 4, others)
        got = {}
        for r in nearest_join(table(spark, x).repartition(5), table(spark, x).repartition(3), 4, others).collect():
            got.setdefault(r["query"], {})[r["nth"]] = (r["point"], r["d2"])
        assert {i: [near[n] for n in sorted(near)] for i, near in got.items()} == want
        assert all(list(sorted(near)) == [1, 2, 3, 4] for near in got.values())
    assert max(asked) <= 30


def test_cuts_part_where_most_lie_on_the_upper_edge():
    """More than half of the points share the largest coordinate."""
    rng = np.random.default_rng(13)
    x = np.c_[np.where(np.arange(800) < 600, 10.0, rng.uniform(-500, 10, 800)), rng.uniform(0, 1, 800)]
    leaf = KdTree.of(x, 5).leaf(x)
    assert np.bincount(leaf).max() <= 100


def test_ties_fall_by_id_however_rows_lie(spark, monkeypatch):
    """Each point three to six times: the smallest ids match, whatever the order of rows."""
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(14)
    spots = np.round(rng.uniform(0, 200, (40, 2)))
    p = np.concatenate([spots] * 3 + [spots[:20]] * 3 + [np.round(rng.uniform(0, 200, (30, 2)))])[::-1]
    q = p + (16.0, -8.0)
    want = match_by_hand(p, q, 3, 0, 3.0)
    shuffled = lambda x, n: points_of(spark, {0: x}).orderBy(F.xxhash64("id", F.lit(n))).repartition(n)
    for n in (2, 7):
        a, b = (stitching.descriptors(shuffled(x, n), ("y", "x"), 3) for x in (p, q))
        assert {(r["ia"], r["ib"]) for r in stitching.match(a, b, ("y", "x")).collect()} == want
    assert len(want) > 20
