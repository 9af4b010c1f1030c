"""Lineages through divisions, exact percentiles, coverage of all levels, operators of one voxel size."""

import numpy as np
import pytest

from gridloom.grid import Grid
from gridloom.meta import ArrayMeta, Box
from gridloom.operators import aggregate, pointwise, tracking
from gridloom.plans.pipeline import OPS, Op, Spec, at_one_size, coverage_levels


def label_frames(spark, frames):
    """Frames of rows of digits, 0 for nothing."""
    rows = [(t, y, x, int(c)) for t, f in enumerate(frames) for y, line in enumerate(f) for x, c in enumerate(line) if c != "0"]
    df = spark.createDataFrame(rows, "t long, y long, x long, v long")
    return Grid(df, ArrayMeta(("t", "y", "x"), (len(frames), len(frames[0]), len(frames[0][0])), "int64", kind="label"))


def test_lineages_go_through_divisions(spark):
    """Object 1 comes from 7, collapses and is lost; 2 and 3 are born near it; 2 divides again into 4 and 5; 9 goes its own way."""
    whole, small = ["0111100000", "0111100009"], ["0011000000", "0000000009"]
    frames = [
        [line.replace("1", "7") for line in whole], whole, small, ["0000000000", "0000000009"],
        ["2200330000", "2200330009"], ["2200330000", "2200330009"], ["2000330000", "0000330009"], ["0000330000", "0000330009"],
        ["4050330000", "0000330009"], ["4050330000", "0000330009"],
    ]
    labels = label_frames(spark, frames)
    asked = spark.createDataFrame([(1, 1), (8, 9), (5, 1)], "t long, label long")  # the last is not there
    rows = tracking.lineages(labels, asked, gap=4, within=4.0).collect()
    branches = {}
    for r in rows:
        branches.setdefault((r["t0"], r["label0"], r["branch"], r["mother"]), set()).add((r["t"], r["label"]))
    assert branches == {
        (1, 1, 0, None): {(0, 7), (1, 1), (2, 1)},
        (1, 1, 1, 0): {(4, 2), (5, 2), (6, 2)},
        (1, 1, 2, 0): {(t, 3) for t in range(4, 10)},
        (1, 1, 3, 1): {(8, 4), (9, 4)},
        (1, 1, 4, 1): {(8, 5), (9, 5)},
        (8, 9, 0, None): {(t, 9) for t in range(10)},
    }
    few = {(r["label0"], r["branch"]) for r in tracking.lineages(labels, asked, max_branches=3, gap=4, within=4.0).collect()}
    assert few == {(1, 0), (1, 1), (1, 2), (9, 0)}
    assert {r["branch"] for r in tracking.lineages(labels, asked, max_branches=1).collect()} == {0}


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_percentiles_are_exact(spark, n):
    values = np.round(np.random.default_rng(n).normal(size=n) * 3, 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "x long, v double").repartition(5)
    for low, high in ((0.5, 99.5), (0, 100), (33.3, 66.6)):
        got = aggregate.percentile_range(Grid(df, ArrayMeta(("x",), (n,))), low, high).first()
        assert np.allclose(got, np.percentile(values, [low, high]))
    empty = aggregate.percentile_range(Grid(df.where("false"), ArrayMeta(("x",), (n,)))).first()
    assert tuple(empty) == (None, None)


def test_coverage_of_all_levels(spark):
    metas = [ArrayMeta(("y", "x"), (9, 10), chunk=(3, 4), voxel_size=(1, 1)), ArrayMeta(("y", "x"), (5, 5), chunk=(2, 4), voxel_size=(2, 2)), ArrayMeta(("y", "x"), (3, 3), chunk=(3, 3), voxel_size=(4, 4))]
    fine = {(y, x) for y in range(3) for x in range(3)} - {(2, 2)}
    held = [fine, {(0, 0), (2, 1)}, {(0, 0)}]
    frames = [spark.createDataFrame(sorted(h), "chunk_y long, chunk_x long") for h in held]
    got = {(r["level"], r["chunk_y"], r["chunk_x"]): r["bits"] for r in coverage_levels(metas, frames).collect()}
    want = {}
    for k, m in enumerate(metas):
        for y in range(-(-m.shape[0] // m.chunk[0])):
            for x in range(-(-m.shape[1] // m.chunk[1])):
                box = Box.of_chunk((y, x), m.chunk, m.shape)
                size = [s / f for s, f in zip(m.voxel_size, metas[0].voxel_size, strict=True)]
                under = [c for c in ((i, j) for i in range(3) for j in range(3)) if all(a * s < min((i + 1) * n, w) and b * s > i * n for a, b, s, i, n, w in zip(box.start, box.stop, size, c, metas[0].chunk, metas[0].shape, strict=True))]
                want[k, y, x] = int((y, x) in held[k]) + 2 * all(c in fine for c in under)
    assert got == want and {1, 2, 3} <= set(want.values()) | {1}


def test_operators_of_one_voxel_size(spark, monkeypatch):
    for name, size in (("of_two", (2.0,)), ("of_three", (3.0,))):
        monkeypatch.setitem(OPS, name, Op(name, pointwise.scale, voxel_size=size))
    df = spark.createDataFrame([(i, float(i * i % 11)) for i in range(16)], "x long, v double")
    levels = aggregate.pyramid(Grid(df, ArrayMeta(("x",), (16,), chunk=(4,))), 4)
    values = lambda g: [r["v"] for r in g.df.orderBy("x").collect()]
    spec = lambda name: Spec.of({"source": "a", "ops": [{"op": "scale", "factor": 3.0}, {"op": name, "factor": 2.0}, {"op": "scale", "offset": 1.0, "factor": 1.0}]})
    alone = at_one_size(spec("of_two"), levels)
    assert len(alone) == 1 and np.allclose(values(alone[0].read()), 6 * np.array(values(levels[1])) + 1)
    assert alone[0].read(Box((2,), (5,))).df.count() == 3 and alone[0].metas()[-1].voxel_size == (2.0,)
    every = at_one_size(spec("of_two"), levels, coarse="compute")
    assert [p.metas()[-1].voxel_size[0] for p in every] == [2.0, 4.0, 8.0]
    for p, g in zip(every, levels[1:], strict=True):
        assert np.allclose(values(p.read()), 6 * np.array(values(g)) + 1)
    (near,), (made,) = (at_one_size(spec("of_three"), levels, input_level=how) for how in ("nearest", "resample"))
    assert near.source.meta.voxel_size == (4.0,)
    assert made.source.meta.voxel_size == (3.0,) and made.read().df.count() == 6
    for bad in ({"input_level": "exact"}, {"coarse": "all"}, {"input_level": "none"}):
        with pytest.raises(ValueError):
            at_one_size(spec("of_three"), levels, **bad)
    with pytest.raises(ValueError):
        at_one_size(Spec.of({"source": "a", "ops": [{"op": "scale", "factor": 3.0}]}), levels)
