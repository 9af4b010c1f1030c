"""Operators against numpy on whole arrays, and the invariants that pipelines rest on."""

import numpy as np
import pandas as pd
import pytest

from gridloom.geometry.resample import resample
from gridloom.geometry.transforms import Affine, Bijection, ByDimension, Scene, Sequence, UnsupportedTransform, parse, simplified
from gridloom.grid import Grid
from gridloom.meta import ArrayMeta, Box, level_box, level_for, nearest_level
from gridloom.operators import aggregate, axes, overlap, pointwise, segment, stencil, tracking
from gridloom.plans.pipeline import Pipeline, Registry, Spec
from gridloom.sources import stores


def grid(spark, a, chunk=None, kind=None, dtype="float64", names=None):
    at = np.indices(a.shape).reshape(a.ndim, -1)
    names = names or ("t", "z", "y", "x")[-a.ndim :]
    df = spark.createDataFrame(pd.DataFrame({n: at[i] for i, n in enumerate(names)} | {"v": a.ravel().astype(float)}))
    return Grid(df, ArrayMeta(tuple(names), a.shape, dtype, chunk or a.shape, kind=kind))


def array(g):
    p = g.df.toPandas()
    out = np.full(g.meta.shape, np.nan)
    out[tuple(p[a].to_numpy() for a in g.axes)] = p["v"].to_numpy()
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).random((13, 17))


def test_boxes_and_levels():
    b = Box((2, 3), (5, 9))
    assert b.pad((1, 2)).clip((6, 10)) == Box((1, 1), (6, 10)) and b.shape == (3, 6) and Box((3,), (3,)).empty
    fine = ArrayMeta(("y", "x"), (100, 50), voxel_size=(4.0, 4.0))
    half = fine.rescaled((8.0, 8.0))
    assert half.shape == (50, 25) and half.translation == (4.0, 4.0)
    assert level_box(Box((3, 3), (9, 9)), fine, half) == Box((1, 1), (5, 5))
    assert level_for([fine, half], (8.0, 8.0)) == 1 and level_for([fine, half], (7.0, 7.0)) == 0 and nearest_level([fine, half], (7.0, 7.0)) == 1


def test_gaussian_is_numpys(spark, noise):
    w = stencil.gaussian_weights(1.3)
    r = max(w)
    want = np.pad(noise, r, mode="edge")
    want = sum(want[r + k : r + k + 13, :] * x for k, x in w.items())
    want = sum(want[:, r + k : r + k + 17] * x for k, x in w.items())
    assert np.allclose(array(stencil.gaussian(grid(spark, noise), 1.3)), want)


def test_threshold_leaves_nan_out(spark):
    a = np.array([[np.nan, 1.0, 2.0]])
    assert array(pointwise.threshold(grid(spark, a), 1, 2)).tolist() == [[0, 1, 0]]
    with pytest.raises(ValueError):
        pointwise.threshold(grid(spark, a), 1, value=0)


def test_label_joins_what_touches(spark):
    a = np.zeros((6, 7))
    a[0, :3] = a[1, 2] = a[4, 4] = a[5, 5] = 1
    got = array(segment.label(grid(spark, a)))
    assert len(set(got[a > 0])) == 3 and len({got[0, 0], got[0, 2], got[1, 2]}) == 1
    assert len(set(array(segment.label(grid(spark, a), connectivity=2))[a > 0])) == 2


def test_blocks_do_not_show(spark, noise):
    whole = array(stencil.uniform(grid(spark, noise), 3))

    def mean(b):
        p = np.pad(b, 1, mode="edge")
        return sum(p[i : i + b.shape[0], j : j + b.shape[1]] for i in range(3) for j in range(3)) / 9

    for chunk in ((4, 5), (13, 17), (1, 8)):
        assert np.allclose(array(overlap.in_blocks(grid(spark, noise, chunk), mean, 1)), whole)


def test_a_box_is_cut_from_the_whole(spark, noise):
    spec = Spec.of({"source": "a", "ops": [{"op": "gaussian", "sigma": 0.8}, {"op": "downsample", "factor": [2, 2], "mode": "mean"}, {"op": "uniform", "size": 3}]})
    p = Pipeline(spec, grid(spark, noise, (4, 4)))
    box = Box((2, 1), (5, 6))
    got = p.read(box).df.toPandas().sort_values(["y", "x"])["v"].to_numpy()
    assert np.allclose(got, array(p.read())[2:5, 1:6].ravel())


def test_an_edit_changes_later_stages_only(spark, noise):
    ops = [{"op": "scale", "factor": 2.0}, {"op": "uniform"}, {"op": "threshold", "low": 0.5}]
    a = Pipeline(Spec.of({"source": "a", "ops": ops}), grid(spark, noise)).stages
    b = Pipeline(Spec.of({"source": "a", "ops": [ops[0], {"op": "uniform", "size": 5}, ops[2]]}), grid(spark, noise)).stages
    assert a[:2] == b[:2] and not set(a[2:]) & set(b[2:])


def test_registry_renews_and_refuses(spark, noise):
    r = Registry(spark, lambda name: grid(spark, noise))
    r.put("one", Spec.of({"source": "a"}))
    r.put("two", Spec.of({"source": "dataset://one", "ops": [{"op": "scale", "factor": 3.0}]}))
    assert r.put("one", Spec.of({"source": "a", "ops": [{"op": "scale", "factor": 2.0}]})) == ["one", "two"]
    assert np.allclose(array(r.open("two")), noise * 6)
    for bad in ({"source": "dataset://two"}, {"source": "dataset://none"}):
        with pytest.raises(ValueError):
            r.put("one", Spec.of(bad))
    with pytest.raises(ValueError):
        r.remove("one")


@pytest.mark.parametrize(("form", "how"), [("zarr2", "gzip"), ("zarr2", "none"), ("zarr3", "zstd"), ("n5", "gzip"), ("n5", "none"), ("precomputed", "none")])
def test_stores_give_back_what_they_took(spark, tmp_path, form, how):
    a = np.random.default_rng(1).integers(0, 250, (5, 9, 11)).astype(float)
    a[:2, :4, :4] = 0
    g = grid(spark, a, (2, 4, 4), dtype="uint8")
    done = stores.write(g, f"file://{tmp_path}/{form}", form, how).first()
    assert done["skipped"] >= 1 and done["chunks"] == done["written"] + done["skipped"]
    back = stores.read(spark, f"file://{tmp_path}/{form}")
    assert np.array_equal(array(back), a) and back.meta.dtype == "uint8"
    part = stores.read(spark, f"file://{tmp_path}/{form}", Box((1, 2, 3), (4, 9, 7))).df.toPandas()
    assert len(part) == 3 * 7 * 4 and np.array_equal(part["v"], a[part["z"], part["y"], part["x"]])


def test_transforms_compose(spark):
    t = parse({"type": "sequence", "transformations": [{"type": "scale", "scale": [2.0, 3.0]}, {"type": "translation", "translation": [1.0, -1.0]}]})
    assert len(simplified(t).parts) == 1
    df = spark.createDataFrame([(1.0, 2.0)], "p0 double, p1 double")
    assert tuple(t.apply(df).first()) == (3.0, 5.0)
    assert np.allclose(tuple(t.inverse().apply(t.apply(df)).first()), (1.0, 2.0))
    scene = Scene().add("a", "b", t).add("c", "b", Affine.of([[0.0, 1.0], [1.0, 0.0]]))
    assert tuple(scene.transform("a", "c").apply(df).first()) == (5.0, 3.0)
    with pytest.raises(ValueError):
        scene.transform("a", "elsewhere")
    with pytest.raises(UnsupportedTransform):
        parse({"type": "spiral"})
    with pytest.raises(ValueError):
        ByDimension((((0,), (0,), t), ((1,), (0,), t)))
    assert Bijection(t, t.inverse()).inverse().n_in == 2 and Sequence((t,)).n_out == 2


def test_resampling_a_shift_is_exact(spark, noise):
    g = grid(spark, noise)
    out = array(resample(g, g.meta, Affine.of(np.eye(2), [2.0, 0.0])))
    assert np.allclose(out[:11], noise[2:]) and not out[11:].any()


def test_refusals(spark, noise):
    g = grid(spark, noise)
    for bad in (lambda: axes.select(g, {"y": 1}), lambda: axes.flip(g, ["q"]), lambda: axes.stack([g]), lambda: axes.keep_levels([g], [1]), lambda: aggregate.downsample(g, 2, "median"), lambda: Spec.of({"source": "a", "ops": [{"op": "none"}]})):
        with pytest.raises(ValueError):
            bad()


def test_fits_find_what_was_done(spark):
    from gridloom.operators import fitting

    rng = np.random.default_rng(2)
    p = rng.random((60, 2)) * 100
    a = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    q = p @ a.T + [5, -3]
    df = spark.createDataFrame(pd.DataFrame({"p_y": p[:, 0], "p_x": p[:, 1], "q_y": q[:, 0], "q_x": q[:, 1]}))
    for model in ("rigid", "affine"):
        got = fitting.fit(df, ("y", "x"), model)
        assert np.allclose(got.matrix, a, atol=1e-6) and np.allclose(got.offset, [5, -3], atol=1e-5)
    bad = df.unionByName(spark.createDataFrame([(0.0, 0.0, 90.0, 90.0)] * 5, df.schema))
    model, n = fitting.robust_fit(bad, ("y", "x"), Affine.of(a, [5.2, -3.1]), "affine", 2.0)
    assert n == 60 and np.allclose(model.offset, [5, -3], atol=1e-5)
    with pytest.raises(ValueError):
        fitting.fit(df.limit(1), ("y", "x"), "affine")
    placed = fitting.place_tiles([(0, 1, np.array([1.0, 2.0]), 1.0), (1, 2, np.array([1.0, 0.0]), 1.0), (0, 2, np.array([2.3, 2.0]), 1.0)], [0, 1, 2, 3])
    assert np.allclose(placed[0], 0) and np.allclose(placed[2], [2.2, 2.0]) and np.allclose(placed[3], 0)


def test_code_in_specs(spark, noise):
    from gridloom.operators.code import python_op

    op = python_op("twice", "#halo 1\ndef apply(block, k=2):\n    return block * k\n", allow_code=True)
    assert np.allclose(array(op.apply(grid(spark, noise, (5, 6)), k=3, old=1)), noise * 3) and op.halo({}, grid(spark, noise).meta) == (1, 1)
    with pytest.raises(PermissionError):
        python_op("x", "def apply(b): return b")
    for bad in ("def apply(:", "x = 1", "#halo 5000\ndef apply(b): return b"):
        with pytest.raises(ValueError):
            python_op("x", bad, allow_code=True)


def test_chunk_sizes(spark, tmp_path, noise):
    stores.write(grid(spark, noise, (5, 6)), f"file://{tmp_path}/s", "zarr3", "none")
    assert (array(stores.chunk_sizes(spark, f"file://{tmp_path}/s")) == 255).all()


def test_affine_by_moments_undoes_a_shift(spark):
    y, x = np.mgrid[:24, :28]
    blob = lambda cy, cx: 100 * np.exp(-((y - cy) ** 2 / 18 + (x - cx) ** 2 / 50)) + 60 * np.exp(-((y - cy - 3) ** 2 + (x - cx - 4) ** 2) / 6)
    from gridloom.operators.fitting import affine_by_moments

    t, score = affine_by_moments(grid(spark, blob(11, 12)), grid(spark, blob(13, 15)))
    assert score > 0.95 and np.allclose(np.array(t.matrix) @ [11, 12] + t.offset, [13, 15], atol=1.0)


def test_base_units():
    m = ArrayMeta(("t", "c", "z", "y"), (1, 1, 1, 1), voxel_size=(2.0, 1.0, 4.0, 3.0), units=("min", "", "micrometer", "furlong"))
    assert m.dimensions() == {"t": (120.0, "s"), "c": (1.0, ""), "z": (4.0 * 1e-6, "m"), "y": (3.0 * 1e-9, "m")}


def test_boxes_by_axis():
    box = Box((2, -3), (9, 4))
    assert box.pad((1, 2)) == Box((1, -5), (10, 6)) and box.clip((5, 3)) == Box((2, 0), (5, 3)) and box.clip((1, 9)).empty
    assert box.shape == (7, 7) and Box((3,), (1,)).shape == (0,) and Box.of_chunk((1, 0), (4, 5), (6, 3)) == Box((4, 0), (6, 3))
    with pytest.raises(ValueError):
        Box((1,), (2, 3))


def test_mothers_had_collapsed(spark):
    frames = np.zeros((8, 6, 6), int)
    for t, n in enumerate((4, 5, 5, 2)):
        frames[t, :n, :4] = 1  # grows, collapses and is lost
    frames[:5, 5, 5] = 2  # is lost as it was
    frames[:, 4:, 0] = 3  # stays
    found = tracking.mothers(grid(spark, frames, kind="label", names=("t", "y", "x")))
    assert [(r["t0"], r["first"], r["lost"], r["t"], r["label"]) for r in found.collect()] == [(0, 1, 4, 1, 1)]


def test_tracks_of_any_length(spark):
    rng = np.random.default_rng(4)
    frames = np.zeros((21, 1, 40), int)
    for k in range(6):
        begin, end = sorted(rng.integers(0, 22, 2))
        frames[begin:end, 0, 6 * k : 6 * k + 4] = k + 1
    g = grid(spark, frames, kind="label", names=("t", "y", "x"))
    got = {tuple(r) for r in tracking.follow(g).select("t0", "first", "t", "label").collect()}
    want = {(int(np.flatnonzero((frames == k).any((1, 2)))[0]), k, int(t), k) for k in range(1, 7) for t in np.flatnonzero((frames == k).any((1, 2)))}
    assert got == want
    with pytest.raises(RuntimeError):
        tracking.follow(g, max_steps=2)
