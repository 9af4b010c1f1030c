"""Deformable registration: the gradient against differences, and twisted images brought back."""

import numpy as np
import pytest

from gridloom.geometry.transforms import Affine
from gridloom.grid import Grid
from gridloom.meta import ArrayMeta, Box
from gridloom.operators import registration as reg
from gridloom.operators.registration import Fit, Lattice


def smooth(shape, seed=0, width=2.0):
    a = np.random.default_rng(seed).normal(size=shape)
    taps = np.exp(-np.arange(-8, 9) ** 2 / (2 * width**2))
    for axis in range(len(shape)):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, 8, mode="edge"), taps, "valid"), axis, a)
    return 200 * (a - a.min()) / (a.max() - a.min())


def as_grid(spark, a, voxel=1.0):
    axes = ("z", "y", "x")[-a.ndim :]
    at = np.indices(a.shape).reshape(a.ndim, -1)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({n: i for n, i in zip(axes, at, strict=True)} | {"v": a.ravel().astype(float)}))
    return Grid(df, ArrayMeta(axes, a.shape, "float32", voxel_size=(voxel,) * a.ndim))


def dense(grid):
    out = np.full(grid.meta.shape, np.nan)
    rows = grid.df.toPandas()
    out[tuple(rows[a] for a in grid.axes)] = rows["v"]
    return out


def twisted(a, angle=0.35, radius=14.0):
    """The image turned about its middle in the last two axes, by an angle that fades; and by how much each voxel looks aside."""
    at = np.stack(np.indices(a.shape), -1).astype(float)
    d = at[..., -2:] - (np.array(a.shape[-2:]) - 1) / 2
    t = angle * np.exp(-(d**2).sum(-1) / radius**2)
    move = np.zeros_like(at)
    move[..., -2] = d[..., 0] * (np.cos(t) - 1) - d[..., 1] * np.sin(t)
    move[..., -1] = d[..., 0] * np.sin(t) + d[..., 1] * (np.cos(t) - 1)
    return reg._sampled(a, np.clip(at + move, 0, np.array(a.shape) - 1))[0], move


def correlation(a, b):
    return float(np.corrcoef(a.ravel(), b.ravel())[0, 1])


@pytest.mark.parametrize("shape", [(13, 15), (7, 8, 9)])
def test_the_gradient_is_that_of_differences(shape):
    rng = np.random.default_rng(1)
    d = len(shape)
    fixed, moving = (smooth(shape, s, 1.2).astype(np.float32) / 200 for s in (1, 2))
    meta = ArrayMeta(("z", "y", "x")[-d:], shape, "float32", voxel_size=(1.5, 2.0, 1.0)[-d:])
    affine = Affine.of(np.eye(d) + 0.02 * rng.normal(size=(d, d)), 0.3 * rng.normal(size=d))
    level = reg.Level(meta, meta, affine, 5)
    low, high = reg._extent(meta)
    zero = Lattice(np.zeros((*(4,) * d, d)), low, high)
    now = Lattice(0.4 * rng.normal(size=zero.values.shape), low, high)
    cores = [Box((0,) * d, (6, *shape[1:])), Box((6, *(0,) * (d - 1)), shape)]
    blocks = [reg.Block(c, np.zeros(d, int), fixed, np.zeros(d, int), moving) for c in cores]

    def total(lattice):
        return sum(reg.gradient(b, level, lattice, zero)[0] for b in blocks)

    slope = np.zeros_like(now.values)
    for b in blocks:
        _, part, ranges = reg.gradient(b, level, now, zero)
        slope[ranges] += part
    whole = reg.Block(Box((0,) * d, shape), np.zeros(d, int), fixed, np.zeros(d, int), moving)
    value, part, ranges = reg.gradient(whole, level, now, zero)
    again = np.zeros_like(slope)
    again[ranges] += part
    assert np.isclose(value, total(now)) and np.allclose(again, slope)
    for _ in range(12):
        k = tuple(int(rng.integers(n)) for n in now.values.shape)
        step = np.zeros_like(now.values)
        step[k] = 1e-6
        by = (total(Lattice(now.values + step, low, high)) - total(Lattice(now.values - step, low, high))) / 2e-6
        assert np.isclose(by, slope[k], rtol=2e-3, atol=1e-5)
    _, rough = reg.roughness(now)
    k = (1,) * now.values.ndim
    step = np.zeros_like(now.values)
    step[k] = 1e-6
    by = (reg.roughness(Lattice(now.values + step, low, high))[0] - reg.roughness(Lattice(now.values - step, low, high))[0]) / 2e-6
    assert np.isclose(by, rough[k], rtol=1e-5)


def test_a_twisted_image_comes_back(spark):
    fixed = smooth((48, 52), 3)
    moving, move = twisted(fixed)
    done = reg.register([as_grid(spark, fixed)], [as_grid(spark, moving)], fit=Fit(steps=(60,), spacing=6.0, smooth=0.3, block=20), levels=[0], frames=3)
    back = dense(done.image())
    inner = (slice(6, -6),) * 2
    before, after = 1 - correlation(fixed[inner], moving[inner]), 1 - correlation(fixed[inner], back[inner])
    assert after < 0.1 * before
    (first, last), = done.correlation
    assert last > first
    # moving = fixed(p + move), so moving(p + u) = fixed where u undoes move: within a voxel
    u = done.displacements().df.toPandas().pivot_table(index=["y", "x"], columns="c", values="v").to_numpy().reshape(*fixed.shape, 2)
    there = np.stack(np.indices(fixed.shape), -1) + u
    seen = np.stack([reg._sampled(move[..., i], np.clip(there, 0, np.array(fixed.shape) - 1))[0] for i in range(2)], -1)
    assert np.abs(u + seen)[inner].max() < 1.0
    assert len(done.frames) == 3 and not done.frames[0].values.any() and np.array_equal(done.frames[-1].values, done.lattice.values)
    pair = done.pair()
    assert pair.axes == ("c", "y", "x") and np.allclose(dense(pair)[0], fixed) and np.allclose(dense(pair)[1], back)


def test_volumes_go_coarse_to_fine(spark):
    fixed = smooth((10, 28, 28), 5, 1.6)
    moving, _ = twisted(fixed, 0.4, 9.0)
    fine, coarse = [as_grid(spark, a) for a in (fixed, moving)], []
    for a in (fixed, moving):
        h = a.reshape(5, 2, 14, 2, 14, 2).mean(axis=(1, 3, 5))
        coarse.append(as_grid(spark, h, 2.0))
    done = reg.register([fine[0], coarse[0]], [fine[1], coarse[1]], fit=Fit(steps=(25, 25), window=(5, 7), smooth=0.3, block=16), levels=[1, 0])
    inner = (slice(2, -2), slice(4, -4), slice(4, -4))
    back = dense(done.image())
    assert 1 - correlation(fixed[inner], back[inner]) < 0.3 * (1 - correlation(fixed[inner], moving[inner])) and len(done.correlation) == 2
    assert done.image(1).meta.shape == (5, 14, 14)


def test_the_affine_alone_needs_no_fit(spark):
    fixed = smooth((12, 20), 1)
    done = reg.register([as_grid(spark, fixed)], [as_grid(spark, fixed)], Affine.of(np.eye(2), (0.0, 2.0)), Fit(steps=(0,)))
    out = dense(done.image())
    assert np.allclose(out[:, :-2], fixed[:, 2:]) and not out[:, -2:].any() and done.correlation == ()


def test_what_the_moving_image_does_not_cover_is_left_alone(spark):
    fixed = smooth((40, 48), 7)
    done = reg.register([as_grid(spark, fixed)], [as_grid(spark, fixed[:, :30])], fit=Fit(steps=(30,), spacing=5.0, block=16), levels=[0])
    u = done.displacements().df.toPandas().pivot_table(index=["y", "x"], columns="c", values="v").to_numpy().reshape(*fixed.shape, 2)
    size = np.linalg.norm(u, axis=-1)
    assert size[:, :26].mean() < 0.12 and size[:, 30:].mean() < 0.7


def test_fields_that_outgrow_their_blocks_are_dealt_anew(spark):
    fixed = smooth((30, 48), 9, 3.0)
    moving, _ = twisted(fixed, 0.4, 12.0)
    deals, found = [], []
    for margin in (0.25, 30.0):
        pair = reg.Pair.of(as_grid(spark, fixed), as_grid(spark, moving), Affine.of(np.eye(2)), 7, 12, [(0.0, 200.0)] * 2)
        pair.margin = margin
        real, dealt = pair.deal, []
        pair.deal = lambda *a, real=real, dealt=dealt: dealt.append(1) or real(*a)
        low, high = reg._extent(pair.level.fixed)
        found.append(pair.fitted(Lattice(np.zeros((5, 7, 2)), low, high), 12, 0.3, 0.5)[0].values)
        deals.append(len(dealt))
    assert deals[0] > 2 and deals[1] == 1 and np.allclose(*found, atol=1e-6)


def test_blocks_fitted_by_themselves_agree_with_the_whole(spark):
    fixed = smooth((44, 46), 11)
    moving, _ = twisted(fixed, 0.25, 12.0)
    one, other = as_grid(spark, fixed), as_grid(spark, moving)
    fit = Fit(steps=(60,), spacing=5.0, smooth=0.3, block=24)
    whole = reg.register([one], [other], fit=fit, levels=[0])
    begun = reg.register([one], [other], fit=Fit(steps=(0,)))
    rows = reg.refined_field(begun, 0, fit, halo=10).toPandas()
    assert len(rows) == fixed.size and rows[["y", "x"]].drop_duplicates().shape[0] == fixed.size
    u = np.zeros((*fixed.shape, 2))
    u[rows["y"], rows["x"]] = rows[["d0", "d1"]]
    seen = reg._sampled(moving, np.clip(np.stack(np.indices(fixed.shape), -1) + u, 0, np.array(fixed.shape) - 1))[0]
    inner = (slice(5, -5),) * 2
    by_blocks, by_whole = correlation(seen[inner], fixed[inner]), correlation(dense(whole.image())[inner], fixed[inner])
    assert abs(by_blocks - by_whole) < 2e-3 and by_blocks > correlation(moving[inner], fixed[inner])


def test_levels_and_lattices():
    m = [ArrayMeta(("z", "y", "x"), s) for s in ((512, 512, 512), (256, 256, 256), (64, 64, 64), (16, 16, 16), (8, 8, 8))]
    assert reg.levels_to_fit(m) == [3, 2, 1] and reg.levels_to_fit(m[4:]) == [0]
    assert reg.control_shape((0, 0), (10, 3), (1, 1), 4.0) == (4, 2)
    a = Lattice(np.random.default_rng(0).normal(size=(3, 4, 2)), (0.0, 0.0), (2.0, 3.0))
    assert np.allclose(a.refined((5, 7)).values[::2, ::2], a.values)
    with pytest.raises(ValueError):
        reg.control_shape((0, 0, 0), (1e4, 1e4, 1e4), (1, 1, 1), 1.0)
    with pytest.raises(ValueError):
        Fit(window=(4,))
    with pytest.raises(ValueError):
        Fit(steps=(1, 2)).of(3)
