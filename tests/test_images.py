"""Pyramids, fields, scenes, off-grid stacks, projects' tiles and surfaces, against small cases worked out by hand or by numpy."""

import struct
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.geometry.resample import at_voxel_size
from gridloom.geometry.transforms import UnsupportedTransform, parse
from gridloom.grid import Grid
from gridloom.meta import ArrayMeta, Box
from gridloom.operators import axes, meshes, stitching
from gridloom.operators.aggregate import pyramid
from gridloom.sources import images, stores


def as_grid(spark, array, **meta):
    names = meta.pop("axes", "zyx"[-array.ndim :])
    at = np.indices(array.shape).reshape(array.ndim, -1)
    df = spark.createDataFrame(pd.DataFrame({a: at[i] for i, a in enumerate(names)} | {"v": array.ravel()}))
    return Grid(df, ArrayMeta(tuple(names), array.shape, **{"dtype": str(array.dtype)} | meta))


def as_array(grid):
    out = np.full(grid.meta.shape, np.nan)
    for *at, v in grid.df.select(*grid.axes, "v").collect():
        out[tuple(at)] = v
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(4).normal(size=(9, 12))


def placed(names, scale, translation):
    return {"axes": [{"name": a, "type": "space", "unit": "nm"} for a in names], "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": scale}, {"type": "translation", "translation": translation}]}]}


@pytest.mark.parametrize("form", ["zarr2", "zarr3", "n5"])
def test_pyramids_come_back(spark, tmp_path, noise, form):
    levels = pyramid(as_grid(spark, noise, chunk=(4, 5), voxel_size=(2.0, 3.0), units=("um", "um")), 3)
    done = images.write_levels(levels, f"file://{tmp_path}/p", form, "gzip")
    assert [r.level for r in done.orderBy("level").collect()] == [0, 1, 2]
    back = images.open_levels(spark, f"file://{tmp_path}/p")
    for a, b in zip(levels, back, strict=True):
        assert (a.meta.shape, a.meta.voxel_size, a.meta.translation, a.meta.units) == (b.meta.shape, b.meta.voxel_size, b.meta.translation, b.meta.units)
        assert np.allclose(as_array(a), as_array(b))


def test_levels_by_number_and_alone(spark, tmp_path, noise):
    g = as_grid(spark, noise, chunk=(4, 5))
    for name in ("s0", "s1"):
        stores.write(g, f"file://{tmp_path}/p/{name}")
    assert len(images.open_levels(spark, f"file://{tmp_path}/p")) == 2
    assert len(images.open_levels(spark, f"file://{tmp_path}/p/s1")) == 1


def test_stack_off_grid(spark, noise):
    fine, coarse = as_grid(spark, noise), pyramid(as_grid(spark, noise), 2)[1]
    got = as_array(axes.stack_onto([coarse, fine]))
    assert np.allclose(got[0], as_array(coarse))
    # the middle of a coarse voxel is where four fine ones meet
    assert np.allclose(got[1][:4], noise[:8].reshape(4, 2, 6, 2).mean(axis=(1, 3)))
    far = Grid(fine.df, replace(fine.meta, translation=(1000.0, 0.5)))
    assert (as_array(axes.stack_onto([fine, far]))[1] == 0).all()
    labels = as_grid(spark, np.arange(12).reshape(3, 4), kind="label")
    assert set(as_array(axes.stack_onto([fine, labels]))[1].ravel()) <= set(range(12))


def test_other_voxel_sizes(spark, noise):
    g = as_grid(spark, noise)
    assert np.allclose(as_array(at_voxel_size(g, (3.0, 4.0))), noise.reshape(3, 3, 3, 4).mean(axis=(1, 3)))
    x = (np.arange(24) + 0.5) / 2 - 0.5
    assert np.allclose(as_array(at_voxel_size(g, (0.5,))), [np.interp(x, np.arange(12), line) for line in noise])
    assert at_voxel_size(g, (1.0, 1.0)).df is g.df


def test_coordinates_place_an_array(spark, noise):
    table = lambda values: spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    got = images.place_by_coordinates(as_grid(spark, noise), {"y": table(10 + 0.25 * np.arange(9)), "x": table([0, 1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 14])})
    assert got.meta.voxel_size == (0.25, 1.0) and got.meta.translation == (10.0, 0.5)
    for bad in (-np.arange(9), np.arange(8), np.zeros(9)):
        assert images.place_by_coordinates(as_grid(spark, noise), {"y": table(bad)}).meta.voxel_size == (1.0, 1.0)


def test_fields_and_scenes(spark, tmp_path, noise):
    root = f"file://{tmp_path}/scene"
    scale, shift = [1.0, 1.0], [0.5, 0.5]
    for name in ("a", "b"):
        stores.write(as_grid(spark, noise, chunk=(4, 5)), f"{root}/{name}/s0")
        ms = placed("yx", scale, shift)
        ms["datasets"][0]["coordinateTransformations"] = [{"type": "sequence", "output": "world", "transformations": ms["datasets"][0]["coordinateTransformations"]}]
        ms["coordinateSystems"] = [{"name": "world", "axes": ms["axes"]}]
        stores.put_json(f"{root}/{name}", {".zgroup": {"zarr_format": 2}, ".zattrs": {"multiscales": [ms]}})
    # displacements of (0, 2) on a lattice of steps of 4, the vectors' axis first
    field = np.zeros((2, 4, 4))
    field[1] = 2.0
    stores.write(as_grid(spark, field, axes=("c", "y", "x")), f"{root}/d")
    attrs = {"axes": [{"name": "c", "type": "displacement"}, {"name": "y"}, {"name": "x"}], "coordinateTransformations": [{"type": "scale", "scale": [1.0, 4.0, 4.0]}]}
    stores.put_json(f"{root}/d", {".zattrs": attrs})
    moved = {"type": "displacements", "path": "d", "input": {"path": "b", "name": "world"}, "output": {"path": "a", "name": "world"}}
    stores.put_json(root, {".zgroup": {"zarr_format": 2}, ".zattrs": {"ome": {"scene": {"coordinateTransformations": [moved]}}}})

    points = spark.createDataFrame([(1.5, 2.0), (9.0, 3.25)], "p0 double, p1 double")
    f = images.open_field(spark, f"{root}/d")
    assert f.shape == (4, 4) and not f.absolute
    assert sorted(map(tuple, f.apply(points).select("p0", "p1").collect())) == [(1.5, 4.0), (9.0, 5.25)]

    (got,) = images.open_scene(spark, root, "a", "b#world")
    want = np.zeros_like(noise)
    want[:, :-2] = noise[:, 2:]
    assert np.allclose(as_array(got), want)
    with pytest.raises(ValueError, match="no lost#world"):
        images.open_scene(spark, root, "a", "lost#world", onto=got.meta)


def test_projections_and_stored_numbers(spark):
    t = parse({"type": "projectAxis", "droppedInputs": [0], "createdOutputs": [1]}, n=3)
    assert t.matrix == ((0, 1, 0), (0, 0, 0), (0, 0, 1))
    assert parse({"type": "projectAxis", "droppedInputs": [2]}, n_out=2).n_in == 3
    got = parse({"type": "affine", "path": "m"}, opened=lambda kind, path, spec: [[1, 0, 5], [0, 1, 6]])
    assert got.offset == (5, 6)
    with pytest.raises(UnsupportedTransform):
        parse({"type": "displacements", "path": "d"})
    with pytest.raises(ValueError):
        parse({"type": "projectAxis"})


def ball(n=9, r=3.2):
    d = np.indices((n, n, n)) - (n - 1) / 2
    return ((d**2).sum(axis=0) <= r * r).astype("int64")


def enclosed(solid):
    """The volume inside, tetrahedron by tetrahedron: of each a share by how many of its corners are set."""
    wide, share = np.pad(solid, 1), (0, 1 / 8, 1 / 2, 7 / 8, 1)
    cells = [wide[z : z + wide.shape[0] - 1, y : y + wide.shape[1] - 1, x : x + wide.shape[2] - 1] for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    return sum(np.take(share, cells[0] + cells[a] + cells[b] + cells[7]).sum() / 6 for a, b in ((4, 6), (4, 5), (2, 6), (2, 3), (1, 5), (1, 3)))


def edges(triangles):
    return Counter((t[i], t[(i + 1) % 3]) for t in triangles for i in range(3))


@pytest.mark.parametrize("solid", [ball(), np.ones((2, 3, 4), "int64"), np.random.default_rng(2).integers(0, 2, (6, 5, 7))])
def test_surfaces_are_closed(spark, solid):
    rows = meshes.surface(as_grid(spark, solid, kind="mask")).collect()
    triangles = [tuple(tuple(r[k]) for k in "pqr") for r in rows]
    count = edges(triangles)
    assert all(count[b, a] == n for (a, b), n in count.items())  # every edge is gone along as often one way as the other
    p, q, r = (np.array([t[i] for t in triangles]) for i in range(3))
    volume = np.einsum("ij,ij->i", p, np.cross(q, r)).sum() / 6
    assert volume == pytest.approx(enclosed(solid))
    if len(solid) == 9:
        points, faces = {c for t in triangles for c in t}, len(triangles)
        assert len(points) - sum(count.values()) // 2 + faces == 2


def test_no_surface_without_voxels(spark):
    assert meshes.surface(as_grid(spark, np.zeros((3, 3, 3), "int64"))).count() == 0


def test_fragments_hold_the_surface(spark):
    g = as_grid(spark, ball(), chunk=(5, 5, 9), voxel_size=(2.0, 1.0, 1.0), translation=(1.0, 0.0, 0.0), kind="mask")
    whole = {frozenset(tuple(np.float32([p[2], p[1], p[0] * 2 + 1]).tolist()) for p in (r.p, r.q, r.r)) for r in meshes.surface(g).collect()}
    got = []
    for r in meshes.fragments(g).collect():
        (n,) = struct.unpack("<I", r.data[:4])
        points = np.frombuffer(r.data[4 : 4 + 12 * n], "<f4").reshape(-1, 3)
        faces = np.frombuffer(r.data[4 + 12 * n :], "<u4").reshape(-1, 3)
        assert (n, len(faces)) == (r.vertices, r.triangles)
        got += [frozenset(tuple(points[i].tolist()) for i in f) for f in faces]
    assert len(got) == len(set(got)) and set(got) == whole


def test_quantized_corners_come_back(spark):
    tri = meshes.surface(as_grid(spark, ball(), kind="mask"))
    top = 65535
    for r in meshes.quantized(tri, ("z", "y", "x"), 4).join(tri.withColumnsRenamed({k: f"{k}0" for k in "pqr"}), ["z", "y", "x", "part"]).collect():
        for k in "pqr":
            assert all(0 <= v <= top for v in r[k])
            assert np.allclose([v / top * 4 + n * 4 - 1 for v, n in zip(r[k], (r.node_z, r.node_y, r.node_x), strict=True)], r[f"{k}0"], atol=1e-3)


def test_mesh_level():
    m = lambda n: ArrayMeta(("z", "y", "x"), (n, n, 4))
    assert meshes.mesh_level([m(2000), m(500), m(100)]) == 1 and meshes.mesh_level([m(2000), m(1000)]) == 1


def test_fusing_a_box_is_a_part_of_the_whole(spark, noise):
    g = as_grid(spark, noise)
    tiles = [(g, (0, 0)), (g, (0, 8)), (g, (100, 0))]
    whole = {(r.y, r.x): r.v for r in stitching.fuse(tiles).collect()}
    part = {(r.y, r.x): r.v for r in stitching.fuse(tiles, box=Box((2, 6), (7, 15))).collect()}
    assert part == pytest.approx({k: v for k, v in whole.items() if 2 <= k[0] < 7 and 6 <= k[1] < 15})
    assert stitching.fuse(tiles, box=Box((50, 0), (60, 9))).count() == 0


def test_tiles_of_a_project():
    view = lambda s, extra: f"<ViewRegistration timepoint='0' setup='{s}'>{extra}<ViewTransform type='affine'><Name>Stage</Name><affine>1 0 0 {s}0 0 1 0 7 0 0 1 0</affine></ViewTransform><ViewTransform type='affine'><Name>calibration</Name><affine>2 0 0 0 0 2 0 0 0 0 6 0</affine></ViewTransform></ViewRegistration>"
    setup = lambda s, c: f"<ViewSetup><id>{s}</id><name>tile {s}</name><size>30 20 10</size><voxelSize><unit>um</unit><size>0.5 0.5 1.5</size></voxelSize><attributes><channel>{c}</channel></attributes></ViewSetup>"
    stitched = "<ViewTransform type='affine'><Name>Stitching Transform</Name><affine>1 0 0 99 0 1 0 99 0 0 1 99</affine></ViewTransform>"
    xml = f"<SpimData>{setup(1, 0)}{setup(2, 0)}{setup(3, 1)}{view(1, stitched)}{view(2, '')}{view(3, '')}</SpimData>"
    a, b = stitching.tiles_of_project(xml)
    assert (a.setup, a.shape, a.voxel_size, b.name) == (1, (10, 20, 30), (1.5, 0.5, 0.5), "tile 2")
    assert np.diag(a.stage.matrix).tolist() == [6, 2, 2] and a.stage.offset == (0, 7, 10) and b.stage.offset == (0, 7, 20)
    assert [t.setup for t in stitching.tiles_of_project(xml, channel=1)] == [3]
