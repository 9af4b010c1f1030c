"""Stores laid out by hand, in every variant that is read, and those that are refused."""

import bz2
import gzip
import json
import lzma
import struct
import tracemalloc
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from gridloom.functions import scalar
from gridloom.meta import ArrayMeta, Box
from gridloom.sources import images, layouts, store_source, stores
from gridloom.sources.layouts import UnsupportedStore

PACK = {
    None: bytes,
    "zlib": zlib.compress,
    "gzip": gzip.compress,
    "zstd": lambda b: zstandard.ZstdCompressor().compress(b),
    "bz2": bz2.compress,
    "xz": lzma.compress,
}


def blosc(data, size, block, how, shuffle, split):
    """A Blosc container by its description."""
    code, pack = {"lz4": (1, lambda b: pa.compress(b, "lz4_raw", asbytes=True)), "zlib": (3, zlib.compress), "zstd": (4, PACK["zstd"]), "snappy": (2, lambda b: pa.compress(b, "snappy", asbytes=True))}[how]
    parts = []
    for k in range(0, len(data), block):
        raw = data[k : k + block]
        m = len(raw) // size * size
        if shuffle and size > 1:
            raw = np.frombuffer(raw[:m], np.uint8).reshape(-1, size).T.tobytes() + raw[m:]
        n = size if split and size <= 16 and block // size >= 128 and len(raw) == block else 1
        streams = [pack(raw[i * len(raw) // n : (i + 1) * len(raw) // n]) for i in range(n)]
        streams = [s if len(s) < len(raw) // n else raw[i * len(raw) // n : (i + 1) * len(raw) // n] for i, s in enumerate(streams)]
        parts.append(b"".join(struct.pack("<I", len(s)) + s for s in streams))
    head = 16 + 4 * len(parts)
    starts = [head + sum(map(len, parts[:i])) for i in range(len(parts))]
    body = struct.pack(f"<{len(parts)}I", *starts) + b"".join(parts)
    return struct.pack("<BBBBIII", 2, 1, shuffle | 16 * (not split) | code << 5, size, len(data), block, 16 + len(body)) + body


def put(path, files):
    for name, data in files.items():
        p = path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())
    return f"file://{path}"


def chunks_of(a, chunk, skip=()):
    """(index, whole chunk, padded with 77) of an array."""
    for index in product(*(range(-(-n // c)) for n, c in zip(a.shape, chunk, strict=True))):
        if index not in skip:
            whole = np.full(chunk, 77, a.dtype)
            part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunk, strict=True))]
            whole[tuple(map(slice, part.shape))] = part
            yield index, whole


def cube(dtype, shape=(5, 9, 11)):
    a = np.random.default_rng(5).normal(size=shape) * 40
    return (a > 0) if dtype == "bool" else np.abs(a).astype(dtype) if dtype.startswith("u") else a.astype(dtype)


def same(grid, want):
    got = grid.df.toPandas()
    assert len(got) == want.size and grid.meta.shape == want.shape
    out = np.full(want.shape, np.nan)
    out[tuple(got[a] for a in grid.axes)] = got["v"]
    np.testing.assert_array_equal(out, want.astype(float))


@pytest.mark.parametrize(
    ("dtype", "order", "separator", "how"),
    [("<i4", "C", ".", None), (">f8", "F", ".", "zlib"), ("|u1", "F", "/", "gzip"), (">i2", "C", None, "zstd"), ("<f4", "C", "/", "bz2"), ("|b1", "F", None, "xz"), ("<u8", "C", ".", None), ("<f2", "C", ".", None)],
)
def test_zarr2(spark, tmp_path, dtype, order, separator, how):
    a = cube(np.dtype(dtype).name)
    fill = 1 if a.dtype.kind in "bu" else -9
    skip = {(0, 0, 0), (2, 1, 2)}
    files = {".zarray": {"zarr_format": 2, "shape": a.shape, "chunks": (2, 5, 4), "dtype": dtype, "order": order, "fill_value": fill, "filters": None, "compressor": how and {"id": {"xz": "lzma"}.get(how, how)}} | ({"dimension_separator": separator} if separator else {})}
    for index, whole in chunks_of(a, (2, 5, 4), skip):
        files[(separator or ".").join(map(str, index))] = PACK[how](whole.astype(dtype).tobytes(order))
    want = a.copy()
    for index in skip:
        want[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, (2, 5, 4), strict=True))] = fill
    path = put(tmp_path, files)
    g = stores.read(spark, path)
    assert g.meta.dtype == np.dtype(dtype).name
    same(g, want)
    part = stores.read(spark, path, Box((1, 3, 2), (4, 9, 7))).df.toPandas()
    assert len(part) == 3 * 6 * 5 and np.array_equal(part["v"], want[part["z"], part["y"], part["x"]].astype(float))


@pytest.mark.parametrize(("how", "shuffle", "split", "dtype"), [("lz4", 1, True, "<i4"), ("zstd", 1, False, "<f8"), ("zlib", 0, True, "|u1"), ("snappy", 1, True, ">i2")])
def test_zarr2_blosc(spark, tmp_path, how, shuffle, split, dtype):
    a = cube(np.dtype(dtype).name, (9, 40, 30))
    files = {".zarray": {"zarr_format": 2, "shape": a.shape, "chunks": (4, 40, 16), "dtype": dtype, "order": "C", "fill_value": None, "filters": [], "compressor": {"id": "blosc", "cname": how}}}
    for index, whole in chunks_of(a, (4, 40, 16)):
        files[".".join(map(str, index))] = blosc(whole.astype(dtype).tobytes(), np.dtype(dtype).itemsize, 3000 // 8 * 8, how, shuffle, split)
    same(stores.read(spark, put(tmp_path, files)), a)


def test_blosc_of_itself_and_what_is_refused():
    raw = bytes(range(200))
    assert layouts.unblosc(struct.pack("<BBBBIII", 2, 1, 2, 1, 200, 200, 216) + raw) == raw
    for flags in (4 | 1 << 5, 0):
        with pytest.raises(UnsupportedStore):
            layouts.unblosc(struct.pack("<BBBBIII", 2, 1, flags, 1, 200, 200, 216) + raw)


@pytest.mark.parametrize(
    ("dtype", "endian", "keys", "turned", "codecs", "fill", "filled"),
    [
        ("float32", "little", None, None, ["gzip"], "NaN", np.nan),
        ("int16", "big", {"name": "default", "configuration": {"separator": "."}}, [2, 0, 1], ["zstd", "crc32c"], -9, -9),
        ("float32", "big", {"name": "v2"}, "F", [], "0x7f800000", np.inf),
        ("uint8", None, {"name": "v2", "configuration": {"separator": "/"}}, [1, 2, 0], ["crc32c"], 200, 200),
    ],
)
def test_zarr3(spark, tmp_path, dtype, endian, keys, turned, codecs, fill, filled):
    a, chunk = cube(dtype), (3, 4, 5)
    chain = [{"name": "transpose", "configuration": {"order": turned}}] * bool(turned) + [{"name": "bytes", "configuration": {"endian": endian} if endian else {}}] + [{"name": c} for c in codecs]
    about = {"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "fill_value": fill, "codecs": chain, "attributes": {}}
    files = {"zarr.json": about | ({"chunk_key_encoding": keys} if keys else {})}
    plain = (keys or {}).get("name") == "v2"
    separator = (keys or {}).get("configuration", {}).get("separator", "." if plain else "/")
    order = {"F": [2, 1, 0], None: [0, 1, 2]}.get(turned, turned) if not isinstance(turned, list) else turned
    for index, whole in chunks_of(a, chunk, {(1, 1, 1)}):
        data = whole.transpose(order).astype(np.dtype(dtype).newbyteorder(">" if endian == "big" else "<")).tobytes()
        for c in codecs:
            data = data + struct.pack("<I", layouts.crc32c(data)) if c == "crc32c" else PACK[c](data)
        files[separator.join(["c"] * (not plain) + list(map(str, index)))] = data
    want = a.astype(float)
    want[3:6, 4:8, 5:10] = filled
    same(stores.read(spark, put(tmp_path, files)), want)


def test_checksums():
    assert layouts.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(ValueError):
        layouts.decompress(b"123456789" + b"\0" * 4, "crc32c")


@pytest.mark.parametrize("at", ["end", "start"])
def test_zarr3_shards(spark, tmp_path, at):
    a, inner, shard = cube("int32", (13, 17, 9)), (2, 4, 3), (8, 8, 6)
    per = tuple(s // i for s, i in zip(shard, inner, strict=True))
    conf = {"chunk_shape": inner, "codecs": [{"name": "transpose", "configuration": {"order": [2, 1, 0]}}, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}], "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": at}
    files = {"zarr.json": {"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shard}}, "chunk_key_encoding": {"name": "default"}, "fill_value": 4, "codecs": [{"name": "sharding_indexed", "configuration": conf}]}}
    gone = {(1, 1, 1), (0, 0, 2)}
    shards: dict = {}
    for index, whole in chunks_of(a, inner, gone):
        outer = tuple(i // p for i, p in zip(index, per, strict=True))
        within = tuple(i % p for i, p in zip(index, per, strict=True))
        shards.setdefault(outer, {})[within] = PACK["zstd"](whole.transpose(2, 1, 0).tobytes())
    del shards[1, 2, 1]
    for outer, held in shards.items():
        index, body = np.full((*per, 2), 2**64 - 1, np.uint64), b""
        size = 16 * int(np.prod(per)) + 4
        for within, data in held.items():
            index[within] = (len(body) + size * (at == "start"), len(data))
            body += data
        raw = index.astype("<u8").tobytes()
        raw += struct.pack("<I", layouts.crc32c(raw))
        files["c/" + "/".join(map(str, outer))] = body + raw if at == "end" else raw + body
    want = a.copy()
    for i in gone:
        want[tuple(slice(k * c, (k + 1) * c) for k, c in zip(i, inner, strict=True))] = 4
    want[8:16, 16:24, 6:12] = 4
    path = put(tmp_path, files)
    same(stores.read(spark, path), want)
    box = Box((3, 2, 2), (9, 17, 8))
    part = stores.read(spark, path, box).df.toPandas()
    assert len(part) == 6 * 15 * 6 and np.array_equal(part["v"], want[part["z"], part["y"], part["x"]])
    places = stores.chunk_places(spark, path).toPandas()
    assert len(places) == 7 * 5 * 3 and places["start"].isna().sum() == 2 + 3 * 1 * 1
    got = {(r.chunk_z, r.chunk_y, r.chunk_x): r.length for r in places.itertuples() if r.length == r.length}
    assert got[0, 0, 0] == len(shards[0, 0, 0][0, 0, 0])
    sizes = stores.chunk_sizes(spark, path)
    assert sizes.meta.shape == (7, 5, 3) and sizes.df.where("v = 0").count() == 5


def test_only_wanted_bytes_are_read(tmp_path):
    """A box in one chunk of a shard: the index and that chunk."""
    shard = layouts.ZarrShard((4, 4), ("crc32c",))
    data = [bytes([i]) * 100 for i in range(16)]
    index = np.array([(100 * i, 100) for i in range(16)], "<u8").tobytes()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "0").mkdir()
    (tmp_path / "c" / "0" / "0").write_bytes(b"".join(data) + index + struct.pack("<I", layouts.crc32c(index)))

    class Counted:
        def __init__(self, path):
            self.raw, self.read = path.read_bytes(), []

        def size(self):
            return len(self.raw)

        def read_at(self, n, at):
            self.read.append(n)
            return self.raw[at : at + n]

    file = Counted(tmp_path / "c" / "0" / "0")
    layout = layouts.Layout(ArrayMeta(("y", "x"), (40, 40), "uint8", (10, 10)), "zarr3", "|u1", prefix="c", shard=shard)
    start, n = layout.place(file, (2, 3), held := {})
    assert layout.block(file.read_at(n, start), (2, 3)).tolist() == [[11] * 10] * 10
    layout.place(file, (1, 1), held)
    assert file.read == [16 * 16 + 4, 100]


@pytest.mark.parametrize(("how", "mode"), [("raw", 0), ("gzip", 0), ("bzip2", 1), ("xz", 0)])
def test_n5(spark, tmp_path, how, mode):
    a, block = cube("uint16"), (2, 4, 5)
    files = {"attributes.json": {"dimensions": a.shape[::-1], "blockSize": block[::-1], "dataType": "uint16", "compression": {"type": how}}}
    pack = PACK[{"raw": None, "bzip2": "bz2"}.get(how, how)]
    for index, whole in chunks_of(a, block, {(1, 1, 1)}):
        if mode == 0:  # blocks at the edges may be short
            whole = whole[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(index, block, a.shape, strict=True))]
        head = struct.pack(f">HH3I{'I' * mode}", mode, 3, *whole.shape[::-1], *[whole.size] * mode)
        files["/".join(map(str, index[::-1]))] = head + pack(whole.astype(">u2").tobytes())
    want = a.copy()
    want[2:4, 4:8, 5:10] = 0
    same(stores.read(spark, put(tmp_path, files)), want)


def test_precomputed_scales_offsets_and_channels(spark, tmp_path):
    fine, coarse = cube("uint8", (2, 6, 8, 10)), cube("uint8", (2, 3, 4, 5))
    scales, files = [], {}
    for name, a, offset, voxel in (("a", fine, (7, 3, 100), (4, 4, 40)), ("b", coarse, (3, 1, 50), (8, 8, 80))):
        scales.append({"key": name, "size": a.shape[:0:-1], "resolution": voxel, "voxel_offset": offset, "chunk_sizes": [[4, 3, 2]], "encoding": "raw"})
        for index, _ in chunks_of(a[0], (2, 3, 4)):
            box = Box.of_chunk(index, (2, 3, 4), a.shape[1:])
            key = "_".join(f"{s + o}-{e + o}" for s, e, o in zip(box.start[::-1], box.stop[::-1], offset, strict=True))
            files[f"{name}/{key}"] = a[(slice(None), *(slice(s, e) for s, e in zip(box.start, box.stop, strict=True)))].tobytes()
    files["info"] = {"data_type": "uint8", "num_channels": 2, "scales": scales}
    path = put(tmp_path, files)
    levels = images.open_levels(spark, path)
    assert [g.meta.voxel_size for g in levels] == [(1, 40, 4, 4), (1, 80, 8, 8)] and levels[0].meta.translation == (0, 100.5 * 40, 3.5 * 4, 7.5 * 4)
    for g, a in zip(levels, (fine, coarse), strict=True):
        assert g.axes == ("c", "z", "y", "x")
        same(g, a)


@pytest.mark.parametrize(("how", "packed"), [("identity", "raw"), ("murmurhash3_x86_128", "gzip")])
def test_precomputed_shards(spark, tmp_path, how, packed):
    a, chunk = cube("uint32", (9, 20, 13)), (2, 3, 4)
    grid = tuple(-(-n // c) for n, c in zip(a.shape, chunk, strict=True))
    sharding = {"@type": "neuroglancer_uint64_sharded_v1", "preshift_bits": 1, "hash": how, "minishard_bits": 2, "shard_bits": 3, "minishard_index_encoding": packed, "data_encoding": packed}
    files = {"info": {"data_type": "uint32", "num_channels": 1, "scales": [{"key": "k", "size": a.shape[::-1], "resolution": [1, 1, 1], "chunk_sizes": [chunk[::-1]], "encoding": "raw", "sharding": sharding}]}}
    pack = gzip.compress if packed == "gzip" else bytes
    numbers: dict = {}
    for index in product(*map(range, grid)):
        if index == (1, 1, 1):
            continue
        code = bit = 0  # the bits of x, y, z in turn, as long as an axis needs them
        for k in range(8):
            for i, n in zip(index[::-1], grid[::-1], strict=True):
                if 2**k < n:
                    code |= (i >> k & 1) << bit
                    bit += 1
        h = code >> 1
        h = murmur(struct.pack("<Q", h), 0)[0] if how != "identity" else h
        box = Box.of_chunk(index, chunk, a.shape)
        data = pack(a[tuple(slice(s, e) for s, e in zip(box.start, box.stop, strict=True))].tobytes())
        numbers.setdefault(h >> 2 & 7, {}).setdefault(h & 3, []).append((code, data))
    for shard, minishards in numbers.items():
        body, table = b"", [(0, 0)] * 4
        for m, held in minishards.items():
            held.sort()
            starts = []
            for _, data in held:
                starts.append(len(body))
                body += data
            ids = np.diff([0] + [c for c, _ in held])
            gaps = [starts[0]] + [0] * (len(held) - 1)
            index = pack(np.array([ids, gaps, [len(d) for _, d in held]], "<u8").tobytes())
            table[m] = (len(body), len(body) + len(index))
            body += index
        files[f"k/{shard:x}.shard"] = struct.pack("<8Q", *sum(table, ())) + body
    want = a.copy()
    want[2:4, 3:6, 4:8] = 0
    path = put(tmp_path, files)
    same(stores.read(spark, path), want)
    part = stores.read(spark, path, Box((1, 4, 3), (7, 9, 13))).df.toPandas()
    assert len(part) == 6 * 5 * 10 and np.array_equal(part["v"], want[part["z"], part["y"], part["x"]])
    assert stores.chunk_places(spark, path).where("start is null").count() == 1


def murmur(data, seed):
    """MurmurHash3 of any bytes (x86, 128 bits) as two 64-bit halves, by its public description."""
    full, c = 0xFFFFFFFF, (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
    rot = lambda x, r: (x << r | x >> 32 - r) & full
    h = [seed] * 4

    def key(i, k):
        return rot(k * c[i] & full, 15 + i) * c[(i + 1) % 4] & full

    def fmix(x):
        x = (x ^ x >> 16) * 0x85EBCA6B & full
        x = (x ^ x >> 13) * 0xC2B2AE35 & full
        return x ^ x >> 16

    n = len(data) // 16 * 16
    for at in range(0, n, 16):
        for i, (k, turn, plus) in enumerate(zip(struct.unpack_from("<4I", data, at), (19, 17, 15, 13), (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17), strict=True)):
            h[i] = ((rot(h[i] ^ key(i, k), turn) + h[(i + 1) % 4]) * 5 + plus) & full
    tail = data[n:] + b"\0" * (16 - len(data) + n)
    for i, k in enumerate(struct.unpack("<4I", tail[:16])):
        if len(data) - n > 4 * i:
            h[i] ^= key(i, k)
    h = [x ^ len(data) for x in h]
    for step in range(2):
        h[0] = sum(h) & full
        h[1:] = [(x + h[0]) & full for x in h[1:]]
        h = list(map(fmix, h)) if step == 0 else h
    return h[0] | h[1] << 32, h[2] | h[3] << 32


def test_murmur():
    """The long form by its published check value, the short one by the long one."""
    every = b"".join(struct.pack("<QQ", *murmur(bytes(range(i)), 256 - i)) for i in range(256))
    assert murmur(every, 0)[0] & 0xFFFFFFFF == 0xB3ECE62A
    for x in (0, 1, 12345, 2**40 + 3, 2**64 - 1):
        assert layouts.murmur_128_low(x) == murmur(struct.pack("<Q", x), 0)[0]


def test_morton_is_the_columns(spark):
    from pyspark.sql import functions as F

    grid = (5, 9, 2)
    df = spark.createDataFrame([p for p in product(*map(range, grid))], "x long, y long, z long")
    got = df.select("x", "y", "z", scalar.compressed_morton([F.col(a) for a in "zyx"], grid[::-1]).alias("m")).collect()
    assert all(r["m"] == layouts.morton((r["x"], r["y"], r["z"]), grid) for r in got)


ZARR2 = {"zarr_format": 2, "shape": [4], "chunks": [2], "dtype": "<f8", "order": "C", "fill_value": 0, "filters": None, "compressor": None}
ZARR3 = {"zarr_format": 3, "node_type": "array", "shape": [4], "data_type": "uint8", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2]}}, "fill_value": 0, "codecs": [{"name": "bytes"}]}
N5 = {"dimensions": [4], "blockSize": [2], "dataType": "uint8", "compression": {"type": "raw"}}
INFO = {"data_type": "uint8", "num_channels": 1, "scales": [{"key": "k", "size": [4, 4, 4], "resolution": [1, 1, 1], "chunk_sizes": [[2, 2, 2]], "encoding": "raw"}]}
SHARDED = {"name": "sharding_indexed", "configuration": {"chunk_shape": [1], "codecs": [{"name": "bytes"}]}}


@pytest.mark.parametrize(
    ("name", "content"),
    [
        (".zarray", ZARR2 | {"filters": [{"id": "delta"}]}),
        (".zarray", ZARR2 | {"dtype": [["a", "<f4"]]}),
        (".zarray", ZARR2 | {"dtype": "|S4"}),
        (".zarray", ZARR2 | {"dtype": "<c8"}),
        (".zarray", ZARR2 | {"compressor": {"id": "lz77"}}),
        (".zarray", ZARR2 | {"fill_value": "AAAA"}),
        ("zarr.json", ZARR3 | {"data_type": "complex64"}),
        ("zarr.json", ZARR3 | {"data_type": {"name": "numpy.datetime64"}}),
        ("zarr.json", ZARR3 | {"chunk_grid": {"name": "rectangular"}}),
        ("zarr.json", ZARR3 | {"codecs": [{"name": "zstd"}, {"name": "bytes"}]}),
        ("zarr.json", ZARR3 | {"codecs": [{"name": "vlen-utf8"}]}),
        ("zarr.json", ZARR3 | {"codecs": [SHARDED, {"name": "gzip"}]}),
        ("zarr.json", ZARR3 | {"chunk_key_encoding": {"name": "odd"}}),
        ("zarr.json", ZARR3 | {"fill_value": [0, 0]}),
        ("attributes.json", N5 | {"compression": {"type": "jpeg"}}),
        ("attributes.json", N5 | {"dataType": "object"}),
        ("info", INFO | {"scales": [INFO["scales"][0] | {"encoding": "jpeg"}]}),
        ("info", INFO | {"scales": [INFO["scales"][0] | {"encoding": "compressed_segmentation"}]}),
        ("info", INFO | {"scales": [INFO["scales"][0] | {"sharding": {"@type": "other"}}]}),
    ],
)
def test_what_is_not_understood_is_refused(spark, tmp_path, name, content):
    with pytest.raises(UnsupportedStore):
        stores.read(spark, put(tmp_path, {name: content}))


def test_damaged_chunks_raise(spark, tmp_path):
    path = put(tmp_path, {".zarray": ZARR2, "0": b"\0" * 15, "1": b"\0" * 16})
    with pytest.raises(Exception, match="chunk"):
        stores.read(spark, path).df.collect()


def test_no_store(spark, tmp_path):
    with pytest.raises(ValueError, match="no array store"):
        stores.read(spark, f"file://{tmp_path}")


def test_wide_numbers_stay_whole(spark, tmp_path):
    a = np.array([2**53 + 1, -5, 2**62 + 3, 0])
    path = put(tmp_path, {".zarray": ZARR2 | {"dtype": "<i8", "chunks": [4]}, "0": a.astype("<i8").tobytes()})
    assert [r["v"] for r in stores.read(spark, path).df.orderBy("x").collect()] == a.tolist()


def test_ten_million_chunks_are_planned_in_little_memory():
    meta = ArrayMeta(("z", "y", "x"), (64 * 1000, 64 * 100, 64 * 100), "uint8", (64, 64, 64))
    layout = layouts.Layout(meta, "zarr3", "|u1", prefix="c")
    tracemalloc.start()
    reader = store_source.StoreReader(layout, "file:///nowhere", meta.box, False)
    parts = reader.partitions()
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts[0].start == 0 and parts[-1].stop == 10_000_000 and all(a.stop == b.start for a, b in zip(parts, parts[1:], strict=False))
    assert len(parts) <= store_source.PARTITIONS and used < 16 << 20


def test_comparisons_narrow_what_is_read(spark, tmp_path):
    """Chunks outside the box that comparisons leave are damaged here, and not read."""
    a = np.arange(64.0).reshape(8, 8)
    files = {".zarray": ZARR2 | {"shape": [8, 8], "chunks": [2, 2]}}
    for (i, j), whole in chunks_of(a, (2, 2)):
        files[f"{i}.{j}"] = whole.astype("<f8").tobytes() if i == 1 and j in (2, 3) else b"damaged"
    g = stores.read(spark, put(tmp_path, files))
    got = g.df.where("y >= 2 and y < 4 and x > 3 and v > 20").collect()
    assert sorted(r["v"] for r in got) == [v for v in a[2:4, 4:].ravel().tolist() if v > 20]
    assert [r["v"] for r in g.df.where("y = 3 and x <= 5 and x >= 4").orderBy("x").collect()] == [28, 29]
    assert g.read(Box((2, 5), (4, 6))).df.count() == 2
    stores.register(spark)
    spark.sql("DROP VIEW IF EXISTS stored")
    spark.sql(f"CREATE TEMPORARY VIEW stored USING gridloom_store OPTIONS (path 'file://{tmp_path}')")
    assert spark.sql("SELECT sum(v) FROM stored WHERE y = 2 AND x BETWEEN 6 AND 7").first()[0] == a[2, 6:8].sum()
