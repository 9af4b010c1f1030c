"""How stored arrays lie in files: Zarr v2 and v3, N5 and precomputed, as their metadata says, or a refusal.

A ``Layout`` tells a chunk's file, its place in it if many chunks share one, and its voxels from its bytes. What is not understood raises
``UnsupportedStore``, since a chunk read by the wrong rule looks like any other.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import math
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

from ..meta import ArrayMeta, Box, kind_of_stored

FORMATS = ("zarr2", "zarr3", "n5", "precomputed")
#: Types of the precomputed format.
PRECOMPUTED_TYPES = ("uint8", "uint16", "uint32", "uint64", "float32")
#: Types that a voxel can have.
VOXEL_TYPES = ("bool", "int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float16", "float32", "float64")
#: Fixed value: start and length of a chunk that a shard lacks.
ABSENT = 2**64 - 1


class UnsupportedStore(ValueError):
    """A store whose metadata asks for something that is not read here."""


# bytes ------------------------------------------------------------------------------------------------------------


def compress(data: bytes, how: str) -> bytes:
    if how == "gzip":
        return gzip.compress(data, 5, mtime=0)
    return zstandard.ZstdCompressor(3).compress(data) if how == "zstd" else data


def decompress(data: bytes, how: str) -> bytes:
    """Bytes out of one codec; ``crc32c`` checks and takes off its four bytes."""
    if how in ("gzip", "zlib"):
        return zlib.decompress(data, 47)
    if how == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if how == "bz2":
        return bz2.decompress(data)
    if how == "xz":
        return lzma.decompress(data)
    if how == "blosc":
        return unblosc(data)
    if how == "crc32c":
        if crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("a checksum differs")
        return data[:-4]
    return data


#: Codecs by the names that the formats give them.
_CODECS = {"none": None, "raw": None, "gzip": "gzip", "zlib": "zlib", "zstd": "zstd", "bz2": "bz2", "bzip2": "bz2", "xz": "xz", "lzma": "xz", "blosc": "blosc", "crc32c": "crc32c"}


def _codec(name: str) -> str | None:
    if name not in _CODECS:
        raise UnsupportedStore(f"codec {name}")
    return _CODECS[name]


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        table.append(i)
    return table


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ table[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def unblosc(data: bytes) -> bytes:
    """A Blosc (version 1) container: blocks, each of one stream or of one for each byte of a value, shuffled by bytes or not."""
    _, _, flags, size, whole, block, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 2:  # stored as it is
        return data[16 : 16 + whole]
    if flags & 4:
        raise UnsupportedStore("blosc shuffled by bits")
    inner = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if inner is None:
        raise UnsupportedStore("blosclz")

    def stream(raw: bytes, n: int) -> bytes:
        if len(raw) == n:
            return raw
        return decompress(raw, inner) if inner in ("zlib", "zstd") else pa.decompress(raw, n, inner, asbytes=True)

    starts = struct.unpack_from(f"<{-(-whole // block)}I", data, 16)
    out = []
    for k, at in enumerate(starts):
        n = min(block, whole - k * block)
        # the last, shorter block is not split, nor one whose streams would be short, or where the flag forbids it
        split = size if not flags & 16 and size <= 16 and block // size >= 128 and n == block else 1
        parts = []
        for _ in range(split):
            held = struct.unpack_from("<I", data, at)[0]
            parts.append(stream(data[at + 4 : at + 4 + held], n // split))
            at += 4 + held
        raw = b"".join(parts)
        if flags & 1 and size > 1:
            m = n // size * size
            raw = np.frombuffer(raw[:m], np.uint8).reshape(size, -1).T.tobytes() + raw[m:]
        out.append(raw)
    return b"".join(out)


# shards -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ZarrShard:
    """Chunks of a Zarr v3 shard: ``shape`` of the shard in chunks, and where its index is and how it is packed."""

    shape: tuple[int, ...]
    codecs: tuple[str, ...] = ()
    at_end: bool = True

    def index(self, file) -> np.ndarray:
        """(start, length) of all chunks in C order, by one read of the index."""
        n = math.prod(self.shape)
        size = 16 * n + 4 * ("crc32c" in self.codecs)
        raw = file.read_at(size, file.size() - size if self.at_end else 0)
        for how in reversed(self.codecs):
            raw = decompress(raw, how)
        return np.frombuffer(raw, "<u8").reshape(n, 2)

    def place(self, file, inner: tuple[int, ...], held: dict) -> tuple[int, int] | None:
        if "index" not in held:
            held["index"] = self.index(file)
        start, length = held["index"][np.ravel_multi_index(inner, self.shape)].tolist()
        return None if start == length == ABSENT else (start, length)


@dataclass(frozen=True)
class HashedShard:
    """Chunks of a precomputed shard: by the bits of a hash of the chunk's number, through an index of minishards."""

    preshift: int
    hashed: bool
    minishard_bits: int
    shard_bits: int
    index_gzip: bool
    data_gzip: bool

    def of(self, number: int) -> tuple[int, int]:
        """Shard and minishard of a chunk number."""
        h = number >> self.preshift
        h = murmur_128_low(h) if self.hashed else h
        return h >> self.minishard_bits & (1 << self.shard_bits) - 1, h & (1 << self.minishard_bits) - 1

    def minishard(self, file, which: int) -> dict[int, tuple[int, int]]:
        """(start, length) by chunk number: two reads, of the minishard's range and of its index."""
        after = 16 << self.minishard_bits
        start, stop = struct.unpack("<QQ", file.read_at(16, 16 * which))
        if start == stop:
            return {}
        raw = file.read_at(stop - start, after + start)
        ids, gaps, sizes = np.frombuffer(decompress(raw, "gzip" if self.index_gzip else "none"), "<u8").reshape(3, -1)
        begin = after + np.cumsum(gaps) + np.cumsum(sizes) - sizes
        return dict(zip(np.cumsum(ids).tolist(), zip(begin.tolist(), sizes.tolist(), strict=True), strict=True))

    def place(self, file, number: int, held: dict) -> tuple[int, int] | None:
        which = self.of(number)[1]
        if which not in held:
            held[which] = self.minishard(file, which)
        return held[which].get(number)


def morton(index: tuple[int, ...], grid: tuple[int, ...]) -> int:
    """Bits of ``index`` (x first) in turn; an axis drops out when its grid needs no more bits."""
    code = at = 0
    for bit in range(max(grid).bit_length()):
        for i, n in zip(index, grid, strict=True):
            if 1 << bit < n:
                code |= (i >> bit & 1) << at
                at += 1
    return code


def murmur_128_low(value: int) -> int:
    """The low eight bytes of MurmurHash3 (x86, 128 bits, seed 0) of a value's eight bytes."""
    full = 0xFFFFFFFF

    def turned(x: int, by: int) -> int:
        return (x << by | x >> 32 - by) & full

    def mixed(h: int) -> int:
        h = (h ^ h >> 16) * 0x85EBCA6B & full
        h = (h ^ h >> 13) * 0xC2B2AE35 & full
        return h ^ h >> 16

    low, high = value & full, value >> 32 & full
    h1 = turned(low * 0x239B961B & full, 15) * 0xAB0E9789 & full
    h2 = turned(high * 0xAB0E9789 & full, 16) * 0x38B34AE5 & full
    h = [h1 ^ 8, h2 ^ 8, 8, 8]
    h[0] = sum(h) & full
    h[1:] = [(x + h[0]) & full for x in h[1:]]
    h = [mixed(x) for x in h]
    h[0] = sum(h) & full
    return h[0] | ((h[1] + h[0]) & full) << 32


# layouts ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """A stored array. ``meta.chunk`` is what is decoded at once: in a sharded array a chunk of a shard.

    ``dtype`` has the byte order; ``order`` the axes as they are stored, slowest first; ``codecs`` what to undo, first things first.
    """

    meta: ArrayMeta
    form: str
    dtype: str
    codecs: tuple[str, ...] = ()
    fill: float = 0
    order: tuple[int, ...] = ()
    prefix: str = ""
    separator: str = "/"
    offset: tuple[int, ...] = ()
    shard: ZarrShard | HashedShard | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.meta.shape, self.meta.chunk, strict=True))

    @property
    def per_file(self) -> tuple[int, ...]:
        """Chunks on each axis that a file's box holds; one of each where they don't lie in boxes."""
        return self.shard.shape if isinstance(self.shard, ZarrShard) else (1,) * len(self.meta.shape)

    def key(self, index: tuple[int, ...]) -> str:
        """The file of a chunk, under the array's folder."""
        if self.form == "n5":
            return "/".join(map(str, index[::-1]))
        if self.form == "precomputed":
            if isinstance(self.shard, HashedShard):
                name = f"{self.shard.of(self.number(index))[0]:x}".zfill(-(-self.shard.shard_bits // 4))
                return f"{self.prefix}/{name}.shard"
            box = Box.of_chunk(index[-3:], self.meta.chunk[-3:], self.meta.shape[-3:]).moved(self.offset or (0, 0, 0))
            return f"{self.prefix}/" + "_".join(f"{a}-{b}" for a, b in zip(box.start[::-1], box.stop[::-1], strict=True))
        outer = [i // n for i, n in zip(index, self.per_file, strict=True)]
        return self.separator.join(([self.prefix] if self.prefix else []) + list(map(str, outer or [0])))

    def number(self, index: tuple[int, ...]) -> int:
        """A chunk's number in a precomputed volume that is sharded."""
        return morton(index[-3:][::-1], self.grid[-3:][::-1])

    def place(self, file, index: tuple[int, ...], held: dict) -> tuple[int, int] | None:
        """Start and length of a chunk in its open ``file``; ``held`` keeps what of the file's index was read."""
        if self.shard is None:
            return 0, file.size()
        if isinstance(self.shard, HashedShard):
            return self.shard.place(file, self.number(index), held)
        return self.shard.place(file, tuple(i % n for i, n in zip(index, self.shard.shape, strict=True)), held)

    def block(self, data: bytes | None, index: tuple[int, ...]) -> np.ndarray:
        """A chunk's voxels that lie in the array; all are ``fill`` where there are no bytes."""
        box = Box.of_chunk(index, self.meta.chunk, self.meta.shape)
        if data is None:
            return np.full(box.shape, self.fill, np.dtype(self.dtype).newbyteorder("="))
        if self.form == "n5":
            mode, n = struct.unpack_from(">HH", data)
            if mode not in (0, 1):
                raise UnsupportedStore("N5 blocks of objects")
            shape = struct.unpack_from(f">{n}I", data, 4)[::-1]
            data = data[4 + 4 * n + 4 * mode :]
        else:
            shape = box.shape if self.form == "precomputed" else self.meta.chunk
        for how in self.codecs:
            data = decompress(data, how)
        order = self.order or tuple(range(len(shape)))
        size = np.dtype(self.dtype).itemsize * math.prod(shape)
        if len(data) != size:
            raise ValueError(f"chunk {index} holds {len(data)} bytes in place of {size}")
        whole = np.frombuffer(data, self.dtype).reshape([shape[a] for a in order]).transpose(np.argsort(order))
        return whole[tuple(slice(0, n) for n in box.shape)]


def _number(value, dtype: str) -> float:
    """A fill value as formats write it: a number, a name of one that is not finite, or its bytes in hexadecimal."""
    if value is None:
        return 0
    if isinstance(value, str):
        named = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
        if value in named:
            return named[value]
        if value.startswith("0x"):
            return np.array([int(value, 16)], f"u{np.dtype(dtype).itemsize}").view(np.dtype(dtype).newbyteorder("=")).item()
        raise UnsupportedStore(f"fill value {value}")
    if isinstance(value, list | dict):
        raise UnsupportedStore(f"fill value {value}")
    return value


def _voxel_type(name: str) -> str:
    if name not in VOXEL_TYPES:
        raise UnsupportedStore(f"voxels of type {name}")
    return name


def _placed_meta(shape, chunk, dtype, placed: dict, names=None) -> ArrayMeta:
    axes = [a["name"] if isinstance(a, dict) else a for a in placed.get("axes") or ()] or names or ["t", "c", "z", "y", "x"][-len(shape) :]
    more = {k: tuple(placed[k]) for k in ("voxel_size", "units", "translation") if placed.get(k)}
    return ArrayMeta(tuple(axes), tuple(shape), dtype, tuple(chunk), kind=placed.get("kind") or kind_of_stored(dtype), **more)


def zarr2(array: dict, attributes: dict) -> Layout:
    if array.get("filters"):
        raise UnsupportedStore(f"filters {array['filters']}")
    if not isinstance(array["dtype"], str):
        raise UnsupportedStore("records in place of voxels")
    stored = np.dtype(array["dtype"])
    how = _codec((array.get("compressor") or {"id": "none"})["id"])
    axes = range(len(array["shape"]))
    order = {"C": tuple(axes), "F": tuple(axes)[::-1]}[array.get("order", "C")]
    meta = _placed_meta(array["shape"], array["chunks"], _voxel_type(stored.name), attributes, attributes.get("_ARRAY_DIMENSIONS"))
    return Layout(meta, "zarr2", stored.str, (how,) if how else (), _number(array.get("fill_value"), stored.str), order, separator=array.get("dimension_separator", "."))


def _chain(codecs: list[dict], n: int) -> tuple[str, tuple[int, ...], tuple[str, ...], dict | None]:
    """Byte order, axes as stored, bytes' codecs to undo, and the configuration of shards, of a chain of Zarr v3 codecs."""
    endian, order, undo, shards = None, tuple(range(n)), [], None
    for codec in codecs:
        name, conf = codec["name"], codec.get("configuration") or {}
        if name == "transpose" and endian is None:
            turned = {"C": list(range(n)), "F": list(range(n))[::-1]}.get(conf["order"], conf["order"]) if isinstance(conf["order"], str) else conf["order"]
            order = tuple(order[a] for a in turned)
        elif name in ("bytes", "endian"):
            endian = ">" if conf.get("endian") == "big" else "<"
        elif name == "sharding_indexed":
            endian, shards = "<", conf
        elif endian is None or _codec(name) is None:
            raise UnsupportedStore(f"codec {name} in this place")
        else:
            undo.insert(0, _codec(name))
    if shards is not None and (undo or order != tuple(range(n))):
        raise UnsupportedStore("shards that are transposed or compressed as a whole")
    return endian or "<", order, tuple(undo), shards


def zarr3(array: dict) -> Layout:
    n = len(array["shape"])
    if array["chunk_grid"]["name"] != "regular":
        raise UnsupportedStore(f"chunk grid {array['chunk_grid']['name']}")
    if array.get("storage_transformers"):
        raise UnsupportedStore("storage transformers")
    kind = _voxel_type(array["data_type"] if isinstance(array["data_type"], str) else "object")
    encoding = array.get("chunk_key_encoding") or {"name": "default"}
    if encoding["name"] not in ("default", "v2"):
        raise UnsupportedStore(f"chunk keys {encoding['name']}")
    plain = encoding["name"] == "v2"
    separator = (encoding.get("configuration") or {}).get("separator", "." if plain else "/")
    chunk = tuple(array["chunk_grid"]["configuration"]["chunk_shape"])
    endian, order, undo, shards = _chain(array["codecs"], n)
    shard = None
    if shards is not None:
        inner = tuple(shards["chunk_shape"])
        if any(c % i for c, i in zip(chunk, inner, strict=True)):
            raise UnsupportedStore("shards that are no whole number of chunks")
        index_endian, _, index_undo, _ = _chain(shards.get("index_codecs") or [{"name": "bytes"}, {"name": "crc32c"}], n + 1)
        if index_endian != "<" or set(index_undo) - {"crc32c"}:
            raise UnsupportedStore("a shard index that is compressed")
        shard = ZarrShard(tuple(c // i for c, i in zip(chunk, inner, strict=True)), index_undo[::-1], shards.get("index_location", "end") == "end")
        chunk = inner
        endian, order, undo, deeper = _chain(shards["codecs"], n)
        if deeper is not None:
            raise UnsupportedStore("shards in shards")
    attributes = array.get("attributes") or {}
    names = array.get("dimension_names")
    meta = _placed_meta(array["shape"], chunk, kind, attributes, names if names and all(names) else None)
    stored = np.dtype(kind).newbyteorder(endian).str
    return Layout(meta, "zarr3", stored, undo, _number(array.get("fill_value"), stored), order, "" if plain else "c", separator, shard=shard)


def n5(array: dict) -> Layout:
    compression = array.get("compression") or {"type": array.get("compressionType", "raw")}
    how = _codec(compression["type"])
    kind = _voxel_type(array["dataType"])
    meta = _placed_meta(array["dimensions"][::-1], array["blockSize"][::-1], kind, array)
    return Layout(meta, "n5", np.dtype(kind).newbyteorder(">").str, (how,) if how else ())


def precomputed(info: dict, scale: int = 0) -> Layout:
    s = info["scales"][scale]
    if s["encoding"] != "raw":
        raise UnsupportedStore(f"encoding {s['encoding']}")
    kind = info["data_type"].lower()
    if kind not in PRECOMPUTED_TYPES + ("int8", "int16", "int32", "int64"):
        raise UnsupportedStore(f"voxels of type {kind}")
    channels = info.get("num_channels", 1)
    many = (channels,) if channels > 1 else ()
    shard, undo = None, ()
    if conf := s.get("sharding"):
        if conf["@type"] != "neuroglancer_uint64_sharded_v1" or conf["hash"] not in ("identity", "murmurhash3_x86_128"):
            raise UnsupportedStore(f"shards by {conf}")
        shard = HashedShard(conf["preshift_bits"], conf["hash"] != "identity", conf["minishard_bits"], conf["shard_bits"], conf.get("minishard_index_encoding") == "gzip", conf.get("data_encoding") == "gzip")
        undo = ("gzip",) if shard.data_gzip else ()
    size, chunk, voxel = (tuple(x[::-1]) for x in (s["size"], s["chunk_sizes"][0], s["resolution"]))
    offset = tuple((s.get("voxel_offset") or [0, 0, 0])[::-1])
    placed = {"axes": ["c"] * bool(many) + ["z", "y", "x"], "voxel_size": (1.0,) * bool(many) + voxel, "units": ("",) * bool(many) + ("nm",) * 3}
    if any(offset):
        placed["translation"] = (0.0,) * bool(many) + tuple((o + 0.5) * v for o, v in zip(offset, voxel, strict=True))
    meta = _placed_meta(many + size, many + chunk, kind, placed | {k: v for k, v in info.items() if k in ("axes", "voxel_size", "units", "translation", "kind")})
    return Layout(meta, "precomputed", np.dtype(kind).newbyteorder("<").str, undo, prefix=s["key"], offset=offset, shard=shard)


def of_store(get, scale: int = 0) -> Layout:
    """The layout of an array's folder; ``get`` returns a small JSON file of it by name, or None. ``scale`` is of precomputed volumes."""
    if m := get(".zarray"):
        return zarr2(m, get(".zattrs") or {})
    if (m := get("zarr.json")) and m.get("node_type", "array") == "array":
        return zarr3(m)
    if (m := get("attributes.json")) and "dimensions" in m:
        return n5(m)
    if m := get("info"):
        return precomputed(m, scale)
    raise ValueError("no array store")


def small_file(fs, root: str):
    """``get`` of ``of_store`` over a file system of pyarrow."""

    def get(name: str) -> dict | None:
        try:
            with fs.open_input_file(f"{root}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    return get
