"""Chunked array stores: Zarr v2 and v3, N5, precomputed.

Written chunk by chunk in tasks; read by the data source of ``store_source``, as the metadata say (``layouts``), or refused. Stores are
reached by ``pyarrow.fs``: files that all executors see, S3, GCS, or HDFS where libhdfs is installed.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..grid import Grid
from ..meta import ArrayMeta, Box
from ..operators.aggregate import chunk_summary
from .layouts import FORMATS, PRECOMPUTED_TYPES, Layout, compress, of_store, small_file
from .store_source import register

COMPRESSORS = ("none", "gzip", "zstd")


def metadata(meta: ArrayMeta, form: str, compressor: str) -> dict[str, dict]:
    """Metadata files by name."""
    n = len(meta.axes)
    if form == "zarr2":
        codec = None if compressor == "none" else {"id": compressor, "level": 5 if compressor == "gzip" else 3}
        array = {"zarr_format": 2, "shape": meta.shape, "chunks": meta.chunk, "dtype": np.dtype(meta.dtype).newbyteorder("<").str, "compressor": codec, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "/"}
        return {".zarray": array, ".zattrs": _placed(meta)}
    if form == "zarr3":
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([] if compressor == "none" else [{"name": compressor, "configuration": {"level": 5 if compressor == "gzip" else 3}}])
        grid = {"name": "regular", "configuration": {"chunk_shape": meta.chunk}}
        return {"zarr.json": {"zarr_format": 3, "node_type": "array", "shape": meta.shape, "data_type": meta.dtype, "chunk_grid": grid, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "dimension_names": meta.axes, "attributes": _placed(meta)}}
    if form == "n5":
        kind = {"none": {"type": "raw"}, "gzip": {"type": "gzip", "level": 5}}
        if compressor not in kind:
            raise ValueError("n5 takes gzip or none")
        return {"attributes.json": {"dimensions": meta.shape[::-1], "blockSize": meta.chunk[::-1], "dataType": meta.dtype, "compression": kind[compressor], "n5": "2.0.0"} | _placed(meta)}
    if meta.dtype not in PRECOMPUTED_TYPES or n != 3:
        raise ValueError(f"precomputed takes volumes of {PRECOMPUTED_TYPES}")
    scale = {"key": "s0", "size": meta.shape[::-1], "resolution": meta.voxel_size[::-1], "voxel_offset": [0, 0, 0], "chunk_sizes": [meta.chunk[::-1]], "encoding": "raw"}
    return {"info": {"@type": "neuroglancer_multiscale_volume", "type": "image", "data_type": meta.dtype, "num_channels": 1, "scales": [scale]} | _placed(meta)}


def _placed(meta: ArrayMeta) -> dict:
    return {"axes": meta.axes, "voxel_size": meta.voxel_size, "units": meta.units, "translation": meta.translation, "kind": meta.kind}


def chunk_key(index: tuple[int, ...], meta: ArrayMeta, form: str) -> str:
    if form == "zarr2":
        return "/".join(map(str, index))
    if form == "zarr3":
        return "/".join(["c", *map(str, index)])
    if form == "n5":
        return "/".join(map(str, index[::-1]))
    box = Box.of_chunk(index, meta.chunk, meta.shape)
    return "s0/" + "_".join(f"{a}-{b}" for a, b in zip(box.start[::-1], box.stop[::-1], strict=True))


def encode(block: np.ndarray, meta: ArrayMeta, form: str, compressor: str) -> bytes:
    """A chunk's bytes; ``block`` is what of the chunk lies in the array."""
    kind = np.dtype(meta.dtype)
    if form in ("zarr2", "zarr3"):
        whole = np.zeros(meta.chunk, kind.newbyteorder("<"))
        whole[tuple(slice(0, n) for n in block.shape)] = block
        return compress(whole.tobytes(), compressor)
    if form == "n5":
        head = struct.pack(f">HH{block.ndim}I", 0, block.ndim, *block.shape[::-1])
        return head + compress(block.astype(kind.newbyteorder(">")).tobytes(), compressor)
    return block.astype(kind.newbyteorder("<")).tobytes()


def write(grid: Grid, path: str, form: str = "zarr2", compressor: str = "gzip", skip_empty: bool = True) -> DataFrame:
    """Write an array as a store; returns ``chunks``, ``written``, ``skipped``, ``bytes``.

    Every task writes the chunks that it encoded, each file aside and then renamed, so that a chunk is there whole or not at all, and a task
    that runs again leaves the same files. Chunks that hold only zeros are left out.
    """
    import pyarrow.fs as pafs

    if form not in FORMATS or compressor not in COMPRESSORS:
        raise ValueError(f"formats are {FORMATS}, compressors {COMPRESSORS}")
    meta, axes = grid.meta, grid.axes
    files = metadata(meta, form, compressor)
    put_json(path, files)
    keys = [f"chunk_{a}" for a in axes]

    def put(part: pd.DataFrame) -> pd.DataFrame:
        index = tuple(int(part[k].iloc[0]) for k in keys)
        box = Box.of_chunk(index, meta.chunk, meta.shape)
        block = np.zeros(box.shape, meta.dtype)
        block[tuple(part[a].to_numpy() - s for a, s in zip(axes, box.start, strict=True))] = part["v"].to_numpy()
        if skip_empty and not block.any():
            return pd.DataFrame({"written": [0], "bytes": [0]})
        data = encode(block, meta, form, compressor)
        own, base = pafs.FileSystem.from_uri(path)
        name = f"{base}/{chunk_key(index, meta, form)}"
        own.create_dir(name.rpartition("/")[0], recursive=True)
        aside = f"{base}/.{uuid.uuid4().hex}"
        with own.open_output_stream(aside) as out:
            out.write(data)
        own.move(aside, name)
        return pd.DataFrame({"written": [1], "bytes": [len(data)]})

    ids = [F.floor(F.col(a) / c).cast("long").alias(k) for a, c, k in zip(axes, meta.chunk, keys, strict=True)]
    done = grid.df.select(*ids, *axes, "v").groupBy(*keys).applyInPandas(put, "written long, bytes long")
    got = done.agg(F.count("*"), F.sum("written"), F.sum("bytes")).first()
    return grid.df.sparkSession.createDataFrame([(got[0], got[1] or 0, got[0] - (got[1] or 0), got[2] or 0)], "chunks long, written long, skipped long, bytes long")


def put_json(path: str, files: dict[str, dict]) -> None:
    """Small files of a folder, by name."""
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    for name, content in files.items():
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(json.dumps(content).encode())


def small_json(spark: SparkSession, path: str) -> dict | None:
    """A small file by Hadoop's file system, which, unlike Spark's readers, sees names that begin with a dot."""
    if not exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def layout(path: str, scale: int = 0) -> Layout:
    """How the array at ``path`` is stored, by its metadata files; ``UnsupportedStore`` where it is not read here, ValueError where none is."""
    import pyarrow.fs as pafs

    try:
        return of_store(small_file(*pafs.FileSystem.from_uri(path)), scale)
    except ValueError as e:
        raise type(e)(f"{path}: {e}") from e


def scales(path: str) -> int:
    """How many scales a precomputed volume has; 0 where there is none."""
    import pyarrow.fs as pafs

    return len((small_file(*pafs.FileSystem.from_uri(path))("info") or {}).get("scales", ()))


def read(spark: SparkSession, path: str, box: Box | None = None, scale: int = 0) -> Grid:
    """A store's array, or a box of it: tasks read the bytes of the chunks that the box meets, and comparisons made later narrow it further.

    Missing chunks hold the array's fill value. Values are doubles, those of 64-bit whole numbers longs.
    """
    own = layout(path, scale)
    register(spark)
    source = spark.read.format("gridloom_store").option("scale", scale)
    if box is not None:
        box = box.clip(own.meta.shape)
        source = source.option("box", json.dumps([box.start, box.stop]))
    return Grid(source.load(path), own.meta)


def chunk_places(spark: SparkSession, path: str, scale: int = 0) -> DataFrame:
    """``chunk_<axis>``, ``file``, ``start``, ``length`` of every chunk, from file sizes and shards' indexes; nulls where a chunk is not stored."""
    register(spark)
    return spark.read.format("gridloom_store").option("scale", scale).option("what", "places").load(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def empty_chunks(grid: Grid) -> DataFrame:
    """Chunks that a write would leave out."""
    return chunk_summary(grid).where("filled = 0").drop("total", "voxels", "filled")


def chunk_sizes(spark: SparkSession, path: str, low: float = 0.0, high: float = 1.0, scale: int = 0) -> Grid:
    """One voxel a chunk, in shards too: its stored size over its raw size, from ``low`` to ``high`` onto 0 to 255. No chunk is read."""
    own = layout(path, scale)
    meta = own.meta
    raw = float(np.dtype(own.dtype).itemsize * np.prod(meta.chunk))
    share = (F.coalesce("length", F.lit(0)) / raw - low) / (high - low) * 255
    axes = [F.col(f"chunk_{a}").alias(a) for a in meta.axes]
    df = chunk_places(spark, path, scale).select(*axes, F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), share))).cast("long").alias("v"))
    return Grid(df, ArrayMeta(meta.axes, own.grid, "uint8", voxel_size=tuple(v * c for v, c in zip(meta.voxel_size, meta.chunk, strict=True))))
