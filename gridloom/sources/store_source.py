"""Array stores as a Spark data source: ``spark.read.format("gridloom_store").load(path)``.

Rows are voxels, by coordinates and ``v``. Comparisons of coordinates with numbers are pushed down and narrow the box that is read; ``SELECT`` of
``what=places`` gives chunks and where they are stored instead. Partitions are ranges of chunk numbers, so the driver holds some numbers a
partition and lists neither chunks nor files. Tasks look a chunk up by its name, or in its shard's index, and read its bytes alone.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..meta import Box
from .layouts import Layout, of_store, small_file

#: A partition has chunks of about so many bytes, and there are so many partitions at most.
PARTITION_BYTES = 32 << 20
PARTITIONS = 20_000
#: Open files of a task, with what was read of their indexes.
OPEN_FILES = 16
#: Rows of voxels handed to Spark at once.
ROWS = 1 << 18


class Chunks(InputPartition):
    """Chunk numbers ``start`` to ``stop - 1`` of a box."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class StoreReader(DataSourceReader):
    """Reads the chunks of a layout that meet a box, numbered file by file."""

    def __init__(self, layout: Layout, path: str, box: Box, places: bool):
        self.layout, self.path, self.box, self.places = layout, path, box.clip(layout.meta.shape), places

    def pushFilters(self, filters):
        axes, start, stop = self.layout.meta.axes, list(self.box.start), list(self.box.stop)
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if self.places or not name or name[0] not in axes or not isinstance(value, int):
                yield f
                continue
            k = axes.index(name[0])
            if isinstance(f, EqualTo):
                start[k], stop[k] = max(start[k], value), min(stop[k], value + 1)
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                start[k] = max(start[k], value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThanOrEqual | LessThan):
                stop[k] = min(stop[k], value + isinstance(f, LessThanOrEqual))
            else:
                yield f
        self.box = Box(tuple(start), tuple(stop)).clip(self.layout.meta.shape)

    def _files(self) -> list[range]:
        """On each axis the files that meet the box."""
        meta = self.layout.meta
        whole = [c * n for c, n in zip(meta.chunk, self.layout.per_file, strict=True)]
        return [range(a // w, -(-b // w)) if b > a else range(0) for a, b, w in zip(self.box.start, self.box.stop, whole, strict=True)]

    def partitions(self) -> list[Chunks]:
        inner = math.prod(self.layout.per_file)
        n = math.prod(map(len, self._files())) * inner
        raw = np.dtype(self.layout.dtype).itemsize * math.prod(self.layout.meta.chunk)
        size = max(1, PARTITION_BYTES // raw, -(-n // PARTITIONS))
        return [Chunks(k, min(k + size, n)) for k in range(0, n, size)]

    def indices(self, partition: Chunks) -> Iterator[tuple[int, ...]]:
        """Indices of the partition's chunks that meet the box."""
        files, per_file = self._files(), self.layout.per_file
        outer_shape, inner = tuple(map(len, files)), math.prod(per_file)
        wanted = self.layout.meta.chunks_covering(self.box)
        for number in range(partition.start, partition.stop):
            outer = np.unravel_index(number // inner, outer_shape) if outer_shape else ()
            within = np.unravel_index(number % inner, per_file) if per_file else ()
            index = tuple(files[k][int(o)] * per_file[k] + int(i) for k, (o, i) in enumerate(zip(outer, within, strict=True)))
            if all(i in r for i, r in zip(index, wanted, strict=True)):
                yield index

    def _stored(self, partition: Chunks):
        """(index, open file or None, file name, place or None) of every chunk."""
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path)
        files: OrderedDict = OrderedDict()
        for index in self.indices(partition):
            key = self.layout.key(index)
            if key not in files:
                try:
                    files[key] = (fs.open_input_file(f"{root}/{key}"), {})
                except FileNotFoundError:
                    files[key] = (None, {})
                if len(files) > OPEN_FILES:
                    old = files.popitem(last=False)[1][0]
                    if old is not None:
                        old.close()
            files.move_to_end(key)
            file, held = files[key]
            yield index, file, key, file and self.layout.place(file, index, held)

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        meta = self.layout.meta
        if self.places:
            rows = [(*index, key, *(place or (None, None))) for index, _, key, place in self._stored(partition)]
            names = [*(f"chunk_{a}" for a in meta.axes), "file", "start", "length"]
            kinds = [pa.int64()] * len(meta.axes) + [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
            return
        whole = np.dtype(self.layout.dtype).kind in "iu" and np.dtype(self.layout.dtype).itemsize == 8
        for index, file, _, place in self._stored(partition):
            own = Box.of_chunk(index, meta.chunk, meta.shape)
            block = self.layout.block(file.read_at(place[1], place[0]) if place else None, index)
            cut = Box(tuple(map(max, own.start, self.box.start)), tuple(map(min, own.stop, self.box.stop)))
            block = block[tuple(slice(a - o, b - o) for a, b, o in zip(cut.start, cut.stop, own.start, strict=True))]
            if whole and block.dtype.kind == "u" and block.size and int(block.max()) >= 1 << 63:
                raise ValueError("unsigned numbers of 2**63 or more")
            flat = block.reshape(-1)
            for k in range(0, flat.size, ROWS):
                at = np.unravel_index(np.arange(k, min(k + ROWS, flat.size)), block.shape)
                yield pa.RecordBatch.from_arrays([*(pa.array(i.astype(np.int64) + s) for i, s in zip(at, cut.start, strict=True)), pa.array(flat[k : k + ROWS].astype(np.int64 if whole else np.float64))], names=[*meta.axes, "v"])


class StoreSource(DataSource):
    """Options: ``path``; ``scale`` of a precomputed volume; ``box`` (JSON of starts and stops); ``what``: ``voxels`` or ``places``."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_store"

    def _layout(self) -> Layout:
        import pyarrow.fs as pafs

        return of_store(small_file(*pafs.FileSystem.from_uri(self.options["path"])), int(self.options.get("scale", 0)))

    def schema(self) -> str:
        layout = self._layout()
        axes = layout.meta.axes
        if self.options.get("what") == "places":
            return ", ".join(f"chunk_{a} long" for a in axes) + ", file string, start long, length long"
        kind = np.dtype(layout.dtype)
        return ", ".join(f"{a} long" for a in axes) + (", v long" if kind.kind in "iu" and kind.itemsize == 8 else ", v double")

    def reader(self, schema) -> StoreReader:
        layout = self._layout()
        box = Box(*(tuple(x) for x in json.loads(self.options["box"]))) if "box" in self.options else layout.meta.box
        return StoreReader(layout, self.options["path"], box, self.options.get("what") == "places")


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
