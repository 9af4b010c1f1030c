"""Token ids of a corpus as binary files, document boundaries in Elias-Fano code.

A corpus is a folder of files, each a stretch of the documents in ascending order of their ids, and a table that lists the files which count.
A file, little-endian throughout:

* token ids of its documents, end ids included, one after another without gaps: 2 bytes an id where the vocabulary allows, else 4;
* Elias-Fano code of the documents' ends, from which a select gives any document's place and length;
* Elias-Fano code of the document ids, less the first of them;
* a footer of fixed length (``_FOOTER``): documents, documents without id, ids, first document id, bytes of both codes, bytes an id, mark.

Files are written by the tasks that hold the sorted documents. Every attempt takes a name of its own, and the table is committed by Spark's own
writer, so a task that runs twice leaves a file that nobody reads. Folders are reached by ``pyarrow.fs``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_folder, stored
from .elias_fano import EliasFano
from .tokens import default_tokenizer, encoder, text_of

#: A file is closed with the document that fills it up to so many ids.
FILE_IDS = 1 << 24
#: Readers fetch whole documents of about so many ids at once.
READ_IDS = 1 << 20
_FOOTER = struct.Struct("<QQQqQQB7s")
_MARK = b"IDSEF01"


def _place(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path)


class FileWriter:
    """Writes one file, document by document; only the documents' lengths and ids are held."""

    def __init__(self, path: str, width: int):
        fs, name = _place(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self._out, self._width, self._code = fs.open_output_stream(name), width, np.dtype(f"<u{width}")
        self._ends, self._docs, self.n_ids, self.n_null = array("Q"), array("q"), 0, 0

    def add(self, doc_id: int | None, ids: list[int]) -> None:
        self._out.write(np.array(ids, self._code).tobytes())
        self.n_ids += len(ids)
        self._ends.append(self.n_ids)
        if doc_id is None:
            self.n_null += 1
        else:
            self._docs.append(doc_id)

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        docs = np.array(self._docs, np.int64)
        first = int(docs[0]) if len(docs) else 0
        ends, names = EliasFano.encode(np.array(self._ends, np.uint64)), EliasFano.encode(docs.view(np.uint64) - np.array([first]).view(np.uint64))
        foot = _FOOTER.pack(len(self._ends), self.n_null, self.n_ids, first, len(ends), len(names), self._width, _MARK)
        self._out.write(ends + names + foot)
        self._out.close()
        return len(self._ends), self.n_ids


class FileReader:
    """Random access to one file: its codes are held, ids are read a range at a time."""

    def __init__(self, path: str):
        fs, name = _place(path)
        self._in = fs.open_input_file(name)
        size = self._in.size()
        foot = self._in.read_at(_FOOTER.size, max(0, size - _FOOTER.size))
        if len(foot) < _FOOTER.size or foot[-len(_MARK) :] != _MARK:
            raise ValueError(f"not a file of token ids: {path}")
        self.n_docs, self._n_null, self.n_ids, self._first, n_ends, n_names, width, _ = _FOOTER.unpack(foot)
        self._code = np.dtype(f"<u{width}")
        at = self.n_ids * width
        if at + n_ends + n_names + _FOOTER.size != size:
            raise ValueError(f"a file of token ids of the wrong length: {path}")
        self.ends, self._docs = EliasFano(self._in.read_at(n_ends, at)), EliasFano(self._in.read_at(n_names, at + n_ends))

    def close(self) -> None:
        self._in.close()

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` of the file begins and ends, by two selects."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def edges(self, start: int, stop: int) -> np.ndarray:
        """Starts of documents ``start`` to ``stop - 1``, and the last one's end."""
        ends = self.ends.slice(max(0, start - 1), stop).astype(np.int64)
        return ends if start else np.r_[0, ends]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop - 1`` of the file."""
        width = self._code.itemsize
        return np.frombuffer(self._in.read_at((stop - start) * width, start * width), self._code)

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        """Document ids by place; those without one come first."""
        a, b = (max(0, x - self._n_null) for x in (start, stop))
        known = (self._docs.slice(a, b) + np.array([self._first]).view(np.uint64)).view(np.int64)
        return [None] * (stop - start - len(known)) + known.tolist()

    def places(self, doc_id: int | None) -> range:
        """Places of the documents with an id, or of those without one."""
        if doc_id is None:
            return range(self._n_null)
        if doc_id < self._first:
            return range(0)
        return range(*(self._n_null + self._docs.first_at_least(doc_id - self._first + k) for k in (0, 1)))

    def blocks(self, size: int = READ_IDS) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``size`` ids, one document at least."""
        at = 0
        while at < self.n_docs:
            start = self.ends[at - 1] if at else 0
            stop = max(at + 1, self.ends.first_at_least(start + size))
            yield at, min(stop, self.n_docs)
            at = stop


def write_corpus(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS, text: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending order of ``doc_id``; returns the table of files.

    ``part``, ``nth`` (their order is that of the documents), ``file``, ``n_docs``, ``n_ids``. Every row is a document: a null or empty text is the end
    id alone; rows without an id come first, rows of one id in the order of their texts' hashes; repeated rows are written as often as they occur. An
    empty table writes no file. Further columns are not read. ``path`` is a folder that all executors see, by default one in the shared folder.

    One range shuffle of the texts; a file has about ``file_ids`` ids and one document at least, however large its partition.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer or default_tokenizer()
    folder = path or f"{shared_folder(spark)}/gridloom/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex[:12]}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = encoder(vocabulary)
        width = 2 if max(len(sizes) - 1, end_id) < 1 << 16 else 4
        part, rows, out = TaskContext.get().partitionId(), [], None

        def close():
            rows.append((part, len(rows), file, *out.close()))

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    file = f"{folder}/{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.ids"
                    out = FileWriter(file, width)
                out.add(doc_id, own.encode(text_of(value)) + [end_id])
                if out.n_ids >= file_ids:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "nth", "file", "n_docs", "n_ids"), r, strict=True)) for r in rows], schema)

    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    return stored(picked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(put, "part int, nth int, file string, n_docs long, n_ids long"), "token-files")


def placed_files(files: DataFrame) -> DataFrame:
    """The table of files with ``before``: how many ids come before each file.

    A row for each write task comes to the driver, as its status does; files of one task are added up in Spark.
    """
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    parts = sorted(totals)
    ahead = np.r_[0, np.cumsum([totals[p] for p in parts])].tolist()
    known = files.sparkSession.createDataFrame(list(zip(parts, ahead, strict=False)), "part int, ahead long")
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_ids")
    return files.withColumn("own", own).join(known, "part").select("file", "n_docs", (F.col("ahead") + F.col("own")).alias("before"))


def read_documents(files: DataFrame, ids: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, and with ``ids`` the ids themselves (``array<int>``).

    Read from the files: boundaries by selects, ids a range of documents at a time.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = FileReader(row["file"])
                for a, b in file.blocks():
                    edges = file.edges(a, b)
                    got = file.ids(int(edges[0]), int(edges[-1]))
                    cut, wide = edges - edges[0], memoryview(got.astype("<u4")).cast("B")
                    crc = [zlib.crc32(wide[4 * s : 4 * e]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    cols = [pa.array(file.doc_ids(a, b), pa.int64()), pa.array(edges[:-1] + row["before"]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                    cols += [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(got.astype(np.int32)))] if ids else []
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                file.close()

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return placed_files(files).repartition("file").select("file", "before").mapInArrow(get, schema)


def op11_query(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")))
