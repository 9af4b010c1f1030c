"""Suffix-array dedup: remove bytes that a long repeated string covers.

Work is dealt out by content, so that equal strings meet whatever documents hold them:

1. Every window of ``span`` bytes picks the smallest hash among its short strings, its anchor. Neighbouring windows with
   one anchor form a run; equal windows have equal anchors, so they sit in runs of one anchor (a class).
2. Runs equal in all their bytes are counted together before anything is shuffled by class: a run that occurs twice is
   repeated as a whole, a class with one text needs no more work.
3. Classes with several texts, and a run seen once, are the shards' load: those of their texts, each taken once, that share
   the core of some block of windows with another are sorted by induced sorting, and permuted common prefixes tell which windows repeat. Shards hold whole classes and about ``shard_bytes``.
4. A class with more than ``large`` texts would outgrow a shard. Its windows are matched in blocks of 16 starts by
   what all windows of the block share, and only where that repeats window by window, all by counting.

Letters are bytes, or whole words (as 64-bit hashes): then a passage of so many words counts whatever white space parts
them, and removed is what lies from its first word to the word after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import quoted, stored
from .suffix_sort import repeated_starts

SPAN = 400
ANCHOR = 32
#: In words: the passages that a corpus keeps none of, and their short strings.
PASSAGE = 50
SHINGLE = 5
BLOCK = 16
#: Starts in the blocks by which a small class is sifted before it is sorted.
WIDE = 64
LARGE = 1000
SHARD_BYTES = 1_000_000
#: Documents are hashed together up to so many letters, and longer ones in parts of so many windows.
CHUNK = 1 << 18
PART = 1 << 22
#: Bits of a place beside an anchor's hash: fixed, so that equal windows pick equal anchors in texts of any length.
PLACE = 31
#: ASCII white space, by byte.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = [np.r_[np.uint64(1), np.full(n, base, np.uint64)].cumprod(dtype=np.uint64) for base in (_BASE, _BACK)]
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring of ``data`` (bytes, or hashes of words), from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(10, int(len(data)).bit_length()))
        letters = _letters()[data] if data.dtype == np.uint8 else data
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), (letters * up[: len(data)]).cumsum(dtype=np.uint64)]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def each(self, size: int) -> np.ndarray:
        """Of every substring of ``size``, by start."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of each word of a text: runs of anything but ASCII white space."""
    inside = np.r_[False, ~_SPACE[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_letters(raw: np.ndarray) -> np.ndarray:
    """A text's words as 64-bit hashes."""
    start, stop = words_in(raw)
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # bounded scratch for very long texts
        end = max(at + 1, int(np.searchsorted(stop, start[at] + PART)))
        base = start[at]
        out[at:end] = Hashes(raw[base : stop[end - 1]]).of(start[at:end] - base, stop[at:end] - base)
        at = end
    return out


def runs_of(data: np.ndarray, sizes: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in documents of ``sizes`` laid end to end in ``data``.

    Returns for each run: its document's number, the first and the last window's start and the anchor's (in ``data``), the
    anchor's hash and the hash of all the run's bytes and of the anchor's place in it.
    """
    hashes = Hashes(data)
    h = hashes.each(anchor)
    low = (np.uint64(1) << np.uint64(PLACE)) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
    width, want = 1, span - anchor + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    at = (least & low).astype(np.int64)
    stops = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - span + 1, 0))
    first = np.repeat(stops - sizes, np.maximum(sizes - span + 1, 0))
    run = np.maximum(sizes - span + 1, 0)
    x = first + np.arange(len(doc)) - np.repeat(np.cumsum(run) - run, run)
    if not len(x):
        return (x,) * 5 + (x.astype(np.uint64),)
    p = at[x]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])
    end = np.r_[new[1:], len(x)] - 1
    s, e, p, doc = x[new], x[end], p[new], doc[new]
    with np.errstate(over="ignore"):
        whole = _mixed(hashes.of(s, e + span) + (p - s).astype(np.uint64) * _BASE + (e - s).astype(np.uint64))
    return doc, s, e, p, h[p], whole


def _letters_of(raw, kind: type) -> np.ndarray:
    return np.frombuffer(raw, kind) if raw is not None and len(raw) else np.zeros(0, kind)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows with about CHUNK bytes of text: what is made of a slice goes on before the next is looked at."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        held = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, held + CHUNK, "right")))
        yield batch.slice(at, end - at)
        at = end


def _chunks(batches: Iterator[pa.RecordBatch], kind: type, span: int, words: bool):
    """Texts as letters, in groups of about CHUNK: (batch, rows, first letters, arrays); texts over PART windows in parts."""
    for batch in batches:
        texts, group, held = batch.column("text"), [], 0
        for i in range(len(texts)):
            raw = texts[i].as_buffer() if texts[i].is_valid else None
            data = word_letters(_letters_of(raw, np.uint8)) if words else _letters_of(raw, kind)
            for at in range(0, max(1, len(data) - span + 1), PART):
                group.append((i, at, data[at : at + PART + span - 1]))
                held += len(group[-1][2])
                if held >= CHUNK:
                    yield batch, *zip(*group, strict=True)
                    group, held = [], 0
        if group:
            yield batch, *zip(*group, strict=True)


def _runs(span: int, anchor: int, kind: type, words: bool = False):
    """Texts in, runs out; with ``words``, texts become letters here, so that a task holds one Python process, not two in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, begin, group in _chunks(batches, kind, span, words):
            sizes = np.array([len(g) for g in group])
            if sizes.max() < span:
                continue
            doc, s, e, p, cls, whole = runs_of(np.concatenate(group), sizes, span, anchor)
            base = (np.cumsum(sizes) - sizes - np.array(begin))[doc]
            rows = pa.array(np.array(rows)[doc])
            keys = [batch.column(c).take(rows) for c in ("k", "th")]
            place = (s - base << 32) | (e - s << 16) | (p - s)  # the run's start, its last window and its anchor
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.array(whole.view(np.int64)), *keys, pa.array(place)], names=["cls", "whole", "k", "th", "place"])

    return run


def _sorted_shards(span: int, shard_bytes: int, kind: type):
    """Rows sorted by class in, repeated windows' byte ranges out."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        starts = repeated_starts([np.frombuffer(r[1], kind) for r in rows], span)
        out: list[tuple] = []
        for (_, _, k, th, s, n), at in zip(rows, starts, strict=True):
            if n == 1 and len(at):
                cut = np.flatnonzero(np.diff(at) > span) + 1
                out += [(k, th, s + int(part[0]), s + int(part[-1]) + span) for part in np.split(at, cut)]
        return pa.RecordBatch.from_pylist([dict(zip(("k", "th", "a", "b"), r, strict=True)) for r in out], schema=_RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = 0, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("cls", "bytes", "k", "th", "s", "n")), strict=True):
                if held >= shard_bytes and r[0] != rows[-1][0]:
                    yield solve(rows)
                    held, rows = 0, []
                rows.append(r)
                held += len(r[1])
        if rows:
            yield solve(rows)

    return run


_RANGES = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _blocks(span: int, kind: type):
    """Cut runs into blocks of windows, placed by the anchor: what a block's windows share, and all its bytes, hashed."""
    block = max(1, min(BLOCK, span // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hashes, n = Hashes(np.frombuffer(r["bytes"], kind)), r["e"] - r["s"] + 1
                lead = (r["s"] - r["p"]) % block  # the first window's place in its block
                x = np.r_[0, np.arange(block - lead, n, block)]
                y = np.r_[x[1:], n] - 1
                core = np.maximum(x + block - 1 - np.where(x == 0, lead, 0), 0)
                cls = hashes.of(core, core + span - block + 1)
                whole = _mixed(hashes.of(x, y + span) + (y - x).astype(np.uint64) + np.where(x == 0, lead, 0).astype(np.uint64) * np.uint64(1 << 20))
                same = [pa.array(np.full(len(x), r[c]), t) for c, t in (("k", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("n", pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.array(whole.view(np.int64)), *same, pa.array(x + r["s"]), pa.array(y + r["s"])], names=["cls", "whole", "k", "th", "s", "n", "x", "y"])

    return run


def _windows(span: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h = Hashes(np.frombuffer(r["bytes"], kind)).each(span)
                for b in r["blocks"]:
                    at = np.arange(b["x"], b["y"] + 1)
                    same = [pa.array(np.full(len(at), v), t) for v, t in ((r["k"], pa.int64()), (r["th"], pa.int64()), (b["n"], pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(h[at - r["s"]].view(np.int64)), *same, pa.array(at)], names=["key", "k", "th", "n", "x"])

    return run


def _large_class_ranges(runs: DataFrame, span: int, kind: type) -> DataFrame:
    """Ranges of repeated windows in runs (each text once, seen n times) of classes too large for a shard.

    Blocks repeat as a whole, or share what all their windows have in common with another block; only the latter
    are looked at window by window. All matching is by counting hashes, so that no class meets in one task.
    """
    blocks = stored(runs.mapInArrow(_blocks(span, kind), "cls long, whole long, k long, th long, s long, n long, x long, y long"), "blocks")
    texts = blocks.groupBy("cls", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("k", "th", "s", "x", "y")).alias("one"))
    texts = stored(texts, "block-texts")
    whole = blocks.where("n = 1").join(texts.where("n > 1").select("cls", "whole"), ["cls", "whole"], "left_semi").select("k", "th", F.col("x").alias("a"), (F.col("y") + span).alias("b"))
    classes = texts.groupBy("cls").agg(F.count("*").alias("texts"), F.min("n").alias("least")).where("texts > 1 and least = 1").select("cls")
    live = texts.join(classes, "cls").select("one.*", "n").groupBy("k", "th", "s").agg(F.collect_list(F.struct("x", "y", "n")).alias("blocks"))
    each = runs.select("k", "th", "s", "bytes").join(live, ["k", "th", "s"]).select("k", "th", "s", "bytes", "blocks").mapInArrow(_windows(span, kind), "key long, k long, th long, n long, x long")
    each = stored(each, "windows")
    twice = each.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    single = each.where("n = 1").join(twice, "key", "left_semi").select("k", "th", F.col("x").alias("a"), (F.col("x") + span).alias("b"))
    return whole.unionByName(single)


def _cores(span: int, kind: type):
    """What the windows of each block of a text share, hashed: ``core``, and the text's ``place``."""
    wide = max(1, min(WIDE, span // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("bytes")]
            base = np.cumsum([len(x) for x in parts]) - [len(x) for x in parts]
            s, e, p = (batch.column(c).to_numpy() for c in ("s", "e", "p"))
            lead = (s - p) % wide
            blocks = (e - s + lead) // wide + 1
            row = np.repeat(np.arange(len(parts)), blocks)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = base[row] + nth * wide - lead[row]  # of the whole block; it may begin before the text does
            core = Hashes(np.concatenate(parts)).of(start + wide - 1, start + span)
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("cls", "k", "th", "place"))], names=["core", "cls", "k", "th", "place"])

    return run


def repeated_ranges(docs: DataFrame, span: int = SPAN, large: int = LARGE, shard_bytes: int = SHARD_BYTES, words: bool = False) -> DataFrame:
    """``k``, ``th``, ``a``, ``b``: ranges of letters, which may overlap, that together are all to remove.

    ``docs`` has ``k``, ``th`` (an id and the text's hash, neither null; rows equal in both are copies) and ``text``
    (binary). Letters are its bytes, or with ``words`` its words.
    """
    kind = np.uint64 if words else np.uint8
    anchor, width = min(SHINGLE if words else ANCHOR, span), np.dtype(kind).itemsize
    letters = docs.mapInArrow(_as_words, "k long, th long, text binary") if words else docs
    runs = stored(docs.mapInArrow(_runs(span, anchor, kind, words), "cls long, whole long, k long, th long, place long"), "runs")
    texts = stored(runs.groupBy("cls", "whole").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "place")).alias("one")), "texts")
    s, e, p = (F.expr(x) for x in ("shiftright(place, 32)", "shiftright(place, 32) + (shiftright(place, 16) & 65535)", "shiftright(place, 32) + (place & 65535)"))
    whole = runs.join(texts.where("n > 1").select("cls", "whole"), ["cls", "whole"], "left_semi").select("k", "th", s.alias("a"), (e + span).alias("b"))
    classes = texts.groupBy("cls").agg(F.count("*").alias("texts"), F.min("n").alias("least")).where("texts > 1 and least = 1")
    wanted = texts.join(classes.select("cls", "texts"), "cls").groupBy("one.k", "one.th").agg(F.collect_list(F.struct("cls", "texts", "n", "one.place")).alias("runs"))
    cut = letters.join(wanted, ["k", "th"]).select("k", "th", "text", F.explode("runs").alias("r")).select("k", "th", "text", "r.*", *(x.alias(c) for x, c in zip((s, e, p), "sep", strict=True)))
    cut = stored(cut.select("cls", "texts", "n", "k", "th", "place", "s", "e", "p", F.expr(f"substring(text, cast(s * {width} + 1 as int), cast((e - s + {span}) * {width} as int))").alias("bytes")), "cut")
    # a window can only repeat where what its block shares does: that spares most texts of a class the sorting
    small = cut.where(f"texts <= {large}")
    cores = small.select("cls", "k", "th", "place", "s", "e", "p", "bytes").mapInArrow(_cores(span, kind), "core long, cls long, k long, th long, place long")
    met = cores.groupBy("core", "cls").agg(F.count("*").alias("n")).where("n > 1").select("core", "cls")
    live = cores.join(met, ["core", "cls"], "left_semi").select("k", "th", "place").distinct()
    load = small.join(live, ["k", "th", "place"], "left_semi").select("cls", "bytes", "k", "th", "s", "n")
    out = whole.unionByName(load.repartition("cls").sortWithinPartitions("cls").mapInArrow(_sorted_shards(span, shard_bytes, kind), "k long, th long, a long, b long"))
    if not cut.where(f"texts > {large}").isEmpty():
        out = out.unionByName(_large_class_ranges(cut.where(f"texts > {large}"), span, kind))
    return out


def _kept(words: bool):
    """Texts without their ranges, of bytes or of words: sizes in bytes, spans and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in _slices(whole)):
            texts, ranges = batch.column("text"), batch.column("ranges")
            removed, spans, left = [], [], []
            for i in range(len(batch)):
                data = memoryview(texts[i].as_buffer()) if texts[i].is_valid else memoryview(b"")
                if ranges[i].is_valid:
                    flat = ranges[i].values
                    a, b = (np.asarray(flat.field(j), np.int64) for j in (0, 1))
                    order = np.lexsort((b, a))
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])  # touching runs are one
                    a, b = a[new], b[np.r_[new[1:], len(b)] - 1]
                    if words:
                        edges = np.r_[words_in(np.frombuffer(data, np.uint8))[0], len(data)]
                        a, b = edges[a], edges[b]
                    parts = [data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]
                    removed.append(int((b - a).sum()))
                    spans.append(len(a))
                    left.append(b"".join(parts))
                else:
                    removed.append(0)
                    spans.append(0)
                    left.append(bytes(data))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], names=["row", "n_removed", "n_spans", "kept"])

    return run


def _as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in _slices(whole)):
        texts = batch.column("text")
        letters = [word_letters(_letters_of(texts[i].as_buffer(), np.uint8)).tobytes() for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), pa.array(letters, pa.binary())], names=["k", "th", "text"])


def remove_repeats(docs: DataFrame, span: int = SPAN, large: int = LARGE, shard_bytes: int = SHARD_BYTES, words: bool = False) -> DataFrame:
    """``row`` (the input row as a struct, without text), ``n_removed``, ``n_spans`` and ``kept`` (bytes) per input row.

    A byte goes when a string of ``span`` bytes over it also starts anywhere else, in any row's text, judged on the
    input; with ``words``, a word goes when ``span`` words over it are found again, with the white space after it.
    Null and empty texts, and those below ``span``, lose nothing; copies all lose their bytes, the first too.
    Rows that repeat an id are documents of their own; further columns ride along in ``row``; an empty table
    gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rest = [quoted(c) for c in docs.columns if c.lower() != "text"]
    keyed = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))
    ranges = repeated_ranges(keyed.select("k", "th", "text"), span, large, shard_bytes, words)
    ranges = ranges.groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    out = StructType([keyed.schema["row"], *StructType.fromDDL("n_removed long, n_spans long, kept binary")])
    return keyed.join(ranges, ["k", "th"], "left").select("row", "text", "ranges").mapInArrow(_kept(words), out)


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("row.doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, span: int = PASSAGE) -> DataFrame:
    """``docs`` without passages of ``span`` words or more that are found twice: columns and types as they were, a null text empty."""
    out = remove_repeats(docs, span, words=True)
    text = F.col("kept").cast("string")
    return out.select(*[text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
