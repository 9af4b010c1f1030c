"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Only the histogram (as many rows as a sequence has tokens, at most) comes to the driver. A configuration is a multiset of
lengths that fits one sequence. Multiplicative weights price the lengths, a knapsack dynamic program finds the best
configurations at those prices, lengths covered beyond their share lose weight; the averaged solution is rounded to whole
sequences, and what rounding leaves is packed best fit, longest first. Spark ranks the pieces of each length, and a
piece's rank gives its sequence and place.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .tokens import default_tokenizer, encoder, text_of

SEQUENCE = 2048
#: Rounds of multiplicative weights; bounds the number of configurations to rounds x lengths.
ROUNDS = 40
#: Pieces ranked in one task, at most about.
RANKED = 50_000


def pieces_of(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, end: int = 0, ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``): each document's ids and ``end``, cut.

    A document longer than ``length`` is cut into pieces of it, but for the first, which takes the remainder.
    Null and empty texts are one piece, of ``end`` alone. Texts are split at the file's added tokens, which get their own ids.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)[0].encode
        for batch in batches:
            rows, numbers, starts, lengths, crcs, values = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                x = np.array([*encode(text_of(text)), end], "<u4")
                at, size, k = 0, (len(x) - 1) % length + 1, 0
                while at < len(x):
                    part = x[at : at + size]
                    for held, v in zip((rows, numbers, starts, lengths, crcs), (i, k, at, size, zlib.crc32(part.tobytes())), strict=True):
                        held.append(v)
                    if ids:
                        values.append(part.astype(np.int32))
                    at, size, k = at + size, length, k + 1
            cols = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(v, pa.int64()) for v in (starts, lengths, crcs))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(values, pa.list_(pa.int32()))][: 5 + ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def _best(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best worth for every capacity, and the length to take there (-1: leave one free)."""
    worth, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        worth[c] = worth[c - 1]
        if fit[c]:
            got = worth[c - lengths[: fit[c]]] + prices[: fit[c]]
            k = int(got.argmax())
            if got[k] > worth[c] + 1e-12:
                worth[c], take[c] = got[k], k
    return worth, take


def _configuration(take: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    out: Counter = Counter()
    while capacity > 0:
        if (k := take[capacity]) < 0:
            capacity -= 1
        else:
            out[int(k)] += 1
            capacity -= int(lengths[k])
    return out


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, slack: float = 0.01) -> tuple[dict[tuple, float], float]:
    """A nearly optimal fractional solution of the configuration program, and a lower bound on sequences from its dual.

    Returns configurations, as tuples of (length, count), with how many of each to make.
    """
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    log_w, got, bound = np.zeros(len(lengths)), np.zeros(len(lengths)), float((lengths * need).sum()) / capacity
    out: Counter = Counter()
    for t in range(1, rounds + 1):
        prices = lengths / capacity * np.exp(log_w)
        worth, take = _best(lengths, prices, capacity)
        bound = max(bound, float((prices * need).sum() / worth[capacity]))
        # configurations around each length: those within the slack of the best are best responses, too
        around = prices + worth[capacity - lengths]
        behind = np.flatnonzero((got < need * t / rounds) & (around >= (1 - slack) * worth[capacity]))
        for k in behind[np.argsort(-lengths[behind])].tolist():
            lack = need[k] * t / rounds - got[k]
            if lack > 0:
                c = _configuration(take, lengths, capacity - int(lengths[k])) + Counter([k])
                made = lack / c[k]
                out[tuple(sorted(c.items(), reverse=True))] += made
                for j, a in c.items():
                    got[j] += a * made
        log_w += 0.05 * np.clip(1 - got / (need * t / rounds), -1, 1)
        log_w = np.clip(log_w, -1, 1)
    return {tuple((int(lengths[k]), a) for k, a in c): x for c, x in out.items()}, bound


def sequences(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """Whole sequences for exactly the histogram's pieces: (configuration, how many), configurations as (length, count)."""
    left = dict(histogram)
    out: list[tuple[tuple, int]] = []
    if full := left.pop(capacity, 0):
        out.append((((capacity, 1),), full))
    if not left:
        return out
    found, _ = configurations(left, capacity, rounds)
    for c, x in sorted(found.items(), key=lambda p: (-sum(n * a for n, a in p[0]), -p[1], p[0])):
        made = min(math.ceil(x), *(left[n] // a for n, a in c))
        if made:
            out.append((c, made))
            for n, a in c:
                left[n] -= a * made
    return out + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Longest first, each sequence filled up with the longest pieces that still fit; equal sequences are made at once."""
    lengths = np.array(sorted(x for x, n in left.items() if n), int)
    count = np.array([left[x] for x in lengths.tolist()], int)
    out: list[tuple[tuple, int]] = []
    while len(lengths):
        room, used = capacity, Counter()
        k = len(lengths) - 1
        while k >= 0:
            a = min(int(count[k]), room // int(lengths[k]))
            if a:
                used[k] += a
                room -= a * int(lengths[k])
            k = min(k, int(np.searchsorted(lengths, room, side="right"))) - 1
        made = min(int(count[k]) // a for k, a in used.items())
        out.append((tuple((int(lengths[k]), a) for k, a in used.items()), made))
        for k, a in used.items():
            count[k] -= a * made
        if not count.all():
            lengths, count = lengths[count > 0], count[count > 0]
    return out


def _places(plan: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, pieces per sequence, first sequence and offset of the first piece."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    first = 0
    for c, made in plan:
        offset = 0
        for n, a in c:
            out.setdefault(n, []).append((used[n], a, first, offset))
            used[n] += a * made
            offset += n * a
        first += made
    return {n: np.array(rows) for n, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = SEQUENCE, rounds: int = ROUNDS, ranked: int = RANKED) -> DataFrame:
    """``pieces`` (from ``pieces_of``, already stored) with ``sequence_id`` and ``offset``; gapless from 0 in each sequence.

    Every row is placed once, repeated rows too; an empty table gives an empty one. Ranks within a length are
    taken in shares of about ``ranked`` rows, so that no length, however common, is one task's work.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(sequences(histogram, capacity, rounds))
    shares = max(1, math.ceil(sum(histogram.values()) / ranked))
    shared = pieces.withColumn("__share", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(shares)))
    counts = shared.groupBy("length", "__share").agg(F.count("*").alias("n"))
    before = counts.select("length", "__share", (F.sum("n").over(Window.partitionBy("length").orderBy("__share")) - F.col("n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("length", "__share").orderBy("doc_id", "piece")) - 1
    rows = shared.withColumn("__own", own).join(before, ["length", "__share"]).withColumn("__rank", F.col("__before") + F.col("__own")).drop("__share", "__own", "__before")
    names = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                t = places[n]
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                seq[at] = row[:, 2] + nth // row[:, 1]
                off[at] = row[:, 3] + nth % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return rows.select(*names, "__rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence and place, and with ``ids`` their token ids."""
    return pack(stored(pieces_of(docs, length, tokenizer, ids=ids), "pieces"), length)


def op4_query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
