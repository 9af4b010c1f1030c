"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint of 64 bits per document; ``2**(r+1) - 1`` structured bit masks such that any two fingerprints at
distance ``r`` or less agree on all bits of some mask, so that no pair is missed. Bit ``i`` gets a vector
``m(i)`` of ``r + 1`` bits, and mask ``v`` (non-zero) holds the bits with odd ``popcount(m(i) & v)``: the at most ``r``
vectors of the differing bits leave some ``v`` orthogonal to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import hashable, quoted, stored
from ..functions.components import connected_components

#: Buckets with more distinct fingerprints are dealt out again by a second set of masks.
LARGE_BUCKET = 1500


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``fp`` (long, the 64 bits), and columns (long) to take ``also``: bit set where it is set in over half of the shingles' XXH64.

    A-Z are lower-cased, words are runs of non-space, shingles count as often as they occur; a text with fewer words
    is one shingle, one without words (or null) has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts = batch.column("text")
            out = np.zeros(len(texts), np.uint64)
            for i in range(len(texts)):
                if texts[i].is_valid:  # bytes, whose lower() and split() know ASCII only
                    out[i] = _fingerprint(texts[i].as_buffer().to_pybytes().lower().split(), shingle, seed, digest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64)), *(batch.column(c) for c in also)], names=["doc_id", "fp", *also])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def _fingerprint(words: list[bytes], shingle: int, seed: int, digest) -> int:
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded scratch for very long texts
        part = h[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _inverse(x: int) -> int:
    """x to the power 62 in the field of 64 elements (modulus z^6 + z + 1): its inverse, 0 for 0."""

    def times(p: int, q: int) -> int:
        r = 0
        for i in range(6):
            r ^= (p << i) if q >> i & 1 else 0
        for i in range(10, 5, -1):
            r ^= (0b1000011 << (i - 6)) if r >> i & 1 else 0
        return r

    out = 1
    for _ in range(62):
        out = times(out, x)
    return out


def covering_masks(radius: int, second: bool = False) -> list[int]:
    """The masks for pairs within ``radius``, as signed longs.

    The first set takes bit i's vector from i itself, the second from i's inverse in the field of 64 elements; that
    map is far from linear, so a mask of either set leaves at most 20 bits (at radius 4) that neither holds.
    """
    width = radius + 1
    vector = [(_inverse(i) if second else i) % (1 << width) for i in range(64)]
    out = []
    for v in range(1, 1 << width):
        mask = sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint_links(nodes: DataFrame, radius: int = 4, large: int = LARGE_BUCKET) -> DataFrame:
    """Links that join all fingerprints (``fp`` long, distinct) within ``radius`` bits of each other.

    Returns ``a``, ``b``: a spanning forest of each bucket's pairs within the radius, so that components are
    exact and no bucket gives more links than members. A bucket over ``large`` is dealt out again by a second
    covering of the same radius, where members agree on the bits of both masks. What is still over ``large`` is joined by
    common neighbours: two fingerprints within the radius have one that half of it parts from each, and all that have one
    in common are within the radius; so each is linked to the least with which it shares one, in work that grows as the bucket.
    """
    dealt = _dealt(nodes.withColumn("held", F.lit(0).cast("long")), F.lit(0).cast("long"), covering_masks(radius))
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    counts = stored(counts, "buckets")
    pairs = counts.where(f"n = 2 and bit_count(a ^ b) <= {radius}").select("a", "b")
    # what sits in buckets of three and more
    several = dealt.join(counts.where("n > 2").select("bucket", "n"), "bucket")
    several = stored(several, "several")
    lists = several.where(f"n <= {large}").groupBy("bucket").agg(F.collect_set("fp").alias("fps"))
    again = _dealt(several.where(f"n > {large}"), F.col("bucket"), covering_masks(radius, second=True))
    sizes = again.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    again = stored(again.join(sizes, "bucket"), "again")
    most = large if radius % 2 == 0 else 1 << 62  # an odd radius has no half
    finer = again.where(f"n <= {most}").groupBy("bucket").agg(F.collect_set("fp").alias("fps"))
    found = lists.select("fps").unionByName(finer.select("fps")).mapInArrow(_forests(radius), "a long, b long")
    around = again.where(f"n > {most}").select("bucket", "fp", "held").mapInArrow(_neighbours(radius), "bucket long, near long, fp long")
    least = around.groupBy("bucket", "near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = around.join(least, ["bucket", "near"]).where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(found).unionByName(met).distinct()


def _dealt(rows: DataFrame, salt, masks: list[int]) -> DataFrame:
    """``rows`` once for each mask: ``bucket``, ``fp``, and the bits ``held`` that a bucket's members agree on."""
    keys = F.array(*[F.struct(F.xxhash64(F.lit(i), salt, F.col("fp").bitwiseAND(F.lit(m))).alias("bucket"), F.col("held").bitwiseOR(F.lit(m)).alias("held")) for i, m in enumerate(masks)])
    return rows.select(F.explode(keys).alias("k"), "fp").select("k.bucket", "fp", "k.held")


def _neighbours(radius: int):
    """Every fingerprint with half the radius of bits changed, or fewer, among those that its bucket does not hold."""
    half = radius // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held").to_numpy()
            for bits in np.unique(held).tolist():
                at = np.flatnonzero(held == bits)
                free = [1 << b for b in range(64) if not bits >> b & 1]
                flips = np.array([sum(c) for n in range(half + 1) for c in combinations(free, n)], np.uint64)
                for part in np.array_split(at, len(at) * len(flips) // 1_000_000 + 1):
                    fp = batch.column("fp").to_numpy()[part]
                    near = (fp.view(np.uint64)[:, None] ^ flips[None, :]).ravel()
                    rows = pa.array(np.repeat(part, len(flips)))
                    yield pa.RecordBatch.from_arrays([batch.column("bucket").take(rows), pa.array(near.view(np.int64)), batch.column("fp").take(rows)], names=["bucket", "near", "fp"])

    return run


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps in batch.column("fps"):
                x = np.sort(np.asarray(fps.values, np.int64)).view(np.uint64)
                a, b = [], []
                waiting = np.ones(len(x), bool)
                while waiting.any():
                    front = [int(np.argmax(waiting))]
                    waiting[front[0]] = False
                    while front:
                        i = front.pop()
                        rest = np.flatnonzero(waiting)
                        near = rest[np.bitwise_count(x[rest] ^ x[i]) <= radius]
                        waiting[near] = False
                        front += near.tolist()
                        a.append(np.full(len(near), x[i]))
                        b.append(x[near])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y).astype(np.uint64).view(np.int64)) for y in (a, b)], names=["a", "b"])

    return run


def _groups(nodes: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``group`` (the component's smallest fingerprint) of distinct fingerprints."""
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius)).toDF("fp", "component")
    return nodes.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest doc_id reachable over links of ``radius`` bits or fewer).

    One row per input row. Copies share a fingerprint and are one node, so their number makes no links. Null
    and wordless texts have fingerprint zero and are linked like others; repeated ids keep their rows and link nothing;
    null ids name no component, unless there are no others in it; further columns of ``docs`` are not read; an empty table
    gives an empty one.
    """
    fps = stored(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    of = stored(_groups(nodes, radius).join(nodes, "fp"), "groups")
    named = of.groupBy("group").agg(F.min("node").alias("component_id"))
    return fps.join(of.join(named, "group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op3_query(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: fingerprint as 16 lowercase hex digits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` with exactly one row of each component, of the smallest doc_id (null last); columns as they were.

    A row is known by two hashes of all its columns, and of rows equal in all of them any is taken; so rows without
    an id, or with a repeated one, are kept or left out like others.
    """
    every = [c for x in hashable(docs) for c in (x, x.isNull())]
    whole = F.struct(*map(quoted, docs.columns)).alias("whole")
    keyed = docs.select(whole, "doc_id", "text", F.xxhash64(F.lit(1), *every).alias("h1"), F.xxhash64(F.lit(2), *every).alias("h2"))
    fps = stored(fingerprints(keyed, also=("h1", "h2")), "fingerprints")
    of = _groups(stored(fps.select("fp").distinct(), "nodes"), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h1", "h2")).alias("first")
    lasting = fps.join(of, "fp").groupBy("group").agg(first).select("first.h1", "first.h2")
    return keyed.select("whole", "h1", "h2").dropDuplicates(["h1", "h2"]).join(lasting, ["h1", "h2"], "left_semi").select("whole.*")
