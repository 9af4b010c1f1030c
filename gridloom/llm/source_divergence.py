"""How far the sources of a language diverge in their words: in-mapper stripes.

A partition folds whole documents into a hash table of stripes, term -> (documents, occurrences by source), and hands it on when it is full;
stripes of one term are merged by key. The merged stripes emit the divergences: for two sources only the terms that both have are compared one by
one, all others follow from how often each count occurs in a source, since a term that a source lacks has one and the same probability there.

Probabilities are whole billionths, ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, and a term adds ``floor((p - q)**2 / q)`` to the divergence of a
source with ``p`` from one with ``q``; all arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .tokens import text_of

#: A term stays where it is in so many documents of its language.
LEAST_DOCS = 3
#: Terms that a source uses more than its language are listed up to this rank.
TOP_TERMS = 200
#: A partition hands on its stripes when they hold so many counts, or so many bytes of terms.
HELD_COUNTS = 400_000
HELD_BYTES = 64 << 20
#: Pairs of counts compared at once.
HELD_PAIRS = 1 << 20

_UNIT = 10**9
#: A-Z in lower case, other letters and all bytes from 0x80 on as they are, the rest to spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII in UTF-8 bytes, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (``lang``, ``source``, ``text``) as stripes: ``lang``, ``term``, ``cells`` of (source, documents, occurrences)."""
    held: dict = {}
    counts = size = 0
    for batch in batches:
        for lang, source, value in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            own = held.setdefault(lang, {})
            for term, n in Counter(terms_of(text_of(value).encode())).items():
                stripe = own.get(term)
                if stripe is None:
                    own[term] = {source: [1, n]}
                    counts += 1
                    size += len(term)
                elif source in stripe:
                    cell = stripe[source]
                    cell[0] += 1
                    cell[1] += n
                else:
                    stripe[source] = [1, n]
                    counts += 1
            if counts >= HELD_COUNTS or size >= HELD_BYTES:
                yield from _handed_on(held)
                held, counts, size = {}, 0, 0
    yield from _handed_on(held)


def _handed_on(held: dict, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for lang, own in held.items():
        terms = list(own)
        for k in range(0, len(terms), rows):
            part = terms[k : k + rows]
            cells = [(s, d, n) for t in part for s, (d, n) in own[t].items()]
            edges = np.r_[0, np.cumsum([len(own[t]) for t in part])].astype(np.int32)
            source, docs, n = zip(*cells, strict=True)
            packed = pa.StructArray.from_arrays([pa.array(source, pa.string()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], ["source", "docs", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([t.decode() for t in part], pa.string()), pa.ListArray.from_arrays(pa.array(edges), packed)], names=["lang", "term", "cells"])


def stripes_of(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang``, ``term``, ``total``, ``cells`` (array of ``source``, ``n``): merged stripes of the terms in at least ``least_docs`` documents of a language.

    Null texts, languages and sources are empty strings; every row is a document, repeated ones too. One shuffle, of the partitions' stripes: a
    term comes once from each fold of a partition, so no term is hot. A stripe is as long as its language has sources.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    folded = named.mapInArrow(_stripes, "lang string, term string, cells array<struct<source: string, docs: long, n: long>>")
    cells = folded.repartition("lang", "term").select("lang", "term", F.inline("cells")).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    merged = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return merged.where(F.col("docs") >= least_docs).drop("docs")


def _p(count, n, v):
    """Billionths by column expressions; decimals, so that no count is too large."""
    return F.expr(f"1 + (({count} + 1) * CAST({_UNIT} AS DECIMAL(10, 0))) div ({n} + {v})")


def _f(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def group_sizes(docs: DataFrame, stripes: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``n``, ``n_lang``, ``v``, ``p0`` (probability of a term that the group lacks): every group of ``docs``, those without terms too."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = stripes.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    own = stripes.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n"])
    return every.withColumn("p0", F.when(F.col("v") > 0, _p("0", "n", "v")))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes as (lang, source, item, value): for each two sources of a stripe, what their terms add beyond terms that one or both lack."""
    held: Counter = Counter()

    def handed_on():
        keys = list(held)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(list(held.values()), pa.int64())], names=["lang", "source", "item", "value"])

    for batch in batches:
        lists = batch.column("cells")
        cells, edges = lists.flatten(), np.diff(lists.offsets.to_numpy())
        source = cells.field("source").dictionary_encode()
        names, who = source.dictionary.to_pylist(), source.indices.to_numpy()
        p, p0 = (cells.field(c).to_numpy() for c in ("p", "p0"))
        start = np.cumsum(edges) - edges
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            for k in np.unique(edges[langs == lang]).tolist():
                at = start[(langs == lang) & (edges == k)]
                # stripes of one length side by side, each source of a stripe against all of it
                step = max(1, HELD_PAIRS // k)
                for row in range(0, len(at), step):
                    index = at[row : row + step, None] + np.arange(k)
                    for a in range(k):
                        one = index[:, a, None]
                        value = _rest(p[one], p0[one], p[index], p0[index])
                        code = who[one] * len(names) + who[index]
                        pairs, place = np.unique(code.ravel(), return_inverse=True)
                        sums = np.zeros(len(pairs), np.int64)
                        np.add.at(sums, place, value.ravel())
                        for c, x in zip(pairs.tolist(), sums.tolist(), strict=True):
                            if c // len(names) != c % len(names):
                                held[lang, names[c // len(names)], names[c % len(names)]] += x
                if len(held) >= HELD_COUNTS:
                    yield handed_on()
                    held.clear()
    yield handed_on()


def _rest(p, p0, q, q0):
    def f(x, y):
        return (x - y) ** 2 // y

    return f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: each other source of the language with the divergence of the group from it, all of them (0 where no term is kept). Part ``term``: terms
    that the group uses more than its language, by what they add to its divergence from that, up to rank ``top``. Ranks go by value, larger first,
    then by item. A language of one source has no pairs, a group without terms no terms; an empty table gives an empty one. Columns other than
    ``text``, ``lang`` and ``source`` are not read.
    """
    stripes = stored(stripes_of(docs, least_docs), "stripes")
    groups = stored(group_sizes(docs, stripes), "groups")
    flat = stripes.select("lang", "term", "total", F.inline("cells")).join(groups.select("lang", "source", F.col("n").alias("n_own"), "n_lang", "v", "p0"), ["lang", "source"])
    flat = flat.withColumn("p", _p("n", "n_own", "v"))

    ahead = flat.withColumn("q", _p("total", "n_lang", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    both = flat.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cells"))
    shared = both.where(F.size("cells") > 1).select("lang", "cells").mapInArrow(_pair_sums, "lang string, source string, item string, value long")

    one, two = (groups.select("lang", F.col("source").alias(s), F.col("p0").alias(z)) for s, z in (("source", "a0"), ("item", "b0")))
    pairs = one.join(two, "lang").where("source != item")
    base = pairs.join(groups.select("lang", "source", "v"), ["lang", "source"])
    base = base.select("lang", "source", "item", F.expr(f"coalesce(v * {_f('a0', 'b0')}, 0L)").alias("value"))
    counts = stored(flat.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "counts")
    ours = counts.join(pairs, ["lang", "source"]).select("lang", "source", "item", F.expr(f"terms * ({_f('p', 'b0')} - {_f('a0', 'b0')})").alias("value"))
    theirs = counts.withColumnRenamed("source", "item").join(pairs, ["lang", "item"]).select("lang", "source", "item", F.expr(f"terms * ({_f('a0', 'p')} - {_f('a0', 'b0')})").alias("value"))
    parts = base.unionByName(ours).unionByName(theirs).unionByName(shared)
    summed = parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(terms)


def op12_query(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """The same rows, each term of each two sources by itself."""
    p = f"1 + ({_UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT x.lang, count(kept.term) AS v, coalesce(sum(total), 0) AS n FROM (SELECT DISTINCT lang FROM d) x LEFT JOIN kept USING (lang) GROUP BY x.lang),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY x.lang, x.source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {p} AS p, 1 + ({_UNIT}::HUGEINT * (kept.total + 1)) // (l.n + l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
listed AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM listed
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP_TERMS}
"""
