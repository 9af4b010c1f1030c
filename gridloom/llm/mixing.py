"""Mixing sources to target weights by entropy balancing.

Rates ``r`` of documents that differ least from 1 in entropy while each source's words meet a target solve
``r = min(most, exp(lambda_source * size / mean size))``: exponential tilts whose multipliers are the convex dual's. Newton steps
need two sums for each source, which Spark takes over a table of (source, size, number of documents). Rates are then
rounded to whole copies so that each source's error stays below a small document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .common import hashable, n_words_of, quoted, stored

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
STEPS = 60
#: Documents rounded in one task, at most about.
ROUNDED = 2_000


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``docs``, ``target``: weights repeat over sources by code point, null last.

    Targets share the total by weight, stop at ``most`` times their source's size, and the excess is shared again until
    none is above. ``sources`` has a row for each source.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__n") % len(weights) + 1).cast("int"))
    out = sources.withColumn("__n", order).withColumn("__w", weight).drop("__n").withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    # a source is full if its cap per weight is at most the level that the others then share: fill by that order
    by = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    out = out.withColumns({"__total": F.sum("source_size").over(whole), "__all": F.sum("__w").over(whole)})
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"__used": F.coalesce(F.sum("__cap").over(past), F.lit(0.0)), "__gone": F.coalesce(F.sum("__w").over(past), F.lit(0.0))})
    level = (F.col("__total") - F.col("__used")) / (F.col("__all") - F.col("__gone"))
    out = out.withColumn("__open", level < F.col("__cap") / F.col("__w"))
    out = out.withColumn("__level", F.min(F.when(F.col("__open"), F.struct(F.col("__gone").alias("g"), level.alias("level")))).over(whole)["level"])
    target = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("__w")))
    return out.select("source", "source_size", "docs", target.cast("double").alias("target"))


def _rate(tilt: Column, size: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * size, F.lit(50.0))))


def tilts(sizes: DataFrame, aims: DataFrame, most: float = MOST, steps: int = STEPS, near: float = 1e-5) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``tilt``: the dual's multipliers, per word.

    Each step is one aggregation over the histogram ``sizes`` (``source``, ``size``, ``n``). The dual is separable, so a source's
    Newton step stands alone; it is kept within the bracket that its earlier steps left, halving that where it would
    leave it. A source whose target is all of its capped words gets an infinite tilt (null here: all at most).
    """
    state = aims.withColumns({"mean": F.col("source_size") / F.col("docs"), "tilt": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "gap": F.lit(None).cast("double")})
    state = state.withColumn("full", F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-9)))
    state = stored(state, "tilts")
    for step in range(steps):
        if state.where("not full and mean > 0 and (gap is null or gap > %r)" % near).isEmpty():
            break
        rows = sizes.join(state.select("source", "tilt", "mean"), sizes["source"].eqNullSafe(state["source"])).select(sizes["source"], "size", "n", "tilt", "mean")
        scaled = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), scaled, most)
        free = F.when(rate < most, rate).otherwise(0.0)
        sums = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("taken"), F.sum(F.col("n") * F.col("size") * scaled * free).alias("slope"))
        sums = sums.withColumnRenamed("source", "__s")
        next_ = state.join(sums, state["source"].eqNullSafe(sums["__s"]), "left").drop("__s")
        off = F.col("target") - F.col("taken")
        low = F.when(off >= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off < 0, F.col("tilt")).otherwise(F.col("high"))
        next_ = next_.withColumns({"low": low, "high": high, "gap": F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))})
        newton = F.col("tilt") + off / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton > F.coalesce("low", newton - 1)) & (newton < F.coalesce("high", newton + 1)) & (F.abs(newton - F.col("tilt")) < 20)
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.col("low") * 2 + 1, F.col("high") * 2 - 1)
        moved = F.when(F.col("gap") <= near, F.col("tilt")).when(inside, newton).otherwise(middle)
        state = stored(next_.withColumn("tilt", F.coalesce(moved, F.col("tilt"))).drop("taken", "slope"), "tilts")
    return state.select("source", "source_size", "target", F.when(~F.col("full"), F.round("tilt", 9) / F.nullif(F.col("mean"), F.lit(0.0))).alias("tilt"), "full", "docs")


def _copies(most: int):
    """Whole copies for rows that come share by share, from long to short: the number that leaves least words owed,
    within one of the rate's neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, owed = None, 0.0
        for batch in batches:
            out = []
            for source, part, size, rate in zip(*(batch.column(c).to_pylist() for c in ("source", "share", "size", "rate")), strict=True):
                if (source, part) != share:
                    share, owed = (source, part), 0.0
                owed += size * rate
                least, most_ = max(0, math.floor(rate) - 1), min(most, math.ceil(rate) + 1)
                out.append(min(max(math.floor(owed / size + 0.5) if size else 1, least), most_))
                owed -= size * out[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(out, pa.int64())], names=[*_KEPT, "copies"])

    return run


_KEPT = ("row", "size", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``row`` (the input row), ``size``, ``source_size``, ``target``, ``copies`` (0 to ``most``) per input row.

    A null text has size 0; null is a source of its own, the last; sources without words have target 0. Equal
    tables give equal results however they are parted: rounding goes by size, id and row content. Further columns
    ride along in ``row``; an empty table gives an empty one.
    """
    whole = F.struct(*[quoted(c) for c in docs.columns if c.lower() != "text"])
    content = hashable(docs)
    rows = stored(docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"), F.xxhash64(*content).alias("content")), "sizes")
    sizes = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    state = tilts(sizes, targets(sources, weights, most), most)
    named = state.withColumnRenamed("source", "__s")
    rated = rows.join(named, rows["source"].eqNullSafe(named["__s"])).drop("__s")
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(_rate(F.coalesce("tilt", F.lit(0.0)), F.col("size"), most))
    rated = rated.withColumns({"rate": rate, "share": F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1), F.ceil(F.col("docs") / ROUNDED)))})
    dealt = rated.repartition("source", "share").sortWithinPartitions("source", "share", F.desc("size"), "doc_id", "content")
    out = StructType([rows.schema["row"], *StructType.fromDDL("size long, source_size long, target double, copies long")])
    return dealt.select(*_KEPT, "source", "share", "rate").mapInArrow(_copies(most), out)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as they were."""
    with_text = docs.select(F.struct(*map(quoted, docs.columns)).alias("whole"), "doc_id", "source", "text")
    taken = mix(with_text, weights, most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.whole.*")
