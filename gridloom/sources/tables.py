"""Arrays gridded from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..grid import Grid
from ..meta import ArrayMeta

HOURS = 720
LANES = 32
TYPES = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_image(spark: SparkSession, sf_dir: str) -> Grid:
    """(y, x): a line a vector, a column a component."""
    t = _table(spark, sf_dir, "embeddings")
    rows = t.agg(F.max("vec_id")).first()[0]
    df = t.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    return Grid(df, ArrayMeta(("y", "x"), (int(rows) + 1, 64), "float64", (128, 64)))


def dense(points: DataFrame, axes: dict[str, int]) -> DataFrame:
    """Sums of ``v`` by coordinate, with 0 where there is nothing: one aggregation over points and an empty grid.

    The empty grid is a range, whose rows are keyed arithmetically, so that nothing is joined.
    """
    n = 1
    for size in axes.values():
        n *= size
    cell, step, coords = F.col("id"), n, []
    for axis, size in axes.items():
        step //= size
        coords.append((F.floor(cell / step) % size).cast("long").alias(axis))
    empty = points.sparkSession.range(n).select(*coords, F.lit(0.0).alias("v"))
    return points.select(*axes, "v").unionByName(empty).groupBy(*axes).agg(F.sum("v").alias("v"))


def _hour() -> Column:
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - F.lit(1704067200)) / 3600).cast("long")


def event_raster(spark: SparkSession, sf_dir: str) -> Grid:
    """(t, x): values summed by hour since the start of 2024 and by user modulo 32."""
    t = _table(spark, sf_dir, "events").select(_hour().alias("t"), (F.col("user_id") % LANES).alias("x"), F.round("value", 4).alias("v"))
    t = t.where((F.col("t") >= 0) & (F.col("t") < HOURS))
    return Grid(dense(t, {"t": HOURS, "x": LANES}), ArrayMeta(("t", "x"), (HOURS, LANES), "float64", (64, 32)))


def event_channels(spark: SparkSession, sf_dir: str) -> Grid:
    """(c, y, x): the event raster of each event type (y the hour), types in order of name."""
    t = _table(spark, sf_dir, "events")
    names = [r[0] for r in t.select("event_type").distinct().orderBy("event_type").collect()]
    c = F.array_position(F.array(*map(F.lit, names)), F.col("event_type")) - 1
    rows = t.select(c.cast("long").alias("c"), _hour().alias("y"), (F.col("user_id") % LANES).alias("x"), F.round("value", 4).alias("v"))
    rows = rows.where((F.col("y") >= 0) & (F.col("y") < HOURS))
    return Grid(dense(rows, {"c": len(names), "y": HOURS, "x": LANES}), ArrayMeta(("c", "y", "x"), (len(names), HOURS, LANES), "float64", (1, 64, 32)))


def shipping_volume(spark: SparkSession, sf_dir: str) -> Grid:
    """(z, y, x): quantities summed by line number, supplier (modulo 100) and month of shipping since 1995."""
    t = _table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    rows = t.select((F.col("l_linenumber") - 1).cast("long").alias("z"), (F.col("l_suppkey") % 100).alias("y"), month.cast("long").alias("x"), F.col("l_quantity").alias("v"))
    rows = rows.where((F.col("x") >= 0) & (F.col("x") < 84) & (F.col("z") >= 0) & (F.col("z") < 7))
    return Grid(dense(rows, {"z": 7, "y": 100, "x": 84}), ArrayMeta(("z", "y", "x"), (7, 100, 84), "float64", (7, 25, 28)))
