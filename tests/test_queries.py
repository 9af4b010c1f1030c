"""Every registered query of the array engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom import catalogue

DIR = "/root/testdata/sf0.001"
#: A few of each kind; the driver compares them all.
SOME = ["box_read", "stack_channels", "threshold", "gaussian", "dilate", "downsample_mode", "contacts", "spots", "overlap_tent", "warp_field", "track_step", "tile_overlaps", "pipeline_box", "demand_order", "lattice_noise", "synthetic_noise", "synthetic_blobs", "synthetic_shells", "synthetic_julia", "net_field", "fuse_tiles"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(catalogue.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert order(got).equals(order(want))


def test_entry(spark):
    assert entry.entry(spark).count() == 50 * 24
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_nearest_points_takes_all_orders(spark):
    o = spark.read.parquet(f"{DIR}/orders.parquet").toPandas()
    got = catalogue.QUERIES["nearest_points"](spark, DIR).toPandas()
    assert set(got.id) == set(o.o_orderkey)


def test_a_field_is_undone(spark):
    got = catalogue.QUERIES["inverse_field"](spark, DIR).toPandas()
    assert len(got) == 64 * (1 + spark.read.parquet(f"{DIR}/embeddings.parquet").agg({"vec_id": "max"}).first()[0])
    assert got.v.between(0, 0.01).all()


def test_stream_agrees_with_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.streaming import demand

    rows = [(1, "a", 2, "ask", "u"), (2, "b", 0, "ask", "u"), (3, "a", 1, "ask", "v"), (4, "b", 0, "cancel", "u"), (5, "a", 2, "cancel", "u"), (6, "c", 3, "ask", "w")]
    df = spark.createDataFrame(rows, "seq long, key string, level long, kind string, claim string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = demand.wanted(stream).writeStream.outputMode("update").format("memory").queryName("demand_now").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("demand_now").where("claims > 0").select("key", "level", "seq", "claims").collect()}
    assert got == {tuple(r) for r in demand.wanted_now(df).select("key", "level", "seq", F.col("claims")).collect()}
