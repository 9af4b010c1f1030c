"""Stages on tables with odd columns, and what NN-descent's audit and first lists are worth."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.llm import mixing, nn_descent, quality_rules, simhash_dedup, suffix_dedup

ODD = "doc_id long, text string, lang string, source string, n_chars long, __h1 long, h1 string, `my col` string, `a``b` double, m map<string,int>, deep struct<`x y`: map<string,array<int>>>, copy int, copies int, whole string, row string, k long, th int, fp long, `group` int, size long, share int"


def odd_docs(spark):
    prose = [" ".join(f"{'abcdefgh'[j % 8]}word{'klmnopqr'[(i * 7 + j * j) % 8]}{'stuvwxyz'[(i + j) % 7]} {('the', 'of', 'and', 'to')[j % 4]}" for j in range(80 + i)) + '.' for i in range(12)]
    shared = " ".join(f"passage{j}" for j in range(60))
    texts = [*prose, prose[3], prose[3], f"{prose[5]} {shared}", f"{prose[6][:400]} {shared} tail words here", None, ""]

    def row(doc_id, t, i):
        return (doc_id, t, "en", f"s{i % 3}", len(t or ""), 1000 + i, f"h{i}", f"c{i}", i / 2, {"a": i}, ({"k": [i]},), i, -i, "w", "r", 5, 6, 7, 8, 9, 10)

    return spark.createDataFrame([row(i, t, i) for i, t in enumerate(texts)] + [row(None, prose[7], 99), row(3, prose[3], 3)], ODD)


def test_stages_leave_odd_columns_alone(spark):
    docs = odd_docs(spark)
    rows = {(r["__h1"], r["doc_id"]): r for r in docs.where("doc_id is not null").collect()}
    outs = {
        "rules": quality_rules.keep_good(docs),
        "simhash": simhash_dedup.keep_one_per_group(docs),
        "suffix": suffix_dedup.without_repeats(docs),
        "mixing": mixing.mixed_documents(docs),
    }
    for name, out in outs.items():
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = out.collect()
        assert got, name
        for r in got:
            if r["doc_id"] is not None:
                want = rows[r["__h1"], r["doc_id"]]
                assert all(a == b for c, a, b in zip(docs.columns, r, want, strict=True) if c != "text"), name
                assert r["text"] == want["text"] or name == "suffix"
    kept = [r["doc_id"] for r in outs["simhash"].collect()]
    assert kept.count(3) == 1 and not {12, 13} & set(kept) and len([i for i in kept if i in (16, 17)]) == 1
    assert outs["suffix"].count() == docs.count()
    cut = {r["doc_id"]: r["text"] for r in outs["suffix"].collect()}
    assert "passage5 " not in cut[14] and "passage5 " not in cut[15] and "tail words here" in cut[15]


def test_rows_that_differ_in_a_map_only_are_not_equal(spark):
    docs = spark.createDataFrame([(1, "x y z", {"a": 1}), (1, "x y z", {"a": 2}), (None, "other words", {}), (None, "other words", None)], "doc_id long, text string, m map<string,int>")
    assert simhash_dedup.keep_one_per_group(docs).count() == 2


def near_pairs(n, pairs, low=0.88, seed=1, d=64):
    """Random directions, the first ``2 * pairs`` of them in pairs at cosines from ``low`` to 0.99."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.arange(pairs), np.arange(pairs) + pairs
    aside = rng.normal(size=(pairs, d))
    aside -= (aside * x[a]).sum(1, keepdims=True) * x[a]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    c = rng.uniform(low, 0.99, pairs)[:, None]
    x[b] = c * x[a] + np.sqrt(1 - c * c) * aside
    return x


def as_table(spark, path, x, names=("vec_id", "embedding")):
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    pq.write_table(pa.table(dict(zip(names, (pa.array(np.arange(len(x))), flat), strict=True))), path, row_group_size=max(1, len(x) // 8))
    return spark.read.parquet(f"file://{path}")


def test_links_of_many_random_vectors_are_found(spark, tmp_path):
    """40,000 vectors, 300 planted pairs: recall of links by brute force at least 0.99."""
    x = near_pairs(40_000, 300).astype(np.float32)
    got = nn_descent.near_duplicates(as_table(spark, tmp_path / "e.parquet", x)).toPandas().set_index("vec_id").n_links.sort_index().to_numpy()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[i : i + 2000] @ u.T >= 0.9).sum(1) - 1 for i in range(0, len(u), 2000)])
    assert want.sum() > 400 and got.sum() >= 0.99 * want.sum() and (got <= want).all()


def test_the_audit_sees_what_is_missing(spark, tmp_path):
    """100,000 vectors with 400 links, of which the components hold exactly half."""
    x = near_pairs(100_000, 400, low=0.92, seed=2)
    nodes = as_table(spark, tmp_path / "n.parquet", x, ("id", "v"))
    half = pd.DataFrame({"node": np.r_[np.arange(200), np.arange(200) + 400], "component": np.r_[np.arange(200), np.arange(200)]})
    got = nn_descent.audited(nodes, spark.createDataFrame(half), 0.9)
    assert abs(got.recall - 0.5) < 0.1 and got.at_least <= got.recall and got.seen
    whole = pd.DataFrame({"node": np.arange(800), "component": np.r_[np.arange(400), np.arange(400)]})
    got = nn_descent.audited(nodes, spark.createDataFrame(whole), 0.9)
    assert got.recall == 1 and 0.9 < got.at_least < 1


def test_no_link_seen_is_not_perfect(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    none = spark.createDataFrame([], "node long, component long")
    assert nn_descent.audited(nodes, none, 0.9) == (1.0, 1.0, False)  # all were asked
    assert nn_descent.audited(nodes, none, 0.9, queries=50, loose=100) == (1.0, 0.0, False)


def test_orders_grow_slowly():
    got = [nn_descent.orders_for(10**k) for k in range(2, 10)]
    assert got == sorted(got) and got[0] >= 2 and 10 <= got[3] <= 20 and got[-1] < 110


def test_first_lists_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 8)))], "id long, v array<double>")
    found = [{(r["a"], r["b"]) for r in nn_descent.first_lists(df, 4, 3000, orders=2).collect()} for df in (nodes.coalesce(1), nodes.repartition(13))]
    assert found[0] == found[1] and len(found[0]) > 3000 * 4


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    rows = [(i, [1.0, 0.1 * i]) for i in range(n)]
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r["n_links"] for r in got) == [max(0, n - 1)] * n
