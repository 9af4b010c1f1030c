"""Training-data operators against brute force, on small fixtures with nulls, ties, repeats and clashing names."""

import hashlib
import html
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.functions.components import connected_components
from gridloom.llm import html_extract, license_scan, mixing, nn_descent, packing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup, token_counts, tokens
from gridloom.llm.suffix_sort import common_prefixes, repeated_starts, suffix_array
from gridloom.llm.tokens import default_tokenizer, encoder

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(30)]
    copies = [prose[3], prose[4] + " more", "start " + prose[4], prose[5][:200] + prose[6][:300] + prose[5][200:]]
    return [*prose, *copies, None, "", " \n\t ", "one", "a b c", prose[3].upper(), "x" * 900, "ab" * 300]


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 340)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = components(pairs, {n for p in pairs for n in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(2, 5))
        s = np.r_[rng.integers(1, k + 1, rng.integers(1, 70)), 0].astype(np.int16)
        sa, b = suffix_array(s, k + 1), s.tolist()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sa.tolist() == want
        length, before = common_prefixes(s, sa, 1000)
        for i, j in zip(want[1:], want, strict=False):
            n = next(n for n in range(len(b)) if b[i + n] != b[j + n])
            assert length[i] == n and before[i] == j
    for _ in range(60):
        parts = [rng.integers(0, 2, rng.integers(0, 60)).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        seen = Counter(p[i : i + 7].tobytes() for p in parts for i in range(len(p) - 6))
        for p, got in zip(parts, repeated_starts(parts, 7), strict=True):
            assert got.tolist() == [i for i in range(len(p) - 6) if seen[p[i : i + 7].tobytes()] > 1]


@pytest.mark.parametrize("large", [1000, 1])
def test_suffix_dedup_is_brute_force(spark, texts, large):
    span = 60
    df = docs_of(spark, texts)
    df = df.unionByName(df.where("doc_id = 7"))  # a repeated row
    out = suffix_dedup.remove_repeats(df, span, large=large, shard_bytes=2000).select("row.doc_id", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    every = [(i, (t or "").encode()) for i, t in enumerate(texts)] + [(7, texts[7].encode())]
    seen = Counter(b[k : k + span] for _, b in every for k in range(len(b) - span + 1))
    want = []
    for i, b in every:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    assert sorted(map(tuple, out)) == sorted(want)


def without_passages(texts, span):
    """Each text without the words under ``span`` words in a row that start twice, and without the white space after them."""
    parts = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    seen = Counter(tuple(m[0] for m in w[k : k + span]) for w in parts for k in range(len(w) - span + 1))
    out = []
    for t, w in zip(texts, parts, strict=True):
        gone = {k + j for k in range(len(w) - span + 1) if seen[tuple(m[0] for m in w[k : k + span])] > 1 for j in range(span)}
        ends = [m.start() for m in w[1:]] + [len(t or "")] * bool(w)
        out.append((t or "")[: w[0].start() if w else None] + "".join((t or "")[m.start() : e] for k, (m, e) in enumerate(zip(w, ends, strict=True)) if k not in gone))
    return out


@pytest.mark.parametrize("large", [1000, 1])
def test_passages_are_brute_force(spark, texts, large):
    span = 12
    long = texts[10] + " é" * 30 + "\n" + " ".join(f"w{i}" for i in range(4000))
    odd = [*texts, re.sub(" ", "\n  ", texts[8] or ""), "  " + texts[8], "a b " * 40, long, "x " + long[:-3]]
    rows = suffix_dedup.remove_repeats(docs_of(spark, odd), span, large=large, shard_bytes=2000, words=True).select("row.doc_id", "n_removed", "kept").collect()
    want = without_passages(odd, span)
    for r in rows:
        assert bytes(r["kept"]).decode() == want[r["doc_id"]]
        assert r["n_removed"] == len((odd[r["doc_id"]] or "").encode()) - len(want[r["doc_id"]].encode())
    assert len(rows) == len(odd) and sum(r["n_removed"] > 0 for r in rows) > 8


def test_parts_of_a_long_text_are_one_text(spark, texts, monkeypatch):
    long = " ".join(t for t in texts[:30] if t)
    rows = [long, texts[4], long[900:2500]]
    want = suffix_dedup.remove_repeats(docs_of(spark, rows), 60).select("row.doc_id", "n_removed", "n_spans", "kept").collect()
    runs = {}
    for part in (64, 1 << 22):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        batch = pa.RecordBatch.from_pydict({"k": pa.array([1, 2]), "th": pa.array([0, 0], pa.int32()), "text": pa.array([long.encode(), b"x"])})
        out = pa.Table.from_batches(suffix_dedup._runs(60, 32, np.uint8)(iter([batch])))
        runs[part] = sorted((c, (p >> 32) + k) for c, p in zip(out["cls"].to_pylist(), out["place"].to_pylist(), strict=True) for k in range((p >> 16 & 65535) + 1))
    assert runs[64] == runs[1 << 22]
    seen = Counter(x[k : k + 60] for x in map(str.encode, rows) for k in range(len(x) - 59))
    for r in want:
        b = rows[r["doc_id"]].encode()
        gone = {k + j for k in range(len(b) - 59) if seen[b[k : k + 60]] > 1 for j in range(60)}
        assert bytes(r["kept"]) == bytes(x for k, x in enumerate(b) if k not in gone)


def most_python_in_a_task(node):
    """Of a physical plan: Python nodes of the stage that ends with ``node``, and the most in any stage."""
    below = [most_python_in_a_task(node.children().apply(i)) for i in range(node.children().size())]
    own = ("InArrow" in node.nodeName()) + sum(x[0] for x in below)
    most = max([own, *(x[1] for x in below)])
    return (0 if "Exchange" in node.nodeName() else own), most


def test_passages_take_one_python_process_a_task(spark, texts, monkeypatch):
    seen = []

    def watched(df):
        plan = df._jdf.queryExecution().executedPlan()
        seen.append(most_python_in_a_task(plan.initialPlan() if "Adaptive" in plan.nodeName() else plan)[1])
        return df

    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name, keep=suffix_dedup.stored: keep(watched(df), name))
    watched(suffix_dedup.without_repeats(docs_of(spark, texts), 12))
    assert max(seen) == 1 and len(seen) > 3


@pytest.mark.parametrize("helper", [suffix_dedup._as_words, suffix_dedup._kept(False), suffix_dedup._kept(True)])
def test_texts_leave_python_in_slices(helper):
    rows = [(b"some words %d " % i) * 2000 for i in range(60)] + [b"", b"x" * 2 * suffix_dedup.CHUNK]
    ranges = pa.array([None] * len(rows), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
    n = pa.array(range(len(rows)))
    batch = pa.RecordBatch.from_arrays([n, n, n, pa.array(rows), ranges], names=["row", "k", "th", "text", "ranges"])
    out = list(helper(iter([batch])))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(len(rows)))
    assert len(out) > 6 and all(len(b) == 1 or b.nbytes < 3 * suffix_dedup.CHUNK for b in out)


def test_sorting_one_letter_is_quick():
    at = time.time()
    assert len(repeated_starts([np.full(200_000, 97, np.uint8)], 400)[0]) == 200_000 - 399
    assert time.time() - at < 20


def test_suffix_dedup_keeps_columns_and_takes_nothing(spark):
    df = spark.createDataFrame([], SCHEMA + ", kept int, th string")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == 0


def test_simhash_is_brute_force(spark, texts):
    df = docs_of(spark, texts)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash_dedup.simhash_components(df).collect()}
    fps = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(pairs, fps)
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_one_of_each_group_stays_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, b), (2, c), (2, c), (2, d), (3, c), (None, a.upper()), (5, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    kept = simhash_dedup.keep_one_per_group(df)
    got = [(r["doc_id"], r["text"][:1] if r["text"] else r["text"]) for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(got, key=str) == sorted([(None, "a"), (1, "b"), (2, "c"), (2, "d"), (5, None)], key=str)
    of = {(r["fp"], r["component_id"]) for r in simhash_dedup.simhash_components(df.where("doc_id = 2")).collect()}
    assert len(of) == 2


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components([(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4], signed)
    for large in (1500, 40, 3):
        links = simhash_dedup.fingerprint_links(nodes, 4, large).collect()
        assert components([(r["a"], r["b"]) for r in links], signed) == want


def test_simhash_of_odd_rows(spark):
    odd = "a\u00a0b C\x1cd \udc80".encode("utf-8", "surrogatepass")
    frame = spark.createDataFrame([(1, bytearray(odd)), (1, bytearray(odd)), (2, None), (3, bytearray(b""))], "doc_id long, raw binary")
    frame = frame.select("doc_id", F.col("raw").cast("string").alias("text"), F.lit(1).alias("fp"), F.lit("x").alias("bucket"))
    rows = simhash_dedup.simhash_components(frame).collect()
    words = odd.lower().split()
    whole = xxhash.xxh64_intdigest(b" ".join(words), 42)
    assert sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == [(1, whole, 1), (1, whole, 1), (2, 0, 2), (3, 0, 2)]
    assert simhash_dedup.simhash_components(docs_of(spark, [])).count() == 0


def test_packing_places_every_piece_once(spark, texts):
    df = docs_of(spark, [*texts, " ".join(f"w{i}" for i in range(3000))])
    rows = packing.pack_documents(df, 64, ids=True).toPandas()
    whole = Tokenizer.from_file(default_tokenizer())
    whole.encode_special_tokens = True
    for i, t in enumerate([*texts, " ".join(f"w{i}" for i in range(3000))]):
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert [x for ids in mine.ids for x in ids] == whole.encode(t or "", add_special_tokens=False).ids + [0]
        assert mine.piece.tolist() == list(range(len(mine))) and (mine.length.iloc[1:] == 64).all()
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert rows.sequence_id.nunique() <= 1.06 * np.ceil(rows.length.sum() / 64)


def test_packing_splits_at_added_tokens(spark):
    odd = ["<|endoftext|>", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|>é <|endoftext", "plain"]
    rows = packing.pack_documents(docs_of(spark, odd), 64, ids=True).toPandas()
    plain = Tokenizer.from_file(default_tokenizer())
    for i, t in enumerate(odd):
        assert [x for ids in rows[rows.doc_id == i].sort_values("piece").ids for x in ids] == plain.encode(t, add_special_tokens=False).ids + [0]


def test_packing_is_near_its_bound():
    h = Counter((np.random.default_rng(1).lognormal(6, 1, 20000).astype(int) % 2048 + 1).tolist())
    made = packing.sequences(h, 2048)
    got = Counter()
    for c, n in made:
        assert sum(a * b for a, b in c) <= 2048
        for a, b in c:
            got[a] += b * n
    assert got == h and sum(n for _, n in made) <= 1.002 * sum(a * b for a, b in h.items()) / 2048 + 1


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 200))) for _ in range(400)] + [None]
    sources = [rng.choice(["a", "b", "é", "B", None]) for _ in texts]
    out = mixing.mix(docs_of(spark, texts, sources)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").toPandas()
    assert len(out) == 401 and out.copies.between(0, 3).all()
    size = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight, open_, left = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, set(order), sum(size.values())
    target = {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    out["source"] = out["source"].where(out["source"].notna(), None)
    for s in order:
        own = out[out.source.isna()] if s is None else out[out.source == s]
        assert abs(own.target.iloc[0] - target[s]) < 1e-6 * target[s] and own.source_size.iloc[0] == size[s]
        assert abs((own["size"] * own.copies).sum() - target[s]) <= 0.01 * target[s] + 20


def test_mixing_gives_the_same_however_rows_are_parted(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(40), " ".join(["w"] * rng.randint(0, 9)) + rng.choice("xyz "), "en", rng.choice(["a", "b", None]), rng.randrange(3)) for _ in range(600)]
    first = None
    for n in (1, 5):
        shuffled = rows[:]
        rng.shuffle(shuffled)
        out = mixing.mix(spark.createDataFrame(shuffled, SCHEMA).repartition(n)).select("row.doc_id", "row.source", "row.n_chars", "size", "copies").collect()
        got = sorted(map(str, out))
        first = first or got
        assert got == first


def test_mixing_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [None, ""])).count() == 2


def test_quality_rules_are_their_sql(spark, texts):
    df = docs_of(spark, [*texts, "the same line of and to\n" * 12, "words " * 40, "THE!! " * 30])
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = quality_rules.score(df.select("doc_id", "text")).drop("text").toPandas()
    want = con.execute(quality_rules.oracle_sql()).df()
    order = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True).astype(str)
    assert order(got).equals(order(want))
    clash = df.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(1))
    assert quality_rules.keep_good(clash).columns == clash.columns
    odd = df.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("__w", "__l", "__bangs", "__rest", "a.b")])
    rows = quality_rules.score(odd)
    assert {tuple(r) for r in rows.select("__w", "__l", "__bangs", "__rest", "`a.b`").collect()} == {(7,) * 5}
    assert {r["doc_id"]: r["kept"] for r in rows.collect()} == dict(zip(got.doc_id, got.kept, strict=True))


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = quality_classifier.classify(docs, labels).toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    m = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.9
    again = quality_classifier.classify(docs.limit(0), labels)
    assert again.count() == 0


def test_token_counts_are_the_tokenizers(spark, texts):
    odd = [*texts, "é\n\n\nx  \n 漢字😀\n", "<|endoftext|>\na"]
    whole = Tokenizer.from_file(default_tokenizer())
    whole.encode_special_tokens = True
    got = token_counts.section_tokens(docs_of(spark, odd)).toPandas()
    for i, t in enumerate(odd):
        t = t or ""
        e = whole.encode(t, add_special_tokens=False)
        assert encoder(default_tokenizer())[0].encode_ordinary(t) == e.ids
        own = got[got.doc_id == i].sort_values("section")
        want = [sum(a <= s < b for s, _ in e.offsets) for a, b in zip(own.start, own.stop, strict=True)]
        assert own.n_tokens.tolist() == want and own.n_tokens.sum() == len(e.ids)
        assert own.stop.iloc[-1] == len(t) and own.start.tolist()[1:] == own.stop.tolist()[:-1]
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs_of(spark, odd), rule="none")
    parts = spark.createDataFrame([(1, "a title", None, "the body")], "doc_id long, t string, u string, b string")
    assert token_counts.field_tokens(parts, ["t", "u", "b"]).count() == 3


def test_tokens_of_long_white_space(spark, monkeypatch):
    plain = Tokenizer.from_file(default_tokenizer())
    long = ["\n" * 1_500_000, "a" + " " * 2_000_000 + "b", " \u3000\t" * 30_000 + "<|endoftext|>" + "\n" * 30_000 + "é"]
    want = [plain.encode(t, add_special_tokens=False) for t in long]
    for t, e in zip(long, want, strict=True):
        assert encoder(default_tokenizer())[0].encode(t) == e.ids
    got = token_counts.section_tokens(docs_of(spark, long), boundary="b", added=True).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(e.ids) for i, e in enumerate(want)}
    rows = packing.pack_documents(docs_of(spark, long)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: len(e.ids) + 1 for i, e in enumerate(want)}
    monkeypatch.setattr(tokens, "_RUN", re.compile(f"[{tokens._WHITE}]{{4,}}"))
    monkeypatch.setattr(tokens, "LONG_RUN", 4)
    rng = random.Random(6)
    alphabet = [*" \n\t\xa0\u3000\x1c\x85abé1!'s", "    ", "\n\n\n\n\n", "<|endoftext|>", "'s"]
    for _ in range(2000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert encoder(default_tokenizer())[0].encode(t) == plain.encode(t, add_special_tokens=False).ids


def test_token_counts_at_added_tokens(spark):
    plain = Tokenizer.from_file(default_tokenizer())
    odd = ["a <|endoftext|> b\né <|endoftext|>\n\n<|endoftext", "<|endoftext|>", ""]
    got = token_counts.section_tokens(docs_of(spark, odd), added=True).toPandas()
    for i, t in enumerate(odd):
        e = plain.encode(t, add_special_tokens=False)
        own = got[got.doc_id == i].sort_values("section")
        assert own.n_tokens.tolist() == [sum(a <= s < b for s, _ in e.offsets) for a, b in zip(own.start, own.stop, strict=True)]
        assert own.n_tokens.sum() == len(e.ids)


def test_license_scan_finds_what_is_planted(spark):
    mit = license_scan.bundled_templates()["MIT"]
    df = docs_of(spark, ["prose " + mit.replace("free of charge", "at no cost") + " end", "Released under the MIT License. And licensed.", "nothing here", None, ""])
    rows = license_scan.scan(df).collect()
    assert [(r["doc_id"], r["license"]) for r in rows] == [(0, "MIT"), (1, "MIT-notice")]
    assert rows[0]["coverage"] > 0.95 and rows[1]["start"] == 0 and rows[1]["stop"] == 30


def test_licenses_with_clauses_put_in_or_left_out():
    words, index = license_scan.index_of(license_scan.bundled_templates())
    mit = license_scan.bundled_templates()["MIT"]
    own = mit.split()
    inserted = " ".join([*own[:80], *(f"added{i}" for i in range(25)), *own[80:]])
    wrapped = "# " + "\n# Copyright holders ".join(" ".join(own[i : i + 40]) for i in range(0, len(own), 40))
    omitted = " ".join([*own[:60], *own[78:]])
    moved = " ".join([*own[:50], *(f"x{i}" for i in range(30)), *own[50:110], *own[122:]])
    for text in (inserted, wrapped, omitted, moved, "İa " * 5 + mit + " İİ", f"{mit} and once more {mit}", mit.upper()):
        found = [m for m in license_scan.matches(text, words, index) if m[0] == "MIT"]
        assert len(found) == 1 + ("once more" in text), text[:40]
        for _, n, size, covered, a, b in found:
            # no alignment of the whole text finds more
            own_words, row = license_scan._words(text[a:b]), [0] * (len(text[a:b]) + 1)
            for t in words["MIT"]:
                row = [0] + [*map(int, row[1:])]
                before = row[:]
                for j, w in enumerate(own_words):
                    row[j + 1] = max(row[j], before[j + 1], before[j] + (w == t))
            assert n == row[len(own_words)] and covered == n / size >= 0.8
            assert text[a:b].split()[0].lower().lstrip("# ").startswith("permission")
    assert not license_scan.matches(" ".join(own[:100]), {"MIT": words["MIT"]}, {g: [x for x in v if x[0] == "MIT"] for g, v in index.items()})
    assert license_scan.matches("", words, index) == []
    at = time.time()
    assert len(license_scan.matches("Released under the MIT License.\n" * 20_000, words, index)) == 20_000
    assert time.time() - at < 30


def test_every_bundled_license_finds_itself(spark):
    texts = list(license_scan.bundled_templates().items())
    rows = license_scan.scan(docs_of(spark, [t for _, t in texts] + ["tied " + texts[0][1]] * 2)).collect()
    assert {(r["doc_id"], r["license"]) for r in rows if r["coverage"] == 1} >= {(i, n) for i, (n, _) in enumerate(texts)}
    assert sum(r["license"] == "MIT" for r in rows) == 3
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def test_html_keeps_the_article(spark):
    def page(i, body, extra=""):
        return f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><nav><ul><li>menu {i}</ul></nav>{extra}{body}<aside>side {i}</aside><footer>foot {i}</footer></body></html>"

    rows = [(i, "http://a.b/x", page(i, f"<article><h1>Head {i}</h1><p>One &amp;  two {i}<br>three<p><b>Four</b> {i}<section class='comments'><p>Nice {i}</section></article>")) for i in range(6)]
    rows += [(10 + i, "http://c.d/y", page(i, f"<div class='cookie-notice'>We use cookies</div><div id='content'><p>Plain {i} text that is long enough to be the main part.</p><p>More {i}</p></div><form><p>Send</p></form>")) for i in range(6)]
    rows += [(20, None, None), (21, "http://e.f", ""), (22, "odd", "<p>Alone"), (23, "http://a.b/z", "<article><p>Cut off")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\n\nOne & two {i} three\n\nFour {i}"
        assert got[10 + i] == f"Plain {i} text that is long enough to be the main part.\n\nMore {i}"
    assert (got[20], got[21], got[22], got[23]) == ("", "", "Alone", "Cut off")


def test_html_on_given_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGES = "page_id long, url string, html string"


def extracted(spark, rows, **more):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES), **more).collect()}


def test_html_loses_no_text(spark):
    body = "<html><body><nav>menu</nav><div id='content'><p>Only text of this host.</p></div></body></html>"
    rows = [(i, "http://copies.x/", body) for i in range(4)]
    shared = "<p>A paragraph that all five share.</p>"
    rows += [(10 + i, "http://share.x/", f"<body><div class='top'>Our shop</div><div id='content'><p>Own text {i} of page.</p>{shared}</div></body>") for i in range(5)]
    inner = "<div class='legal-analysis'><p>The law</p></div><div class='search-results-table'>Found</div><p>Costs <span class='share-price'>12</span> a share</p><div class='comment-list'>Nice</div><div class='siteFooter'>x</div>"
    rows += [(20 + i, "http://law.x/", f"<body><article id='post-{i}'><h1>T{i}</h1>{inner}</article></body>") for i in range(5)]
    same = "<body><div>Weather notice</div><div><h2>Own head {0}</h2><p>Own {0} and more.</p></div><div>All rights reserved</div></body>"
    rows += [(30 + i, "http://plain.x/", same.format(i)) for i in range(5)]
    got = extracted(spark, rows)
    for i in range(4):
        assert got[i] == "Only text of this host."
    for i in range(5):
        assert got[10 + i] == f"Own text {i} of page.\n\nA paragraph that all five share."
        assert got[20 + i] == f"T{i}\n\nThe law\n\nFound\n\nCosts 12 a share"
        assert got[30 + i] == f"Own head {i}\n\nOwn {i} and more."


def test_html_copies_and_odd_pages_keep_their_text(spark):
    same = "<body><div class='x'>Welcome</div><div id='c'><p>{}</p></div></body>"
    rows = [(i, "http://h.x/", same.format("One article in many copies.") + f"<!-- {i} -->") for i in range(20)]
    rows += [(20 + i, "http://h.x/", same.format(f"Text number {i}")) for i in range(4)]
    rows += [(30, "http://h.x/", "<body><div class='x'>Welcome</div><div id='c'><p>In</p></div><div class='y'><p>Beside the usual place.</p></div></body>")]
    rows += [(31, "http://h.x/", "<body><p>No frame at all"), (32, "http://h.x/", "<body><div class='x'>Welcome</div></body>"), (33, "http://h.x/", None)]
    rows += [(40, "http://long.x/", "<body><p>" + "word &amp; " * 300_000), (41, None, "<p>a</p>"), (41, None, "<p>a</p>")]
    frame = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("mine")).withColumn("sig", F.lit(1)).withColumn("tokens", F.lit("t"))
    out = html_extract.extract(frame).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert all(got[i] == "One article in many copies." for i in range(20)) and all(got[20 + i] == f"Text number {i}" for i in range(4))
    assert "In" in got[30] and "Beside the usual place." in got[30] and got[31] == "No frame at all"
    assert got[33] == "" and got[40] == ("word & " * 300_000).strip() and got[41] == "a"
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_html_templates_are_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        optional = "<div class='promo2'>Offer of the week</div>" if i % 3 else ""
        parts = [f"<p>own {i} {k}</p>" for k in range(rng.randint(1, 3))] + ["<p>wanders about</p>"]
        rng.shuffle(parts)
        top = "<div class='a'>fixed a</div>" * (1 + (i % 7 == 0)) + "<div class='b'>fixed b</div>"
        ends = rng.sample(["<p>roams</p>", ""], 2)
        rows.append((i, f"http://{'abc'[i % 2]}.x/", f"<body>{ends[0]}{top}<div id='c'>{''.join(parts)}</div>{optional}<div class='z'>end</div>{ends[1]}</body>"))
    parsed = [(u, html_extract.parsed_row(h)) for _, u, h in rows]
    schema = "host string, sig long, toks array<long>, counts array<int>, places array<int>"
    frame = spark.createDataFrame([(u, p[0], p[7], list(p[8]), list(p[9])) for u, p in parsed], schema)
    got = {r["host"]: set(r["tokens"]) for r in html_extract.templates(frame).collect()}
    for host in {u for u, _ in parsed}:
        pages = [x for _, x in sorted({p[0]: dict(zip(p[7], zip(p[8], p[9], strict=True), strict=True)) for u, p in parsed if u == host}.items())]
        classes = defaultdict(list)
        for t in {t for p in pages for t in p}:
            vector = tuple(p.get(t, (0, 0))[0] for p in pages)
            if max(vector) == 1 and sum(vector) * 2 >= len(pages):
                classes[vector].append(t)
        holding = lambda v: [p for n, p in zip(v, pages, strict=True) if n]
        valid = {}
        for v, toks in classes.items():
            order = sorted(toks, key=lambda t: holding(v)[0][t][1])
            kept = Counter()
            for p in holding(v):  # of what keeps the first page's order, the most
                best = [[]]
                for t in order:
                    best += [[*x, t] for x in best if not x or p[x[-1]][1] < p[t][1]]
                    best = [max((x for x in best if (x or [None])[-1] == e), key=len) for e in dict.fromkeys((x or [None])[-1] for x in best)]
                kept.update(max(best, key=len))
            valid[v] = [t for t in toks if kept[t] >= 0.9 * sum(v)]
        root = max((v for v in valid if valid[v]), key=lambda v: (sum(v), len(valid[v])))
        want = set()
        for v, toks in valid.items():
            slots = Counter()
            for p in holding(v):
                own = {sum(p[x][1] < p[t][1] for x in valid[root]) for t in toks} if v != root and toks else {0}
                slots[own.pop() if len(own) == 1 else -1] += 1
            if max((n for slot, n in slots.items() if slot >= 0), default=0) >= 0.9 * sum(v):
                want |= set(toks)
        assert got[host] == want and want
        assert html_extract._token("/body/div.b", "fixed b") in want
        assert html_extract._token("/body/p", "roams") not in want
    kept = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert all("wanders about" in r["text"] and "fixed b" not in r["text"] and "end" not in r["text"] for r in kept)


def test_nn_descent_is_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[100:102] = x[99] * 3
    x[110] = x[111]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None] * 8), (404, [1.0] * 4)]
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=6).toPandas().set_index("vec_id")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = components([(a, b) for a, b in zip(*map(list, np.nonzero(near)), strict=True)], range(300))
    assert (got.loc[range(300), "n_links"].to_numpy() == near.sum(1) - 1).all()
    assert got.loc[range(300), "component_id"].tolist() == [want[i] for i in range(300)]
    assert got.loc[[400, 401, 402, 403, 404], "n_links"].sum() == 0 and got.kept.sum() == (got.index == got.component_id).sum()
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nn_descent_leaves_full_lists(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(640, 16))
    x[340:640] = x[340] + 0.01 * rng.normal(size=(300, 16))  # most links of all are here
    for at in range(0, 120, 20):  # six tight subgroups of one group, two of them hardly reached by the others
        near = x[200] + (0.25 if at < 80 else 0.4) * rng.normal(size=16)
        x[at : at + 20] = near + 0.01 * rng.normal(size=(20, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, [1.0, 2.0]), (701, [2.0, 4.0]), (702, [2.0, -1.0])]
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6).toPandas().set_index("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = components([(a, b) for a, b in zip(*map(list, np.nonzero(near)), strict=True)], range(640))
    assert near[:20, 20:120].any()
    assert got.loc[range(640), "component_id"].tolist() == [want[i] for i in range(640)]
    assert (got.loc[range(640), "n_links"].to_numpy() == near.sum(1) - 1).all()
    assert got.loc[[700, 701, 702], "n_links"].tolist() == [1, 1, 0] and got.loc[701, "component_id"] == 700


def test_nn_descent_audits_small_groups_apart(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 16))
    x[:60] = x[0] + 0.01 * rng.normal(size=(60, 16))
    x[61] = x[60] + 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    parts = [(i, 0) for i in range(60)]
    assert nn_descent.audit(nodes, spark.createDataFrame(parts, "node long, component long"), 0.9) == 0
    assert nn_descent.audit(nodes, spark.createDataFrame([*parts, (60, 60), (61, 60)], "node long, component long"), 0.9) == 1


def test_pipeline_is_its_stages_by_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, DIR)
    verdict = {r["doc_id"] for r in quality_rules.op6_query(spark, DIR).where("kept").select("doc_id").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.select("doc_id").collect()} == verdict
    one = stages["SimHash near-dedup"](spark, good, DIR)
    of = simhash_dedup.simhash_components(good).toPandas()
    assert sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(of.component_id.unique())
    cut = stages["suffix-array dedup"](spark, one, DIR)
    assert cut.columns == docs.columns and cut.count() == one.count()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    want = dict(zip(before, without_passages(before.values(), 50), strict=True))
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    lengths = pd.Series({r["doc_id"]: len(r["text"]) for r in cut.collect()}) <= pd.Series({r["doc_id"]: len(r["text"]) for r in one.collect()})
    assert lengths.all()
    mixed = stages["source mixing"](spark, cut, DIR)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
