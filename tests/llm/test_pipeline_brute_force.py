"""Every stage of the pipeline against a version of its own, by SQL or plain Python, on the given documents."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from gridloom.llm import quality_rules
from gridloom.llm.tokens import default_tokenizer

DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents, and the rows that each stage makes of its predecessor's."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_rules(steps):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.oracle_sql()}) where kept").fetchall()}
    assert {r["doc_id"] for r in steps[1]} == kept and len(steps[1]) == len(kept) > 50
    assert set(steps[1]) <= set(steps[0])


def fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(steps):
    rows = sorted(steps[1], key=lambda r: r["doc_id"])
    prints = [fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    want = {rows[g] for g in set(group)}
    assert set(steps[2]) == want and len(steps[2]) == len(want) < len(rows)


def test_repeats(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2]}
    words = {i: list(re.finditer(WORD, t)) for i, t in before.items()}
    seen = Counter(tuple(m[0] for m in w[k : k + 50]) for w in words.values() for k in range(len(w) - 49))
    for r in steps[3]:
        text, w = before[r["doc_id"]], words[r["doc_id"]]
        gone = {k + j for k in range(len(w) - 49) if seen[tuple(m[0] for m in w[k : k + 50])] > 1 for j in range(50)}
        ends = [m.start() for m in w[1:]] + [len(text)] * bool(w)
        left = text[: w[0].start() if w else None] + "".join(text[m.start() : e] for k, (m, e) in enumerate(zip(w, ends, strict=True)) if k not in gone)
        assert r["text"] == left
    assert len(steps[3]) == len(steps[2])


def test_mixture(steps):
    size = {r["doc_id"]: len(re.findall(WORD, r["text"])) for r in steps[3]}
    source = {r["doc_id"]: r["source"] for r in steps[3]}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    copies = Counter(r["doc_id"] for r in steps[4])
    assert max(copies.values()) <= 3 and set(steps[4]) <= set(steps[3])
    taken = Counter()
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    largest = {s: max(n for i, n in size.items() if source[i] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 0.02 * target[s]) for s in sizes)
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values())


def test_sequences(steps):
    own = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for r in steps[4]:
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in steps[5]) == want
    places = {}
    for r in steps[5]:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    least = math.ceil(sum(k[3] * n for k, n in want.items()) / 2048)
    assert len(places) <= least + 1 + least // 50
