"""Token files, source divergence and spelling variants against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import source_divergence, spelling_variants, token_files
from gridloom.llm.elias_fano import EliasFano
from gridloom.llm.tokens import default_tokenizer

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, word string, tie int, part string, cells array<int>"


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns named as the operators' own."""
    return spark.createDataFrame([(*r, 7, "x", "y", 1, "p", [1]) for r in rows], SCHEMA)


def test_sequences_by_select():
    rng = np.random.default_rng(3)
    for _ in range(120):
        n, most = int(rng.integers(0, 1500)), int(rng.choice([1, 9, 1000, 10**7, 2**45, 2**63 - 1]))
        values = np.sort(rng.integers(0, most, n).astype(np.uint64))
        code = EliasFano.encode(values)
        own = EliasFano(code)
        assert len(own) == n and own.slice(0, n).tolist() == values.tolist()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert own.slice(a, b).tolist() == values[a:b].tolist()
        for i in rng.integers(0, n, 8).tolist() if n else ():
            assert own[i] == values[i] and own.first_at_least(int(values[i])) == np.searchsorted(values, values[i])
        assert own.first_at_least(most) == n
        if n:
            assert 8 * (len(code) - 17) <= n * (3 + max(0, np.log2(max(1, most / n))) + 32 / 256) + 32 + 16
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano(EliasFano.encode(np.array([1, 2])))[2]


def encoded(texts):
    own = Tokenizer.from_file(default_tokenizer())
    return [own.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


@pytest.mark.parametrize("file_ids", [40, 1 << 24])
def test_token_files_give_every_document_back(spark, file_ids):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "two", "né", "中文", "<|endoftext|>", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "x" * 5000, " " * 25_000, "same", "same"]
    ids = [rng.randrange(-(2**63), 2**62) for _ in texts[2:]] + [5, 5]
    rows = [(i, t, None, None) for i, t in zip(ids, texts, strict=True)] + [(None, "no id", "en", "s"), (None, None, "en", "s"), (ids[0], texts[0], "en", "s")]
    files = token_files.write_corpus(docs_of(spark, rows), file_ids=file_ids)
    got = [tuple(r) for r in token_files.read_documents(files, ids=True).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert Counter((r[0], tuple(r[4])) for r in got) == Counter((r[0], tuple(x)) for r, x in zip(rows, encoded([r[1] for r in rows]), strict=True))
    at = 0
    for _, start, n, crc, own in got:
        assert (start, n, crc) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += n
    if file_ids == 40:
        assert files.count() > 10
    # any document by itself, by two selects and one range
    row = files.orderBy("part", "nth").collect()[-1]
    file = token_files.FileReader(row["file"])
    tail = got[-row["n_docs"] :]
    for i, (doc_id, _, n, _, own) in enumerate(tail):
        a, b = file.span(i)
        assert b - a == n and file.ids(a, b).tolist() == own and i in file.places(doc_id)
    assert len(file.places(2**62)) == len(file.places(-(2**63))) == 0
    file.close()


def test_token_files_of_nothing(spark):
    files = token_files.write_corpus(docs_of(spark, []))
    assert files.count() == 0 and token_files.read_documents(files).count() == 0


def test_op11_is_brute_force(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = token_files.op11_query(spark, DIR).orderBy("doc_id").collect()
    at = 0
    for r, (doc_id, text), own in zip(got, rows, encoded([r[1] for r in rows]), strict=True):
        assert tuple(r) == (doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def other_file(tmp_path, content):
    p = tmp_path / "x.ids"
    p.write_bytes(content)
    return f"file://{p}"


def test_other_files_are_refused(tmp_path):
    for content in (b"", b"short", b"\0" * 100):
        with pytest.raises(ValueError):
            token_files.FileReader(other_file(tmp_path, content))
    writer = token_files.FileWriter(f"file://{tmp_path}/y.ids", 2)
    writer.add(1, [5, 6, 0])
    writer.close()
    whole = (tmp_path / "y.ids").read_bytes()
    with pytest.raises(ValueError):
        token_files.FileReader(other_file(tmp_path, whole[2:]))


def word_rows(seed, n=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])) for i in range(n)]
    rows += [(n, None, "en", "null text"), (n + 1, "", "only", "one"), (n + 2, "zz zz zz", "two", "a"), (n + 3, "zz", "two", "b"), (n + 4, "ZZ-zz", "two", "c"), (n + 5, "q" * 20_000, "en", "s")]
    return [*rows, rows[0], rows[0], rows[5], (None, "z中9中 z中", "en", "s"), (None, "z中", "en", "s"), (None, "Z中", "en", "t")]


def divergences_by_hand(rows):
    docs = [(lang or "", source or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= 3)
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            count[s].update(t for t in terms if df[t] >= 3)
        whole = sum(count.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in count:
            pair = sorted((-sum((p(count[s], t) - p(count[o], t)) ** 2 // p(count[o], t) for t in kept), o) for o in count if o != s)
            term = sorted((-((p(count[s], t) - p(whole, t)) ** 2 // p(whole, t)), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t))[:200]
            for part, found in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("held", [3, 400_000])
def test_divergences_are_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(source_divergence, "HELD_COUNTS", held)
    rows = word_rows(4)
    got = source_divergence.divergences(docs_of(spark, rows)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == divergences_by_hand(rows)


def test_divergences_of_many_sources_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD_PAIRS", 64)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(12)), "en", f"s{i % 40}") for i in range(400)]
    assert {tuple(r) for r in source_divergence.divergences(docs_of(spark, rows)).collect()} == divergences_by_hand(rows)


def test_probabilities_of_huge_counts_are_exact(spark):
    count, n, v = 9 * 10**15, 10**16, 12345
    got = spark.range(1).select(F.lit(count).alias("c"), F.lit(n).alias("n"), F.lit(v).alias("v")).select(source_divergence._p("c", "n", "v")).first()[0]
    assert got == 1 + 10**9 * (count + 1) // (n + v)


def variants_by_hand(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [o for o in words if near(w, o)] for w in words}
    form = {w: min(by[w], key=lambda o: (-words[o], o)) for w in words if by[w]}
    form = {w: f for w, f in form.items() if words[f] >= 5 * words[w]}
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, words[w], len(by[w]), form.get(w), words.get(form.get(w)), root))
    return out


def variant_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabé×") for _ in range(rng.randint(5, 9))) for _ in range(12)]
    pool = defaultdict(int)
    for w in base:
        pool[w] += 30
        for _ in range(8):
            i, c = rng.randrange(len(w)), rng.choice("abéÿ")
            for edited in (w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]):
                pool[edited] += rng.choice([1, 1, 5])
    bag = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, k in pool.items() for _ in range(k)]
    rng.shuffle(bag)
    rows = [(i, " ".join(bag[k : k + 37]) + rng.choice([".", "_", "Ā", "퟿", ""]), "en", "s") for i, k in enumerate(range(0, len(bag), 37))]
    chain = ["qqqqqq"] * 5 + ["qqqqqr"] * 25 + ["qqqqrr"] * 125 + ["qqqrrr"] * 625
    return [*rows, rows[0], rows[1], (None, None, None, None), (None, rows[2][1], "en", "s"), (900, "", "en", "s"), (901, "\U0001f600abcdef中abcdef", "en", "s"), (902, " ".join(chain), "en", "s"), (903, "w" * 30_000, "en", "s")]


@pytest.mark.parametrize("held", [10, 400_000])
def test_variants_are_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", held)
    rows = variant_rows(6)
    want = variants_by_hand(rows)
    got = spelling_variants.variants(docs_of(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(w[3] and w[5] != w[3] for w in want) and any(w[2] > 8 for w in want)


def test_nothing_gives_nothing(spark):
    assert source_divergence.divergences(docs_of(spark, [])).count() == 0
    assert spelling_variants.variants(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("module,query", [(source_divergence, "op12_query"), (spelling_variants, "op13_query")])
def test_queries_are_their_sql(spark, module, query):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    got = getattr(module, query)(spark, DIR)
    want = con.execute(module.oracle_sql()).fetchall()
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(want)
