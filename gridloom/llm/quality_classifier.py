"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing: a token has a sparse random index vector, fixed by its hash, and a context vector, the sum over the whole
corpus of its neighbours' index vectors. Tokens share ``2 ** BUCKET_BITS`` hashed rows, so the context table has a fixed size
(``2 ** BUCKET_BITS * DIM`` floats, 2 MB) however large the corpus; each task sums its own table and Spark adds the rows. The network
is fitted on a bounded sample of labelled rows; its temperature is set on a part of them that it did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import text_of

BUCKET_BITS = 13
DIM = 64
NONZERO = 4
REACH = 2
#: At most so many labelled rows are fitted on; the rows with the smallest hashes of their ids, so that reruns agree.
SAMPLE = 20_000
HIDDEN = 32
FEATURES = 2 * DIM + 4

#: A token is a run of letters, of digits, or of other signs.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class _Buckets(dict):
    """Token to bucket; forgets all when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        shaped = "0" * len(token) if token.isdigit() else token
        self[token] = b = crc32(shaped.encode("utf-8", "surrogatepass")) & ((1 << BUCKET_BITS) - 1)
        return b


_buckets = _Buckets()


def _tokens(text: str) -> np.ndarray:
    return np.fromiter(map(_buckets.__getitem__, _TOKEN.findall(text)), np.int64)


@lru_cache(1)
def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors' entries, by bucket."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random(((1 << BUCKET_BITS) + 1, DIM)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], places.shape)
    signs[-1] = 0
    return places, signs


def context_vectors(docs: DataFrame) -> DataFrame:
    """``bucket``, ``total``, ``vector``: the context sums of every token of every text of ``docs``.

    A window of ``REACH`` tokens to either side, within a text; null and empty texts add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index()
        table, total = np.zeros(((1 << BUCKET_BITS) + 1) * DIM), np.zeros((1 << BUCKET_BITS) + 1)
        gap = np.full(REACH, 1 << BUCKET_BITS)  # between texts: a bucket without index vector, whose row is cut off

        def add(texts: list[np.ndarray]) -> None:
            nonlocal table, total
            b = np.concatenate([part for text in texts for part in (text, gap)])
            total += np.bincount(b, minlength=len(total))
            for k in range(1, REACH + 1):
                for here, there in ((b[k:], b[:-k]), (b[:-k], b[k:])):
                    for j in range(NONZERO):
                        table += np.bincount(here * DIM + places[there, j], signs[there, j], len(table))

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(_tokens(text_of(text)))
                size += len(held[-1])
                if size > 1 << 20:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        total[-1] = 0
        used = np.flatnonzero(total)
        if len(used):
            rows = table.reshape(-1, DIM)[used].astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIM), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used]), vectors], names=["bucket", "total", "vector"])

    parts = docs.select("text").mapInArrow(run, "bucket int, total double, vector array<float>")
    sums = [F.sum(F.col("vector")[i].cast("double")).alias(f"v{i}") for i in range(DIM)]
    return parts.groupBy("bucket").agg(F.sum("total").alias("total"), *sums).select("bucket", "total", F.array(*[f"v{i}" for i in range(DIM)]).alias("vector"))


def word_table(contexts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors, and smoothed weights of inverse frequency, by bucket; a fixed size whatever the corpus."""
    rows = contexts.collect()  # one row a bucket at most
    vectors, total = np.zeros((1 << BUCKET_BITS, DIM), np.float32), np.zeros(1 << BUCKET_BITS)
    for r in rows:
        vectors[r["bucket"]], total[r["bucket"]] = r["vector"], r["total"]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = total / max(1.0, total.sum())
    return (vectors / np.maximum(norm, 1e-9)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(text: str, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A text's features: weighted mean and spread of its word vectors, likeness of neighbours, and length."""
    vectors, weights = table
    b = _tokens(text)
    out = np.zeros(FEATURES, np.float32)
    if not len(b):
        out[-1] = 1
        return out
    v, w = vectors[b], weights[b][:, None]
    mean = (v * w).sum(0) / w.sum()
    out[:DIM] = mean
    out[DIM : 2 * DIM] = np.sqrt(np.maximum((v * v * w).sum(0) / w.sum() - mean * mean, 0))
    if len(b) > 1:
        out[2 * DIM] = (b[1:] == b[:-1]).mean()
        out[2 * DIM + 1] = np.einsum("ij,ij->i", v[1:], v[:-1]).mean()
    out[2 * DIM + 2] = np.log1p(len(b)) / 10
    return out


@dataclass
class Network:
    """Two layers; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, seed: int = 0) -> Network:
    """Adam on the logistic loss with rows in shuffled batches; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    if not len(x):
        x, y = np.zeros((1, FEATURES)), np.ones(1)
    order = rng.permutation(len(x))
    own, aside = order[len(x) // 5 :], order[: len(x) // 5]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.maximum(z[part] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60))) - y[part]) / len(part)
            back = d[:, None] * p[2] * (h > 0)
            grads = [z[part].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(aside):
        logits = net.logit(x[aside])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        loss = [np.logaddexp(0, np.where(y[aside] > 0, -logits, logits) / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, table: tuple[np.ndarray, np.ndarray], sample: int = SAMPLE) -> Network:
    """Fit on at most ``sample`` labelled rows (``doc_id``, ``quality`` 0 or 1); rows with a null label or id are passed over."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))  # `sample` rows at most
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(text_of(t), shared.value).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<float>").limit(2 * sample).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(len(got), FEATURES), np.array([r["y"] for r in got]))


def score(docs: DataFrame, table: tuple[np.ndarray, np.ndarray], net: Network) -> DataFrame:
    """``doc_id``, ``score`` per input row; null and empty texts are scored like others (no words)."""
    shared = docs.sparkSession.sparkContext.broadcast((table, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        for batch in batches:
            x = np.array([pooled(text_of(t), table) for t in batch.column("text")]).reshape(len(batch), FEATURES)
            s = net.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id, folds: int = 5):
    """Whether a row is kept from fitting: its id's crc32, as text, is divisible by ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Word vectors come from all texts. Fitted on labels outside the held-out fold only; without any, every score is
    the untrained network's. A null id is not held out. Repeated rows get equal scores; an empty table gives an empty one.
    """
    table = word_table(context_vectors(docs))
    net = train(docs, labels.where(~held_out(F.col("doc_id"))), table, sample)
    out = score(docs, table, net)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return classify(read("documents"), read("labels"))
