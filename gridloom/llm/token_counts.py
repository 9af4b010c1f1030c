"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole; every token's character span is read off the encoding, sections are intervals of
characters, and each token is attributed to the sections that its span meets. Tokens that cross a boundary go by a named rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import default_tokenizer, encoder, text_of

#: How a token over several sections is allocated: to the one with its first character; or to the one with
#: most of its characters (the earliest among equals).
RULES = ("first", "most")


def spans(text: str, path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last character of every token of ``text``; a character cut by tokens belongs to each of them."""
    own, sizes = encoder(path)
    size = sizes[np.array((own.encode if added else own.encode_ordinary)(text), np.int64)]
    stop = np.cumsum(size)
    start = stop - size
    raw = text.encode("utf-8")
    if len(raw) == len(text):
        return start, stop
    # character of each byte: how many lead bytes come up to it
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[start], char[stop - 1] + 1


def sections(text: str, boundary: re.Pattern) -> np.ndarray:
    """Starts of a text's sections, and its length: each section runs to the end of the boundary that closes it."""
    cuts = [m.end() for m in boundary.finditer(text)]
    starts = [0, *(c for c in cuts if 0 < c < len(text))]
    return np.array([*starts, len(text)], np.int64)


def attributed(start: np.ndarray, stop: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach into another section."""
    first = np.searchsorted(edges[1:-1], start, side="right")
    last = np.searchsorted(edges[1:-1], np.maximum(stop - 1, start), side="right")
    own = first.copy()
    if rule == "most":
        for t in np.flatnonzero(last > first).tolist():
            cuts = np.clip(edges[first[t] : last[t] + 2], start[t], stop[t])
            own[t] = first[t] + int(np.diff(cuts).argmax())
    n = len(edges) - 1
    return np.bincount(own, minlength=n), np.bincount(own[last > first], minlength=n)


def section_tokens(docs: DataFrame, boundary: str = r"\n", rule: str = "first", tokenizer: str | None = None, text: str = "text", added: bool = False) -> DataFrame:
    """``doc_id``, ``section`` (from 0), ``start``, ``stop`` (characters), ``n_tokens``, ``n_crossing``.

    A row for every section of every input row; over a row's sections ``n_tokens`` adds up to its tokens. A null or empty
    text has one empty section without tokens. Repeated rows give repeated results; further columns are not read.
    With ``added``, texts are split at the vocabulary's added tokens, as its tokenizer does when nothing else is set; without,
    these are read as ordinary text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, cut = tokenizer or default_tokenizer(), re.compile(boundary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts, cols = [], [], ([], [], [], [], [])
            for value in batch.column("text"):
                words = text_of(value)
                edges = sections(words, cut)
                n, crossing = attributed(*spans(words, path, added), edges, rule)
                counts.append(len(n))
                for held, x in zip(cols, (np.arange(len(n)), edges[:-1], edges[1:], n, crossing), strict=True):
                    held.append(x)
            at = np.repeat(np.arange(len(counts)), counts)
            flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(flat[0].astype(np.int32)), *map(pa.array, flat[1:])], names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long")


def field_tokens(docs: DataFrame, fields: list[str], joint: str = "\n", rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``field``, ``n_tokens``, ``n_crossing`` of string columns encoded together, ``joint`` between them.

    A joint belongs to the field that it follows. A null field is an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                parts = [text_of(batch.column(f"f{k}")[i]) + joint * (k + 1 < len(fields)) for k in range(len(fields))]
                edges = np.r_[0, np.cumsum([len(p) for p in parts])]
                n, crossing = attributed(*spans("".join(parts), path), edges, rule)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i : i + 1].take(pa.array([0] * len(fields))), pa.array(fields), pa.array(n.astype(np.int64)), pa.array(crossing.astype(np.int64))], names=["doc_id", "field", "n_tokens", "n_crossing"])

    picked = [F.col(f"`{c}`").cast("string").alias(f"f{k}") for k, c in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *picked).mapInArrow(run, "doc_id long, field string, n_tokens long, n_crossing long")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), added=True)
