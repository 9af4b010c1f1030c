"""License scans: winnowed template fingerprints in an inverted index pick candidates, banded alignment measures them.

Fingerprints of a template that a text holds on one diagonal make a segment. Segments in order are chained, over clauses put in or
left out, and the band of the alignment follows the chain.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import text_of

GRAM = 3
WINDOW = 4
BAND = 8
COVERAGE = 0.8

_WORD = re.compile(r"[^\W_]+")


@lru_cache(1)
def bundled_templates() -> dict[str, str]:
    """Name to text of the license texts and notices that come with the package."""
    parts = re.split(r"^== (.+)$", (Path(__file__).parent / "licenses.txt").read_text("utf-8"), flags=re.M)
    return {name: text.strip() for name, text in zip(parts[1::2], parts[2::2], strict=True)}


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]  # word by word: some letters become two, not all of them of words


def index_of(templates: dict[str, str]) -> tuple[dict[str, list[str]], dict[tuple, list[tuple[str, int]]]]:
    """Words of each template, and the inverted index: winnowed word triples to (template, place).

    Of any WINDOW triples in a row the one with the smallest hash is kept, so that a match of GRAM + WINDOW - 1
    words always holds an indexed triple; every triple of a document is looked up.
    """
    words = {name: _words(text) for name, text in templates.items()}
    index: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
    for name, w in words.items():
        grams = list(zip(w, w[1:], w[2:], strict=False))
        hashes = [(crc32(" ".join(g).encode()), i) for i, g in enumerate(grams)]
        kept = {min(hashes[i : i + WINDOW]) for i in range(max(1, len(hashes) - WINDOW + 1)) if hashes}
        for _, i in sorted(kept):
            index[grams[i]].append((name, i))
    return words, dict(index)


#: Words and hits on one diagonal of a template in a text: first and last template word, first and last document word, hits.
Segment = tuple[int, int, int, int, int]


def segments(hits: list[tuple[int, int]], band: int = BAND, gap: int = 2 * (GRAM + WINDOW)) -> list[Segment]:
    """``hits`` (document and template place, in document order) joined where they are on nearly one diagonal, no more than ``gap`` words apart."""
    open_: dict[int, list[int]] = {}  # by diagonal, in steps of the band
    out = []
    for i, j in hits:
        step = (i - j) // band
        near = next((open_[k] for k in (step, step - 1, step + 1) if k in open_ and open_[k][1] < j <= open_[k][1] + gap and open_[k][3] < i <= open_[k][3] + gap), None)
        if near is None:
            near = open_[step] = [j, j, i, i, 0]
            out.append(near)
        near[1], near[3], near[4] = j, i, near[4] + 1
    return [tuple(x) for x in out]


def chains(parts: list[Segment], gap: int, slack: int = BAND) -> Iterator[list[Segment]]:
    """Segments that follow each other in template and document, but for ``slack`` words, no more than ``gap`` words apart; those with most hits first.

    Chains share no part of the document. All are read off one pass over the segments, and again of what segments these leave.
    """
    parts = sorted(parts, key=lambda x: (x[2], x[0]))
    while parts:
        best: list[tuple[int, int]] = []  # hits up to and with each segment, and the one before
        first = 0
        for k, x in enumerate(parts):
            while parts[first][3] + gap < x[2] and first < k:
                first += 1
            before = [(best[m][0], m) for m in range(first, k) if parts[m][0] < x[0] and parts[m][2] < x[2] <= parts[m][3] + gap and parts[m][1] < x[0] + slack and parts[m][3] < x[2] + slack]
            n, m = max(before, default=(0, -1))
            best.append((n + x[4], m))
        gone = bytearray(len(parts))
        for k in sorted(range(len(parts)), key=lambda k: (-best[k][0], k)):
            chain = []
            while k >= 0 and not gone[k]:
                chain.append(k)
                k = best[k][1]
            if not chain or k >= 0:  # part of it belongs to a better chain
                continue
            chain.reverse()
            yield [parts[k] for k in chain]
            k, end = chain[0], max(parts[k][3] for k in chain)
            while k < len(parts) and parts[k][2] <= end:
                gone[k] = 1
                k += 1
        parts = [x for x, y in zip(parts, gone, strict=True) if not y]


def course(chain: list[Segment], n: int, band: int = BAND) -> list[tuple[int, int]]:
    """First and last document word among which each of a template's ``n`` words is looked for: ``band`` words around the segments'
    diagonals, and between two segments around both of their diagonals. Neither bound ever falls.
    """
    out: list[tuple[int, int]] = []
    for k in range(len(chain) + 1):
        here = [chain[m][2] - chain[m][0] for m in (k - 1, k) if 0 <= m < len(chain)]
        after = chain[k - 1][0] if k else 0
        for j in range(after, chain[k][0] if k < len(chain) else n):
            low, high = j + min(here) - band, j + max(here) + band
            out.append((max(low, out[-1][0]), max(high, out[-1][1])) if out else (low, high))
    return out


def between(found: list[list[Segment]], n: int) -> list[tuple[int, int]]:
    """For each chain, in document order, the first and last document word that are not beyond a neighbour with as many hits."""
    hits = [sum(x[4] for x in c) for c in found]
    out = [[0, n - 1] for _ in found]
    for way in (1, -1):
        above: list[tuple[int, int]] = []  # hits of those passed, each more than the next's, and the word where they stop
        for k in range(len(found))[::way]:
            while above and above[-1][0] < hits[k]:
                above.pop()
            if above:
                out[k][way < 0] = above[-1][1]
            above.append((hits[k], max(x[3] for x in found[k]) + GRAM if way > 0 else found[k][0][2] - 1))
    return [tuple(x) for x in out]


def aligned(template: list[str], words: list[str], bounds: list[tuple[int, int]], first: int = 0, last: int | None = None) -> tuple[int, int, int]:
    """Most template words that match document words in order, each within its ``bounds``, from ``first`` to ``last``.

    Returns the number matched and the first and last matched document word. Insertions, omissions and changes cost
    nothing but the words missed.
    """
    stop = len(words) if last is None else last + 1
    none = (0, 0, -1)  # matched, -first, last: of template words so far and document words up to one
    best, at = [none], bounds[0][0] - 1 if bounds else 0
    for t, (low, high) in zip(template, bounds, strict=True):
        end = at + len(best) - 1
        row = [best[max(0, min(low - 1, end) - at)]]  # the word before the window carries what was found up to it
        for j in range(low, high + 1):
            top = max(row[-1], best[min(j, end) - at])
            if first <= j < stop and words[j] == t:
                n, begun, _ = best[min(j - 1, end) - at]
                hit = (n + 1, begun if n else -j, j)
                if hit[:2] > top[:2]:
                    top = hit
            row.append(top)
        best, at = row, low - 1
    n, begun, ended = best[-1]
    return n, -begun, ended


def matches(text: str, words: dict[str, list[str]], index: dict, band: int = BAND, coverage: float = COVERAGE) -> list[tuple[str, int, int, float, int, int]]:
    """License, matched words, template words, coverage, and first and past-last character of each match in a text.

    Of matches of one template that overlap, the one with most words is taken, of equals the first.
    """
    own = _words(text)
    hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, gram in enumerate(zip(own, own[1:], own[2:], strict=False)):
        if gram in index:
            for name, j in index[gram]:
                hits[name].append((i, j))
    if not hits:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    out = []
    for name, found in hits.items():
        template = words[name]
        gap, held = max(50, len(template)), Counter(template)
        taken: list[tuple[int, int, int]] = []
        every = sorted(chains(segments(found, band), gap, band), key=lambda c: c[0][2])
        for chain, limits in zip(every, between(every, len(own)), strict=True):
            bounds = course(chain, len(template), band)
            around = Counter(own[max(0, bounds[0][0]) : bounds[-1][1] + 1])
            if sum(min(n, around[w]) for w, n in held.items()) >= coverage * len(template):  # else no order of words can do
                got = aligned(template, own, bounds, *limits)
                if got[0] >= coverage * len(template):
                    taken.append(got)
        ends: list[tuple[int, int]] = []
        for n, a, b in sorted(taken, key=lambda g: (-g[0], g[1])):
            k = bisect_left(ends, (a, b))
            if (not k or ends[k - 1][1] < a) and (k == len(ends) or ends[k][0] > b):
                ends.insert(k, (a, b))
                out.append((name, n, len(template), n / len(template), places[a][0], places[b][1]))
    return sorted(out, key=lambda m: (m[4], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """``doc_id``, ``license``, ``matched_words``, ``template_words``, ``coverage``, ``start``, ``stop``: a row per match.

    ``templates`` (name to text, as many as fit a task's memory) default to the bundled ones. Null and empty texts match
    nothing; repeated rows repeat their matches; further columns are not read; an empty table gives an empty one.
    """
    words, index = index_of(templates or bundled_templates())
    names = ["doc_id", "license", "matched_words", "template_words", "coverage", "start", "stop"]
    schema = "doc_id long, license string, matched_words long, template_words long, coverage double, start long, stop long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, value in enumerate(batch.column("text")):
                for m in matches(text_of(value), words, index, band, coverage):
                    ids.append(i)
                    rows.append(m)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
