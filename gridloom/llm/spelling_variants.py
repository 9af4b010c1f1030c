"""Spelling variants: words one edit apart, by permuterm rotations.

A word ends in a mark and is turned round at every place. A rotation without its last character is the word without that character, read from
behind it; so all words that differ in that character alone share it as a prefix of their rotations, and a word that lacks the character has it as
a whole rotation. Rotations are dealt out by that prefix and sorted; a scan of equal prefixes finds replacements (its words among each other) and
insertions or deletions (the whole rotation against its words). A prefix holds one word for each character at most, so groups are as small as the alphabet.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import text_of

#: Words have so many characters and occurrences at least.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A word's form occurs so many times as often as the word, at least.
RATIO = 5
#: One run in so many, by checksum, loses a character; 0 for none.
DAMAGE = 199
#: A partition hands on its counts when it holds so many words.
HELD_WORDS = 400_000

#: By byte of Latin-1: A-Z in lower case, a-z and 0xC0-0xFF as they are, the rest to spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
_END = "$"


def runs_of(text: str) -> list[bytes]:
    """Runs of ``[A-Za-z\\u00C0-\\u00FF]`` in Latin-1, a byte a character, A-Z lower-cased; characters beyond part runs."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def _damaged(run: bytes, prefix: int, damage: int) -> bytes:
    """The run, or without one character if ``damage`` divides the checksum of ``<doc_id>:<run>``; ``prefix`` is that of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    at = h % len(run)
    return run if h % damage else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """``word``, ``n``: words of whole texts with their occurrences, counted in the partitions first. A null text has no words; a null id reads as ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs_of(text_of(value))).items():
                    word = _damaged(run, prefix, damage) if damage else run
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed_on()
                    held.clear()
        yield handed_on()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``key``, ``skipped``, ``n``: each word's rotations without their last character, which is ``skipped``; and its whole rotations, where that is ''."""
    places = F.sequence(F.lit(0), F.length("word"))
    at = words.select("word", "n", F.explode(places).alias("at"))
    whole = at.select(F.expr(f"concat(substring(word, at + 1), '{_END}', substring(word, 1, at))").alias("key"), F.lit("").alias("skipped"), "n")
    edited = at.where("at > 0").select(F.expr(f"concat(substring(word, at + 1), '{_END}', substring(word, 1, at - 1))").alias("key"), F.expr("substring(word, at, 1)").alias("skipped"), "n")
    return whole.unionByName(edited)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations as ``word``, ``n_near``, ``near_n``, ``near``: how many neighbours a prefix gives a word, and the most frequent of them."""
    key, group = None, []
    out: list[tuple] = []

    def packed():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

    for batch in batches:
        for k, skipped, n in zip(*(batch.column(c).to_pylist() for c in ("key", "skipped", "n")), strict=True):
            if k != key:
                if len(group) > 1:
                    out += _neighbours(key, group)
                key, group = k, []
            group.append((skipped, n))
        if len(out) >= 20_000:
            yield packed()
            out.clear()
    if len(group) > 1:
        out += _neighbours(key, group)
    yield packed()


def _neighbours(key: str, group: list[tuple[str, int]]) -> list[tuple]:
    after, _, before = key.partition(_END)
    members = sorted(((-n, before + skipped + after, skipped) for skipped, n in group))
    longer = [m for m in members if m[2]]
    # of a run of equal characters only the first counts as inserted, or two words would meet once for each
    shorter, inserted = [m for m in members if not m[2]], [m for m in longer if m[2] != before[-1:]]
    out = []
    for m in longer:
        best = min([o for o in longer[:2] if o is not m] + (shorter if m[2] != before[-1:] else []), default=None)
        if best:
            out.append((m[1], len(longer) - 1 + (len(shorter) if m[2] != before[-1:] else 0), -best[0], best[1]))
    return out + [(m[1], len(inserted), -inserted[0][0], inserted[0][1]) for m in shorter if inserted]


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``near``, ``near_n``: number of words one edit away, and the most frequent of them (the first in order among equals)."""
    dealt = rotations(words).repartition("key").sortWithinPartitions("key", "skipped")
    found = dealt.mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of ``word``, ``form``: forms followed to the last, twice as far each round.

    Each form is more frequent than its word, so there are no circles, and a chain has at most some 27 steps at ``RATIO`` 5: five rounds.
    """
    root = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(root.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        root = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return root


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: int = DAMAGE) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    ``form`` is the most frequent word one edit away if that is ``ratio`` times as frequent, else null; ``root`` is where forms lead, the word itself
    without one. Words of less than ``least_length`` characters or ``least_count`` occurrences are none. Repeated rows count as often as they occur;
    an empty table gives an empty one. Columns other than ``doc_id`` and ``text`` are not read.
    """
    words = stored(word_counts(docs, least_length, least_count, damage), "words")
    near = words.join(neighbours(words), "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    table = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "variants")
    return table.join(roots(table.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """The same rows: checksums byte by byte, words one edit apart by the words that a deletion leaves."""
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  GROUP BY doc_id, run),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
bytes AS (
  SELECT run, n, list_transform(range(length(x) // 2), lambda i: (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT) AS b FROM hexed),
summed AS (SELECT run, n, xor(list_reduce(b, lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
told AS (SELECT n, CASE WHEN h % {DAMAGE} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM told WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
indel AS (SELECT DISTINCT cut.word AS long, words.word AS short FROM cut JOIN words ON cut.rest = words.word),
near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION ALL SELECT long, short FROM indel UNION ALL SELECT short, long FROM indel),
best AS (
  SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, near, w.n AS near_n FROM near JOIN words w ON w.word = near.near
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near) = 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
led AS (SELECT word, word AS root FROM formed UNION ALL SELECT led.word, form FROM led JOIN formed ON led.root = formed.word WHERE form IS NOT NULL)
SELECT formed.*, root FROM formed JOIN led USING (word) JOIN formed z ON z.word = led.root WHERE z.form IS NULL
"""
