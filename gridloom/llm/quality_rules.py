"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import quoted, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with from by this at be or an not "
    "der die das und von mit den ist im für auf ein eine nicht sich dem zu es auch des "
    "le la les et des du un une est pour dans que qui sur par pas au plus en il "
    "el los las y del que por con para una se al lo como más su de no"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when ``least <= measure <= most``; a bound of None is open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are of the words, lines or characters of one text.
RULES = (
    Rule("mean_word_length", 2, 14),
    Rule("symbol_ratio", None, 0.3),
    Rule("stop_words", 2, None),
    Rule("dup_line_ratio", None, 0.6),
    Rule("shout_ratio", None, 0.5),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside a window of ``window`` words that the text holds twice or more."""
    size = F.size(words)
    hashes = F.when(size >= window, F.transform(F.sequence(F.lit(1), size - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        # sorted starts of repeated windows: each covers up to the next start or its own end
        steps = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def starts(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _let(pairs, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(starts(h), covered)))


def measures(text: Column, window: int = 8) -> dict[str, Column]:
    """The measures of a text column; a null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    words = words_of(text)
    solid = F.translate(whole, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    measured = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w, window).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        ),
    )
    lined = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "by_word": measured,
        "by_line": lined,
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_bangs": (F.length(whole) - F.length(F.translate(whole, "!", ""))).cast("long"),
    }


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 20, most_repeat: float = 0.3) -> DataFrame:
    """``docs`` with the base measures, ``base_failed`` and ``kept``; one row per input row.

    Null, empty and wordless texts have zero measures and fail (too few words). Ratios of nothing are null and
    pass no rule. Columns of ``docs`` that have a name of ours are replaced; an empty table gives an empty one.
    """
    m = measures(F.col("text"))
    ours = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]
    rest = [c for c in docs.columns if c.lower() not in ours]
    out = docs.select(F.struct(*map(quoted, rest)).alias("__rest"), m["by_word"].alias("__w"), m["by_line"].alias("__l"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_bangs"].alias("__bangs"))
    n = F.col("__w.n_words")
    ratios = {
        "mean_word_length": F.col("word_chars") / F.nullif(n, F.lit(0)),
        "symbol_ratio": F.col("n_symbols") / F.nullif(n, F.lit(0)),
        "stop_words": F.col("__w.n_stop_words"),
        "dup_line_ratio": F.col("__l.n_dup_lines") / F.nullif(F.col("__l.n_lines"), F.lit(0)),
        "shout_ratio": F.col("__bangs") / F.nullif(n, F.lit(0)),
    }
    passed = F.lit(True)
    for r in rules:
        if r.least is not None:
            passed = passed & (ratios[r.measure] >= r.least)
        if r.most is not None:
            passed = passed & (ratios[r.measure] <= r.most)
    failed = (n < least_words) | (F.col("__w.n_repeat_words") * 100 > n * round(100 * most_repeat))
    return out.select(
        "__rest.*",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("__l.n_dup_lines").alias("n_dup_lines"),
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        F.col("__w.n_stop_words").alias("n_stop_words"),
        failed.alias("base_failed"),
        (~failed & F.coalesce(passed, F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without the rejected rows; columns as they were."""
    # the verdict rides beside the row, so that clashing names in docs stay
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("__row"), F.col("text"))
    return score(whole, rules).where("kept").select("__row.*")


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).drop("text")


def oracle_sql() -> str:
    """DuckDB's SQL for ``op6_query``."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (select doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') as gram
      from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
r as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
      from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from d) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
      (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
      len(list_filter(list_distinct(ws), lambda x: x in ({stops})))::bigint as n_stop_words,
      len(ls) as n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) as bangs
      from w left join r using (doc_id)),
b as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
       (not base_failed and word_chars / n_words >= 2 and word_chars / n_words <= 14 and n_symbols / n_words <= 0.3
        and n_stop_words >= 2 and n_dup_lines / n_lines <= 0.6 and bangs / n_words <= 0.5) as kept
from b
"""
