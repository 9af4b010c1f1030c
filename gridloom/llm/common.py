"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..storage import shared_folder, stored

__all__ = ["hashable", "n_words_of", "quoted", "shared_folder", "stored", "words_of"]

#: Words are runs of anything but ASCII white space; all operators count them so.
SPACES = "\t\n\x0b\x0c\r"


def words_of(text):
    """The words of a text column as an array; a null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def n_words_of(text):
    """How many words a text column has; a null text has none."""
    return F.size(words_of(text)).cast("long")


def quoted(name: str):
    """The column of that very name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def hashable(docs):
    """All columns of a table, for hashes of rows; those that hold maps or variants, which have no hash, as JSON."""
    return [F.to_json(F.struct(quoted(c).alias("x"))) if "map<" in t or "variant" in t else quoted(c) for c, t in docs.dtypes]
