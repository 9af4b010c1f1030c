"""Demand: requests for chunks, asked and cancelled, turned into work in order.

Events (``seq``, ``key``, ``level``, ``kind`` ask or cancel, ``claim``) stream in; state by chunk holds its live claims. A chunk
with claims is wanted at its finest level and earliest arrival; one whose claims are all cancelled is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

STATE = "claims map<string, struct<level: long, seq: long>>"
OUT = "key string, level long, seq long, claims long"


def wanted(events: DataFrame) -> DataFrame:
    """A streaming table of each touched chunk's demand after each batch: ``key``, ``level``, ``seq``, ``claims`` (0: dropped)."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        claims: dict[str, tuple[int, int]] = {}
        if state.exists:
            claims = {c: (int(level), int(seq)) for c, level, seq in zip(*state.get, strict=True)}
        rows = pd.concat(batches).sort_values("seq")
        for r in rows.itertuples():
            if r.kind == "ask":
                claims.setdefault(r.claim, (int(r.level), int(r.seq)))
            else:
                claims.pop(r.claim, None)
        if claims:
            names = sorted(claims)
            state.update((names, [claims[c][0] for c in names], [claims[c][1] for c in names]))
        elif state.exists:
            state.remove()
        level, seq = min(claims.values()) if claims else (-1, -1)
        yield pd.DataFrame({"key": [key[0]], "level": [level], "seq": [seq], "claims": [len(claims)]})

    return events.groupBy("key").applyInPandasWithState(update, OUT, "names array<string>, levels array<long>, seqs array<long>", "update", "NoTimeout")


def wanted_now(events: DataFrame) -> DataFrame:
    """The same for a bounded table: chunks with live claims, finest level first, then the earliest asked.

    A claim is live when its chunk was asked for and not cancelled later.
    """
    cancelled = events.where("kind = 'cancel'").groupBy("key", "claim").agg(F.max("seq").alias("cancelled"))
    asks = events.where("kind = 'ask'").join(cancelled, ["key", "claim"], "left").where("cancelled is null or seq > cancelled")
    live = asks.groupBy("key", "claim").agg(F.min(F.struct("seq", "level")).alias("first"))
    return live.groupBy("key").agg(F.min(F.struct("first.level", "first.seq")).alias("m"), F.count("*").alias("claims")).select("key", "m.level", "m.seq", "claims")
