"""The fold of attempts as a stream: the state of each key after each batch, equal to the batch windows.

An extension: what is folded in order within a batch job arrives here as events. Events are taken in the order of
their times within the batch that brings them; one that comes in a later batch than its successors is folded when it
comes. State is one row for each key. It is kept for ever, or, with ``idle``, until a key has had no event for so long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, seq bigint, best double, final double, tokens bigint"
STATE = "seq bigint, best double, final double, tokens bigint"


def _fold(idle: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, best, final, tokens = state.get if state.exists else (0, 0.0, None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "ord"], kind="stable")
        seq, tokens, scores = seq + len(rows), tokens + int(rows["tokens"].fillna(0).sum()), rows["score"].dropna()
        if len(scores):
            final, best = float(scores.iloc[-1]), max(best, float(scores.max()))
        state.update((seq, best, final, tokens))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "best": [best], "final": [final], "tokens": [tokens]})

    return run


def fold_stream(events: DataFrame, idle: int | None = None) -> DataFrame:
    """(key, at, ord, score, tokens) events to the state of each key, updated with every batch. idle: milliseconds after which
    the state of a key without events is dropped."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return events.select("key", "at", "ord", "score", "tokens").groupBy("key").applyInPandasWithState(_fold(idle), OUT, STATE, "update", timeout)
