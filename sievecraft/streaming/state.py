"""Streaming forms of the log folds: keyed state over an append-only stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievecraft.operators.logs import Limiter


def current_runs(events: DataFrame) -> DataFrame:
    """Current run of wins of each key. ``events``: key, seq, kind (lookup or miss), winner, partial; rows of a key come in order of seq.

    Emits a row (key, winner, wins) for each batch in which the key has events, with the state after it.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        winner, wins = state.get if state.exists else (None, 0)
        for e in pd.concat(frames).sort_values("seq").itertuples():
            if e.kind == "miss":
                winner, wins = None, 0
            elif not e.partial:
                winner, wins = e.winner, (wins + 1 if e.winner == winner else 1)
        state.update((winner, wins))
        yield pd.DataFrame({"key": [key[0]], "winner": [winner], "wins": [wins]})

    return events.select("key", "seq", "kind", "winner", "partial").groupBy("key").applyInPandasWithState(fold, "key string, winner string, wins long", "winner string, wins long", "update", GroupStateTimeout.NoTimeout)


def admissions(requests: DataFrame) -> DataFrame:
    """Verdicts of the rate limiter over a stream. ``requests``: key, seq, at (seconds), ok. The state is one limiter's few numbers."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, last, retry, fails = state.get if state.exists else ([], None, None, 0)
        limiter = Limiter(attempts, last, retry, fails)
        rows = pd.concat(frames).sort_values(["at", "seq"])
        told = [limiter.ask(at, bool(ok)) for at, ok in zip(rows["at"], rows["ok"], strict=True)]
        state.update((limiter.attempts, limiter.last.get(None), limiter.retry.get(None), limiter.fails.get(None, 0)))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"], "verdict": told})

    return requests.groupBy("key").applyInPandasWithState(
        fold, "key string, seq long, verdict string", "attempts array<double>, last double, retry double, fails long", "append", GroupStateTimeout.NoTimeout
    )


def labelled_traces(traces: DataFrame, outcomes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Traces (lookup_id, ts) with the result of an outcome (lookup_id, result, ts) that follows within the delay; late ones stay without."""
    a = traces.withWatermark("ts", delay).alias("t")
    b = outcomes.withWatermark("ts", delay).alias("o")
    near = (F.col("o.ts") >= F.col("t.ts")) & (F.col("o.ts") <= F.col("t.ts") + F.expr(f"INTERVAL {delay}"))
    return a.join(b, (F.col("t.lookup_id") == F.col("o.lookup_id")) & near, "leftOuter").select("t.lookup_id", "t.ts", "o.result")
