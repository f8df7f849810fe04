"""State folded from append-only logs: runs of wins, pending misses, circuit breakers, limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR, COOLDOWN, RETRY, MOST_RETRY, PER_HOUR, CONCURRENT = 3600, 600, 120, 3600, 6, 2
BENCH_AFTER, BENCH_FOR = 3, 120


def current_runs(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """How often in a row the newest winner of each key has won. ``log``: key, kind (lookup or miss), winner, partial.

    A partial lookup neither adds nor breaks. A run ends at a miss or at another winner. Gaps and islands in one window.
    """
    w = W.partitionBy(key).orderBy(*order)
    counted = log.where((F.col("kind") == "miss") | ~F.coalesce("partial", F.lit(False)))
    won = F.when(F.col("kind") == "lookup", F.col("winner"))
    rows = counted.withColumn("won", won).withColumn("before", F.lag("won").over(w))
    broke = F.when(F.col("won").eqNullSafe(F.col("before")) & F.col("won").isNotNull(), 0).otherwise(1)
    rows = rows.withColumn("island", F.sum(broke).over(w.rowsBetween(W.unboundedPreceding, 0)))
    islands = rows.groupBy(key, "island").agg(F.max("won").alias("winner"), F.count("won").alias("wins"))
    last = F.max_by(F.struct("winner", "wins"), "island")
    return islands.groupBy(key).agg(last.alias("r")).select(key, "r.winner", "r.wins")


def pending_misses(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys whose last miss is neither approved nor dropped since: key, actual, wrong (top of the lookup before the miss), tries."""
    w = W.partitionBy(key).orderBy(*order)
    top = F.last(F.when(F.col("kind") == "lookup", F.coalesce("top", F.lit(""))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = log.withColumn("seq", F.row_number().over(w)).withColumn("wrong", F.nullif(top, F.lit("")))
    at = lambda kinds: F.coalesce(F.max(F.when(F.col("kind").isin(kinds), F.col("seq"))), F.lit(0))
    of_miss = lambda c: F.max_by(F.when(F.col("kind") == "miss", F.col(c)), F.when(F.col("kind") == "miss", F.col("seq")))
    state = rows.groupBy(key).agg(
        at(["miss"]).alias("missed"), at(["approve", "drop"]).alias("closed"), of_miss("actual").alias("actual"), of_miss("wrong").alias("wrong"),
        F.max(F.struct(F.when(F.col("kind") == "try", F.col("seq")).alias("seq"), F.col("tries").alias("tries"))).alias("tried"),
    )
    tries = F.when(F.col("tried.seq") > F.col("missed"), F.col("tried.tries")).otherwise(0)
    return state.where("missed > closed").select(key, "actual", "wrong", tries.alias("tries"))


def breaker(log: DataFrame, key: str, order: list[str], now: Column) -> DataFrame:
    """Failures since the last success, mean latency, and whether the key is benched at ``now`` (seconds).

    ``log``: key, ok, stale, latency, at (seconds). A stale outcome counts neither way but its latency does.
    """
    w = W.partitionBy(key).orderBy(*order)
    real = ~F.coalesce("stale", F.lit(False))
    good = F.sum(F.when(real & F.col("ok"), 1).otherwise(0)).over(w.rowsBetween(1, W.unboundedFollowing))
    rows = log.withColumn("later_success", F.coalesce(good, F.lit(0)))
    failed = real & ~F.col("ok") & (F.col("later_success") == 0)
    state = rows.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("fails"), F.avg("latency").alias("latency"), F.max(F.when(failed, F.col("at"))).alias("failed_at"))
    benched = (F.col("fails") >= BENCH_AFTER) & (now - F.col("failed_at") < BENCH_FOR)
    return state.select(key, "calls", "fails", "latency", F.coalesce(benched, F.lit(False)).alias("benched"))


def trace_counts(traces: DataFrame, outcomes: DataFrame) -> DataFrame:
    """right, wrong and unlabelled traces (lookup_id); of several outcomes (lookup_id, result, seq) the last counts."""
    last = outcomes.groupBy("lookup_id").agg(F.max_by("result", "seq").alias("result"))
    rows = traces.select("lookup_id").distinct().join(last, "lookup_id", "left")
    label = F.when(F.col("result").isNull(), "unlabelled").when(F.col("result") == "right", "right").otherwise("wrong")
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


class Limiter:
    """Admissions of one principal: over all its pointers at most PER_HOUR in a trailing hour and CONCURRENT at a time; for each
    pointer one at a time, a cooldown after success, a doubling wait after failure."""

    def __init__(self, attempts=(), last=None, retry=None, fails=0):
        self.attempts = list(attempts)
        self.last = {} if last is None else {None: last}
        self.retry = {} if retry is None else {None: retry}
        self.fails = {} if not fails else {None: fails}
        self.running: dict = {}  # pointer: when its attempt ends, and how

    def settle(self, at: float) -> None:
        """End the attempts that are over by ``at``, in order of their ends."""
        for pointer, (end, began, ok) in sorted(self.running.items(), key=lambda x: (x[1][0], str(x[0]))):
            if end <= at:
                del self.running[pointer]
                self._judge(pointer, began, end, ok)

    def _judge(self, pointer, began: float, end: float, ok: bool) -> None:
        if ok:
            self.fails.pop(pointer, None)
            return
        self.fails[pointer] = fails = self.fails.get(pointer, 0) + 1
        self.retry[pointer] = end + min(MOST_RETRY, RETRY * 2 ** min(fails - 1, 20))
        if began in self.attempts:
            self.attempts.remove(began)

    def ask(self, at: float, ok: bool, pointer=None, lasts: float = 0.0) -> str:
        """admitted, cooldown, rate-limited, busy or in-progress; ``ok``: how an admitted attempt ends, ``lasts`` later. A failed one gives its slot back."""
        self.settle(at)
        until = self.retry.get(pointer, self.last[pointer] + COOLDOWN if pointer in self.last else at)
        if until > at:
            return "cooldown"
        recent = [t for t in self.attempts if at - t < HOUR]
        if len(recent) >= PER_HOUR:
            return "rate-limited"
        if len(self.running) - (pointer in self.running) >= CONCURRENT:
            return "busy"
        if pointer in self.running:
            return "in-progress"
        self.attempts, self.last[pointer] = [*recent, at], at
        self.retry.pop(pointer, None)
        if lasts > 0:
            self.running[pointer] = (at + lasts, at, ok)
        else:
            self._judge(pointer, at, at, ok)
        return "admitted"


def admissions(requests: DataFrame, key: str, pointer: str | None = None, lasts: str | None = None) -> DataFrame:
    """Verdict of each request (key, seq, at, ok), in order within its key; of a ``pointer`` of its own and taking ``lasts`` seconds, if named.

    An admission depends on the earlier ones, which no window frame expresses. Keys are spread over partitions and sorted there, and one
    limiter's few numbers (and one for each of its pointers) are all that a task holds, however many requests a key has.
    """
    kind = requests.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = object(), Limiter()
        for batch in batches:
            told = []
            for k, at, ok, p, n in zip(batch[key], batch["at"], batch["ok"], batch["_pointer"], batch["_lasts"], strict=True):
                if k != current:
                    current, limiter = k, Limiter()
                told.append(limiter.ask(at, bool(ok), p, n))
            yield pd.DataFrame({key: batch[key], "seq": batch["seq"], "verdict": told})

    own = (F.col(pointer).cast("string") if pointer else F.lit("")).alias("_pointer")
    takes = (F.col(lasts).cast("double") if lasts else F.lit(0.0)).alias("_lasts")
    rows = requests.select(key, "seq", F.col("at").cast("double").alias("at"), "ok", own, takes).repartition(key).sortWithinPartitions(key, "at", "seq")
    return rows.mapInPandas(fold, f"{key} {kind}, seq long, verdict string")
