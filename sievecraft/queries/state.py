"""Queries over the event log: runs, pending misses, breakers, limits, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.operators import logs as L
from sievecraft.queries.documents import table
from sievecraft.queries.evaluation import d, digit


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.unix_timestamp("ts").cast("double"))


def w1_current_runs(spark, sf_dir):
    """Each user's events as asks: the winner is one of three, some events are misses and some partial."""
    key = F.col("event_id")
    log = events(spark, sf_dir).select(
        "user_id", "ts", "event_id", F.when(digit("k", key, 11) == 0, "miss").otherwise("lookup").alias("kind"), (digit("w", key, 3)).alias("winner"), (digit("p", key, 7) == 0).alias("partial")
    )
    return L.current_runs(log, "user_id", ["ts", "event_id"])


def w2_pending_misses(spark, sf_dir):
    key = F.col("event_id")
    kinds = F.array(*[F.lit(x) for x in ("lookup", "lookup", "miss", "try", "approve", "drop", "lookup", "miss")])
    log = events(spark, sf_dir).select(
        "user_id", "ts", "event_id", F.element_at(kinds, digit("k", key, 8) + 1).alias("kind"), F.when(digit("t", key, 5) > 0, F.concat(F.lit("f"), digit("t", key, 50))).alias("top"),
        F.concat(F.lit("a"), key).alias("actual"), digit("n", key, 5).alias("tries"),
    )
    return L.pending_misses(log, "user_id", ["ts", "event_id"])


def t3_breaker(spark, sf_dir):
    key = F.col("event_id")
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "at", (digit("o", key, 3) == 0).alias("ok"), (digit("s", key, 6) == 0).alias("stale"), (digit("l", key, 900) / F.lit(4.0)).alias("latency"))
    last = F.lit(1.0) * F.unix_timestamp(F.lit("2024-01-31 00:00:00"))
    return L.breaker(rows, "user_id", ["ts", "event_id"], last).select("user_id", "calls", "fails", "benched", F.round("latency", 6).alias("latency"))


def t1_admissions(spark, sf_dir):
    """Verdicts of the limiter over each user's events, of one of three pointers and lasting a while: ordered state that SQL doesn't express."""
    key = F.col("event_id")
    rows = events(spark, sf_dir).select("user_id", key.alias("seq"), "at", (digit("o", key, 3) > 0).alias("ok"), digit("p", key, 3).alias("pointer"), digit("t", key, 900).alias("lasts"))
    return L.admissions(rows, "user_id", "pointer", "lasts")


def a14_trace_counts(spark, sf_dir):
    """All events as outcomes; unlabelled traces are made for all users."""
    rows = events(spark, sf_dir)
    outcomes = rows.select(F.col("user_id").alias("lookup_id"), F.when(digit("r", F.col("event_id"), 4) > 0, "right").otherwise("wrong").alias("result"), F.col("event_id").alias("seq"))
    traces = rows.select(F.col("user_id").alias("lookup_id")).unionByName(rows.select((-F.col("user_id") - 1).alias("lookup_id")))
    return L.trace_counts(traces, outcomes)


QUERIES = {"w1_current_runs": w1_current_runs, "w2_pending_misses": w2_pending_misses, "t3_breaker": t3_breaker, "t1_admissions": t1_admissions, "a14_trace_counts": a14_trace_counts}
SQL = {
    "w1_current_runs": f"""
        WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN {d('k', 'event_id', 11)} <> 0 THEN {d('w', 'event_id', 3)} END AS won
                   FROM events WHERE {d('k', 'event_id', 11)} = 0 OR {d('p', 'event_id', 7)} <> 0),
        l AS (SELECT user_id, max(k) AS last, max_by(coalesce(won, -1), k) AS winner FROM x GROUP BY user_id),
        b AS (SELECT x.user_id, max(k) FILTER (coalesce(won, -1) <> winner) AS broke FROM x JOIN l USING (user_id) GROUP BY x.user_id)
        SELECT l.user_id, nullif(winner, -1) AS winner, CASE WHEN winner = -1 THEN 0 ELSE last - coalesce(broke, 0) END AS wins FROM l JOIN b USING (user_id)""",
    "w2_pending_misses": f"""
        WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, (['lookup', 'lookup', 'miss', 'try', 'approve', 'drop', 'lookup', 'miss'])[{d('k', 'event_id', 8)} + 1] AS kind,
                          CASE WHEN {d('t', 'event_id', 5)} > 0 THEN 'f' || {d('t', 'event_id', 50)} END AS top, 'a' || event_id AS actual, {d('n', 'event_id', 5)} AS tries FROM events),
        m AS (SELECT user_id, max(k) FILTER (kind = 'miss') AS missed, max(k) FILTER (kind IN ('approve', 'drop')) AS closed, max(k) FILTER (kind = 'try') AS tried FROM x GROUP BY user_id),
        o AS (SELECT * FROM m WHERE missed > coalesce(closed, 0)),
        t AS (SELECT o.user_id, max(k) AS k FROM o JOIN x USING (user_id) WHERE kind = 'lookup' AND k < missed GROUP BY o.user_id)
        SELECT o.user_id, a.actual, w.top AS wrong, CASE WHEN tried > missed THEN y.tries ELSE 0 END AS tries
        FROM o JOIN x a ON a.user_id = o.user_id AND a.k = o.missed LEFT JOIN t ON t.user_id = o.user_id LEFT JOIN x w ON w.user_id = o.user_id AND w.k = t.k LEFT JOIN x y ON y.user_id = o.user_id AND y.k = o.tried""",
    "t3_breaker": f"""
        WITH x AS (SELECT user_id, epoch(date_trunc('second', ts)) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {d('o', 'event_id', 3)} = 0 AS ok, {d('s', 'event_id', 6)} = 0 AS stale, {d('l', 'event_id', 900)} / 4.0 AS latency FROM events),
        g AS (SELECT user_id, max(k) AS good FROM x WHERE ok AND NOT stale GROUP BY user_id),
        s AS (SELECT x.user_id, count(*) AS calls, count(*) FILTER (NOT ok AND NOT stale AND k > coalesce(good, 0)) AS fails, max(sec) FILTER (NOT ok AND NOT stale AND k > coalesce(good, 0)) AS failed, round(avg(latency), 6) AS latency
              FROM x LEFT JOIN g USING (user_id) GROUP BY x.user_id)
        SELECT user_id, calls, fails, coalesce(fails >= 3 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - failed < 120, false) AS benched, latency FROM s""",
    "a14_trace_counts": f"""
        WITH o AS (SELECT user_id AS id, max_by(CASE WHEN {d('r', 'event_id', 4)} > 0 THEN 'right' ELSE 'wrong' END, event_id) AS result FROM events GROUP BY user_id),
        t AS (SELECT user_id AS id FROM events UNION SELECT -user_id - 1 FROM events)
        SELECT coalesce(result, 'unlabelled') AS label, count(*) AS n FROM t LEFT JOIN o USING (id) GROUP BY 1""",
}
