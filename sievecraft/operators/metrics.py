"""Evaluation metrics over labelled outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.operators.ranking import round_half_up


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def scored(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counts and rates of (kind, value, expected) for each group."""
    hit = F.coalesce(F.col("value") == F.col("expected"), F.lit(False))
    is_kind = lambda k: F.count_if(F.col("kind") == k)
    counted = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("correct"),
        is_kind("accepted").alias("accepted"),
        F.count_if((F.col("kind") == "accepted") & ~hit).alias("accepted_wrong"),
        is_kind("review").alias("review"),
        is_kind("abstain").alias("abstain"),
    )
    return with_rates(counted)


def with_rates(counted: DataFrame) -> DataFrame:
    names = {"accuracy": "correct", "coverage": "accepted", "error_rate": "accepted_wrong", "review_rate": "review", "abstain_rate": "abstain"}
    return counted.withColumns({k: round_half_up(rate(F.col(v), F.col("total")), 6) for k, v in names.items()})


def combined(counted: DataFrame) -> DataFrame:
    """All groups together: counts add, rates are made anew."""
    counts = ["total", "correct", "accepted", "accepted_wrong", "review", "abstain"]
    return with_rates(counted.agg(*[F.sum(c).alias(c) for c in counts]))


def latencies(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Median (of an even number the mean of the middle two, half rounded up) and nearest-rank 95th percentile of whole numbers."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.floor(F.expr(f"percentile({value}, 0.5)") + 0.5).cast("long").alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").cast("long").alias("p95"),
    )


def retrieval(rows: DataFrame) -> DataFrame:
    """hit@1 and hit@5 of answerable requests, precision and recall of no-match; 1 where nothing can be counted.

    ``rows``: expected_id (null: no match is right), rank of the expected id (null: not listed), no_match.
    """
    answerable, absent = F.col("expected_id").isNotNull(), F.col("expected_id").isNull()
    hit = lambda k: F.count_if(answerable & ~F.col("no_match") & (F.col("rank") <= k))
    share = lambda a, b: round_half_up(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 6)
    right = F.count_if(absent & F.col("no_match"))
    return rows.agg(
        share(hit(1), F.count_if(answerable)).alias("hit_at_1"),
        share(hit(5), F.count_if(answerable)).alias("hit_at_5"),
        share(right, F.count_if("no_match")).alias("no_match_precision"),
        share(right, F.count_if(absent)).alias("no_match_recall"),
    )


def unstable(runs: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases (run, case, key, choice) whose decisions differ between runs, and in how many ways.

    A run's decisions are told by their number and two sums of their hashes, which combine map-side: no case's decisions are gathered.
    """
    decisions = runs.select("run", case, F.md5(F.concat_ws("=", "key", "choice")).alias("h"), "key").distinct()
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)"))
    digest = F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(13).cast("string"))
    digests = decisions.groupBy("run", case).agg(digest.alias("digest"))
    return digests.groupBy(case).agg(F.countDistinct("digest").alias("digests")).where("digests > 1")
