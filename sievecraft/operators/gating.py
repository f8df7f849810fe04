"""Validation of scored answers, the gate over passes, folding, coverage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, SLACK = 0.01, 1e-9
# Outcome kinds, the worst first.
KINDS = ("unaccounted", "failed_validation", "unanswered", "insufficient_evidence", "review", "abstain", "accepted")


def answer_problem(
    kind: Column, keys: Column, probabilities: Column, choice: Column, score: Column, confidence: Column, noul: Column, by_total: bool = False
) -> Column:
    """What is wrong with an answer, or null. ``keys``: the levels that were asked; ``probabilities``: map by level.

    A value above 1 breaks the distribution; ``by_total`` leaves it to the test of the total, whose tolerance it then has.
    """
    unit = lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    same_keys = (F.size(F.map_keys(probabilities)) == F.size(keys)) & (F.size(F.array_except(keys, F.map_keys(probabilities))) == 0)
    usable = (lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))) if by_total else unit
    shape = unit(confidence) & same_keys & F.forall(values, usable)
    scale = F.when(F.abs(total - 1) > SLACK, total).otherwise(1.0)
    peak = F.array_max(values) / scale
    chosen = F.coalesce(F.try_element_at(probabilities, choice) / scale, F.lit(-1.0))
    expected = F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda s, e: s + e["key"].cast("double") * e["value"]) / scale
    levels = F.size(keys) - 1
    return (
        F.when(kind == "noul", F.when(~F.coalesce(unit(noul), F.lit(False)), "probability"))
        .when(~F.coalesce(shape, F.lit(False)), "distribution")
        .when(F.abs(total - 1) > STEP + SLACK, "total")
        .when((kind == "choice") & (~F.coalesce(F.array_contains(keys, choice), F.lit(False)) | (chosen + STEP + SLACK < peak)), "choice")
        .when((kind == "score") & ~F.coalesce(score.between(0, levels), F.lit(False)), "score")
        .when((kind == "score") & (F.abs(score - expected) > STEP * levels + STEP + SLACK), "expectation")
    )


def peak(probabilities: Column) -> Column:
    """Largest probability over their sum; null without a usable distribution."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    usable = (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & (x >= 0)) & (total > 0)
    return F.when(usable, F.array_max(values) / F.nullif(total, F.lit(0.0)))


def noul_value(noul: Column) -> tuple[Column, Column]:
    """Value and confidence of a yes-or-no probability."""
    return F.when(noul >= 0.5, "true").otherwise("false"), F.abs(noul - 0.5) * 2


def beats_none(choice: Column, probabilities: Column, none: str = "none") -> Column:
    """A real choice that is likelier than none, where both are known."""
    p, q = F.try_element_at(probabilities, choice), F.try_element_at(probabilities, F.lit(none))
    return (choice != none) & F.coalesce(p > q, F.lit(True))


def outcomes(
    records: DataFrame, passes: DataFrame, gate: float = 0.75, tolerance: float = 0.05, abstain: str | None = None, agreement: bool = True
) -> DataFrame:
    """One outcome for each record (id, evidence_problem): kind, value, confidence.

    ``passes``: id, pass, answered, malformed, value, confidence, peak. The order of the tests is the policy. Passes are combined by
    aggregates, map-side, so no record's passes are gathered.
    """
    answered = passes.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("answered").alias("n_answered"),
        F.count_if(F.col("malformed")).alias("n_malformed"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.min_by("value", "pass").alias("first"),
        F.min("confidence").alias("lowest"),
        F.count_if(F.col("confidence") - F.col("peak") > tolerance + SLACK).alias("overclaims"),
    )
    rows = records.join(answered, "id", "left")
    problem = F.col("evidence_problem").isNotNull()
    n = F.coalesce("n", F.lit(0))
    disagree = F.lit(agreement) & (F.col("least") != F.col("most"))
    abstains = (F.col("least") == abstain) & (F.col("most") == abstain) if abstain is not None else F.lit(False)
    kind = (
        F.when(problem & (n == 0), "insufficient_evidence")
        .when((n == 0) | (F.col("n_answered") == 0), "unanswered")
        .when(F.col("n_answered") < n, "review")
        .when(F.col("n_malformed") > 0, "failed_validation")
        .when(problem, "insufficient_evidence")
        .when(disagree, "review")
        .when(abstains, "abstain")
        .when((F.col("overclaims") > 0) | (F.col("lowest") < gate), "review")
        .otherwise("accepted")
    )
    told = (n > 0) & (F.col("n_answered") == n) & (F.col("n_malformed") == 0)
    value = F.when(told & (problem | ~disagree), F.col("first"))
    return rows.select("id", kind.alias("kind"), value.alias("value"), F.when(told, F.col("lowest")).alias("confidence"))


def severity(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def fold_kinds(cells: DataFrame, key: str = "id") -> DataFrame:
    """Worst kind and lowest confidence of the cells of each record."""
    worst = F.element_at(F.array(*map(F.lit, KINDS)), F.min(severity(F.col("kind"))).cast("int"))
    return cells.groupBy(key).agg(worst.alias("kind"), F.min("confidence").alias("min_confidence"))


def reask(first: DataFrame, second: DataFrame, lo: float = 0.70, hi: float = 0.90) -> DataFrame:
    """Records (id, kind, min_confidence) whose confidence lies in [lo, hi) are accepted only if both passes accept, else reviewed."""
    again = second.select("id", F.col("kind").alias("kind2"))
    band = (F.col("min_confidence") >= lo) & (F.col("min_confidence") < hi)
    both = F.when((F.col("kind") == "accepted") & (F.col("kind2") == "accepted"), "accepted").otherwise("review")
    return first.join(again, "id", "left").select("id", F.when(band, both).otherwise(F.col("kind")).alias("kind"), F.coalesce(band, F.lit(False)).alias("asked_again"))


def manifest(records: DataFrame, outcome: DataFrame) -> DataFrame:
    """Coverage: id, kind, state (once, repeated, unknown, missing) for every id on either side."""
    asked = records.groupBy("id").agg(F.count(F.lit(1)).alias("asked"))
    told = outcome.groupBy("id").agg(F.count(F.lit(1)).alias("told"), F.min("kind").alias("kind"))
    rows = asked.join(told, "id", "full_outer")
    state = (
        F.when(F.col("asked").isNull(), "unknown").when(F.col("told").isNull(), "missing").when((F.col("told") > 1) | (F.col("asked") > 1), "repeated").otherwise("once")
    )
    return rows.select("id", F.coalesce("kind", F.lit("unaccounted")).alias("kind"), state.alias("state"))


def by_kind(rows: DataFrame) -> DataFrame:
    """Number of records of every kind, those without any too."""
    every = rows.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return F.broadcast(every).join(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def mapping(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Asked keys against answered ones: answered, missing or rejected."""
    rows = asked.select("key", "id").join(answers.select("key", F.lit(True).alias("came")), "key", "full_outer")
    return rows.select("key", "id", F.when(F.col("id").isNull(), "rejected").when(F.col("came").isNull(), "missing").otherwise("answered").alias("state"))


def merge_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each question over evidence parts: a contradiction wins, else support, else the surest; highest confidence within."""
    weight = F.when(F.col("verdict") == "CONTRADICTED", 2).when(F.col("verdict") == "SUPPORTED", 1).otherwise(0)
    best = F.max(F.struct(weight.alias("weight"), "confidence", (-F.col("part")).alias("part"), "verdict"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.verdict", "b.confidence")


def claim_verdicts(files: DataFrame, claim: str = "claim", sure: float = 0.9) -> DataFrame:
    """TRUE, FALSE, CONFLICT, PARTIAL, UNSURE or NOT FOUND for each claim, of (claim, verdict, prob) by file."""
    has = lambda v: F.bool_or((F.col("verdict") == v) & (F.col("prob") >= sure))
    told = files.groupBy(claim).agg(
        has("supported").alias("yes"), has("contradicted").alias("no"), has("partly").alias("part"), F.bool_or(F.col("verdict") != "not_stated").alias("leans")
    )
    word = F.when(F.col("yes") & F.col("no"), "CONFLICT").when(F.col("yes"), "TRUE")
    return told.select(claim, word.when(F.col("no"), "FALSE").when(F.col("part"), "PARTIAL").when(F.col("leans"), "UNSURE").otherwise("NOT FOUND").alias("word"))


def organised(rows: DataFrame, gate: float = 0.75, other: str = "other") -> DataFrame:
    """Ids (category, id, confidence) of each category, those that need a review in a bucket of their own."""
    review = (F.col("confidence") < gate) | (F.col("category") == other)
    groups = rows.groupBy(F.when(review, "review").otherwise(F.col("category")).alias("bucket"))
    return groups.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def costs(calls: DataFrame, group: str) -> DataFrame:
    """Calls, tokens and retries of each run, and whether any of its calls was only estimated."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return calls.groupBy(group).agg(F.count(F.lit(1)).alias("calls"), total("input_tokens"), total("output_tokens"), total("retries"), F.bool_or("estimated").alias("estimated"))
