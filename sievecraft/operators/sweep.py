"""Questions asked of records: cells, answers that come back, what was read of them, and the ranking of a fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.operators import gating as G
from sievecraft.operators.relational import SAFE, negative_hits, phrase_hits, triggers

# Scores of the levels of fit.
LEVELS = (("high", 1.0), ("medium", 2 / 3), ("low", 1 / 3), ("none", 0.0))


def question_problem(name: Column, options: Column) -> Column:
    """Why a question (name, map of options to descriptions) can't be asked, or null."""
    described = F.forall(F.map_values(options), lambda d: F.coalesce(F.trim(d) != "", F.lit(False)))
    return F.when(~F.coalesce(name.rlike(SAFE), F.lit(False)), "name").when(F.coalesce(F.size(options), F.lit(0)) < 2, "options").when(~described, "description")


def checked_questions(questions: DataFrame) -> DataFrame:
    """Questions (name, options) with problem: as question_problem, or a name that is repeated."""
    counts = questions.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    own = question_problem(F.col("name"), F.col("options"))
    return questions.join(counts, "name").select("name", F.coalesce(own, F.when(F.col("n") > 1, "repeated")).alias("problem"))


def cells(records: DataFrame, questions: list[str]) -> DataFrame:
    """Every question of every record (id, key, pos): id, question, logical_key, wire_key. The questions are a short stated list, so rows are multiplied where they lie."""
    asked = F.posexplode(F.array(*map(F.lit, questions))).alias("q", "question")
    rows = records.select("id", "key", "pos", asked)
    wire = F.concat_ws("_", F.lit("q"), "question", "key")
    fallback = F.concat(F.lit("q"), F.col("q").cast("string"), F.lit("_r"), F.col("pos").cast("string"))
    logical = F.concat_ws(".", F.lit("q"), "question", F.col("id").cast("string"))
    return rows.select("id", "question", logical.alias("logical_key"), F.when(wire.rlike(SAFE), wire).otherwise(fallback).alias("wire_key"))


def answered_cells(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Cells (wire_key, ...) with their answers (wire_key, kind, keys, probabilities, choice, score, confidence, noul): state valid, missing or
    what answer_problem finds, and ``unasked`` for answers of no cell. A broken answer costs its own cell only."""
    c = F.col
    told = answers.withColumn("_problem", G.answer_problem(c("kind"), c("keys"), c("probabilities"), c("choice"), c("score"), c("confidence"), c("noul"))).withColumn("_came", F.lit(True))
    rows = asked.withColumn("_asked", F.lit(True)).join(told, "wire_key", "full_outer")
    state = F.when(c("_asked").isNull(), "unasked").when(c("_came").isNull(), "missing").otherwise(F.coalesce("_problem", F.lit("valid")))
    kept = [x for x in asked.columns if x != "wire_key"]
    return rows.select("wire_key", *kept, state.alias("state"), F.when(state == "valid", c("choice")).alias("choice"), F.when(state == "valid", c("confidence")).alias("confidence"), F.when(state == "valid", G.peak(c("probabilities"))).alias("peak"))


def sweep_outcomes(cells_: DataFrame, gate: float = 0.75) -> DataFrame:
    """One row for each record of answered_cells: the worst kind of its cells and the lowest confidence."""
    asked = cells_.where("state <> 'unasked'")
    kind = (
        F.when(F.col("state") == "missing", "unanswered")
        .when(F.col("state") != "valid", "failed_validation")
        .when((F.col("confidence") < gate) | (F.col("confidence") - F.col("peak") > 0.05 + G.SLACK), "review")
        .otherwise("accepted")
    )
    return G.fold_kinds(asked.withColumn("kind", kind), "id")


def allowed(outcomes: DataFrame) -> DataFrame:
    """The outcomes on which an action may be taken: accepted ones."""
    return outcomes.where("kind = 'accepted'")


def level_score(level: Column) -> Column:
    score = F.when(F.lit(False), 0.0)
    for name, value in LEVELS:
        score = score.when(level == name, value)
    return score


def fetch(answers: DataFrame, k: int, none: str = "none") -> DataFrame:
    """Judged rows (request, id, level, confidence, p_level, p_none) ranked: request, id, score, confidence, beats, rank (of those
    that beat none; null for the others and beyond ``k``), place (of all with a score). By score, then confidence, then id."""
    beats = (F.col("level") != none) & F.coalesce(F.col("p_level") > F.col("p_none"), F.lit(True))
    rows = answers.where(F.col("level").isNotNull()).withColumn("score", level_score(F.col("level"))).withColumn("beats", beats & F.col("score").isNotNull())
    order = [F.desc("score"), F.desc("confidence"), F.col("id")]
    place = F.row_number().over(W.partitionBy("request").orderBy(F.col("score").isNull(), *order))
    rank = F.row_number().over(W.partitionBy("request", "beats").orderBy(*order))
    rows = rows.withColumn("place", place).withColumn("rank", F.when(F.col("beats") & (rank <= k), rank))
    return rows.where("score is not null").select("request", "id", "score", "confidence", "beats", "rank", "place")


def fetch_summary(answers: DataFrame, none: str = "none") -> DataFrame:
    """For each request: judged rows, whether none won all of them, and then the mean confidence of the nones (3 digits, halves up)."""
    beats = (F.col("level") != none) & F.coalesce(F.col("p_level") > F.col("p_none"), F.lit(True))
    surely = F.when(F.col("level") == none, F.coalesce("confidence", F.lit(0.0))).otherwise(F.coalesce("p_none", F.lit(0.0)))
    rows = answers.where(F.col("level").isNotNull()).groupBy("request").agg(F.count(F.lit(1)).alias("judged"), F.bool_or(beats).alias("any"), F.avg(F.when(~beats, surely)).alias("mean"))
    mean = F.floor(F.col("mean") * 1000 + 0.5) / F.lit(1000.0)
    return rows.select("request", "judged", (~F.col("any")).alias("no_match"), F.when(F.col("any"), 0.0).otherwise(mean).alias("no_match_confidence"))


def pre_rules(requests: DataFrame, catalog: DataFrame, top: DataFrame, floor: float) -> DataFrame:
    """serve, demote, noMatch or fallThrough for each request (request_id, text), and the id it is about.

    One catalog row alone whose trigger the request holds, and none of whose negatives, is served. Else the judge's first
    (``top``: request_id, id, confidence) is demoted where the request holds one of its negatives; without any trigger and below the floor there is no match.
    """
    hits = phrase_hits(requests, triggers(catalog).select("id", "phrase")).select("request_id", "id").distinct()
    denied = negative_hits(requests, catalog).select("request_id", "id").distinct().withColumn("denied", F.lit(True))
    one = hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("owners"), F.min("id").alias("trigger_id"))
    rows = requests.select("request_id").join(one, "request_id", "left").join(top.withColumnRenamed("id", "top_id"), "request_id", "left")
    rows = rows.join(denied.select("request_id", F.col("id").alias("trigger_id"), F.col("denied").alias("trigger_denied")), ["request_id", "trigger_id"], "left")
    rows = rows.join(denied.select("request_id", F.col("id").alias("top_id"), F.col("denied").alias("top_denied")), ["request_id", "top_id"], "left")
    served = (F.col("owners") == 1) & F.col("trigger_denied").isNull()
    demoted = F.col("top_denied").isNotNull()
    nothing = F.col("owners").isNull() & (F.coalesce("confidence", F.lit(0.0)) < floor)
    decision = F.when(served, "serve").when(demoted, "demote").when(nothing, "noMatch").otherwise("fallThrough")
    return rows.select("request_id", decision.alias("decision"), F.when(served, F.col("trigger_id")).when(demoted, F.col("top_id")).alias("id"))


def proposed_utterances(ledger: DataFrame, catalog: DataFrame, key) -> DataFrame:
    """Corrected requests (chosen_id, request) as new utterances of the id chosen: those whose ``key`` no row of the catalog (id, utterances) has for it."""
    known = catalog.select("id", F.explode("utterances").alias("u")).select("id", key(F.col("u")).alias("phrase")).distinct()
    asked = ledger.select(F.col("chosen_id").alias("id"), key(F.col("request")).alias("phrase")).where("phrase <> ''").groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(known, ["id", "phrase"], "left_anti")


def thin_utterances(catalog: DataFrame, least: int = 3) -> DataFrame:
    """Catalog rows (id, utterances) with fewer than ``least`` utterances."""
    n = F.greatest(F.coalesce(F.size("utterances"), F.lit(0)), F.lit(0))
    return catalog.select("id", n.alias("n")).where(F.col("n") < least)
