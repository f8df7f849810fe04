"""Lexical ranking: BM25 with weighted fields, context and negatives; margins and gates over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once, tokens

K1, B = 1.2, 0.75
UTTERANCE_WEIGHT, NEGATIVE_WEIGHT, CONTEXT_WEIGHT = 2, 1.0, 0.35
FLOOR, MARGIN = 0.60, 0.10


def round_half_up(x: Column, digits: int = 3) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, which rounds halves of negative numbers up as well."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale))


def term_frequencies(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """key, term, tf, len. The terms of a row stay one array until they are exploded; counts combine map-side."""
    rows = docs.select(F.col(key), words.alias("words")).withColumn("len", F.size("words"))
    return rows.select(key, "len", F.explode("words").alias("term")).groupBy(key, "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, words: Column) -> DataFrame:
    """term and df, its number of documents."""
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _query(spark, text: str) -> list[str]:
    words = spark.range(1).select(F.array_distinct(tokens(F.lit(text))).alias("w")).first().w
    return list(words)


def _counted(text: Column, query: list[str]) -> Column:
    """Struct of the number of tokens of a text and, for each query term, how often it has it. One pass: what is no form of a query term is dropped before it is counted.

    A token is a query term if it is the term or its plural, as tokens() folds it.
    """
    forms = {q: [q, *([f"{q}s"] if len(q) > 2 and not q.endswith("s") else [])] for q in query}
    low = F.lower(text)
    hits = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w.isin(*[f for fs in forms.values() for f in fs])) if query else F.array().cast("array<string>")
    counts = bound_once(hits, lambda h: F.array(*[F.size(F.filter(h, lambda w: w.isin(*fs))) for fs in forms.values()]))  # noqa: B023  read at once
    return F.struct(F.regexp_count(low, F.lit("[a-z0-9]{2,}")).alias("n"), (counts if query else F.array().cast("array<int>")).alias("tf"))


def _bm25(length: Column, tf: Column, query: list[str], every: list[str], df: dict[str, int], n: int, average: float) -> Column:
    """Score of a row by the counts ``tf`` of ``every`` term, over the terms of the query."""
    score = F.lit(0.0)
    norm = K1 * (1 - B + B * length / F.lit(average))
    for q in query:
        k = tf[every.index(q)]
        idf = F.log(F.lit(1 + (n - df.get(q, 0) + 0.5) / (df.get(q, 0) + 0.5)))
        score = score + F.when(k > 0, idf * (k * (K1 + 1)) / (k + norm)).otherwise(0.0)
    return score


def prefilter(catalog: DataFrame, request: str, n: int, context: list[str] = (), order: str = "pos") -> DataFrame:
    """The ``n`` rows of a catalog that match a request best, with score (rounded), by (score, ``order``).

    ``catalog``: id, pos, text, utterances, negatives (arrays or null). Utterances count twice; negatives are scored against
    the same frequencies and taken off; context turns count 0.35. All rows with score 0 if n is 0 or not smaller than the catalog.
    The corpus statistics of the query's few terms are one aggregate row, so the corpus is scanned twice and never shuffled.
    """
    spark = catalog.sparkSession
    joined = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    primary, extra = _query(spark, request), _query(spark, " ".join(context))
    every = list(dict.fromkeys([*primary, *extra]))
    rows = catalog.withColumns({"_text": _counted(F.coalesce("text", F.lit("")), every), "_spoken": _counted(joined("utterances"), every), "_negative": _counted(joined("negatives"), every)})
    both = F.zip_with("_text.tf", "_spoken.tf", lambda a, b: a + UTTERANCE_WEIGHT * b)
    rows = rows.withColumns({"_n": F.col("_text.n") + UTTERANCE_WEIGHT * F.col("_spoken.n"), "_tf": both}).drop("_text", "_spoken")
    has = [F.count_if(F.col("_tf")[k] > 0).alias(f"q{k}") for k in range(len(every))]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("total"), *has).first()
    if n == 0 or stats.n <= n:
        return catalog.withColumn("score", F.lit(0.0))
    df = {q: stats[f"q{k}"] for k, q in enumerate(every)}
    average = (stats.total or 0) / stats.n or 1.0
    own, denied = (F.col("_n"), F.col("_tf")), (F.col("_negative.n"), F.col("_negative.tf"))
    score = _bm25(*own, primary, every, df, stats.n, average)
    if extra:
        score = score + CONTEXT_WEIGHT * _bm25(*own, extra, every, df, stats.n, average)
    score = score - NEGATIVE_WEIGHT * _bm25(*denied, every if extra else primary, every, df, stats.n, average)
    best = rows.withColumn("_score", score).drop("_n", "_tf", "_negative").orderBy(F.desc("_score"), order).limit(n)
    return best.withColumn("score", round_half_up(F.col("_score"))).drop("_score")


def top_chunks(chunks: DataFrame, request: str, k: int) -> DataFrame:
    """The k chunks that match best over all sources; ties of the rounded score fall to the identity (id)."""
    catalog = chunks.withColumns({"utterances": F.lit(None).cast("array<string>"), "negatives": F.lit(None).cast("array<string>")})
    return prefilter(catalog, request, k, order="id").orderBy(F.desc("score"), "id")


def ranked(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def margins(rows: DataFrame, group: list[str]) -> DataFrame:
    """For each group of ranked rows (rank, id, confidence): top id, its confidence, and its lead over rank 2 (its own if alone)."""
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return rows.groupBy(*group).agg(
        at(1, "id").alias("top_id"),
        at(1, "confidence").alias("top_confidence"),
        (at(1, "confidence") - F.coalesce(at(2, "confidence"), F.lit(0.0))).alias("margin"),
    )


def none_gate(rows: DataFrame, group: list[str], floor: float = FLOOR, margin: float = MARGIN, direct_fit: bool = False) -> DataFrame:
    """act or ask for each group of ranked rows (rank, id, score, confidence, beats): act needs the floor, the margin, and with
    ``direct_fit`` a top score of 1. Asking names the first three of all rows, whether or not they beat none."""
    best = margins(ranked(rows.where("beats"), group, [F.col("rank")]), group)
    top_score = rows.where("beats").groupBy(*group).agg(F.min_by("score", "rank").alias("top_score"))
    names = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "id"))))
    every = rows.groupBy(*group).agg(F.array_join(F.transform(names, lambda x: x["id"].cast("string")), ", ").alias("candidates"))
    joined = every.join(best, group, "left").join(top_score, group, "left")
    act = (F.col("top_confidence") >= floor) & (F.round("margin", 9) >= margin)
    if direct_fit:
        act = act & (F.col("top_score") == 1)
    return joined.withColumn("action", F.when(act, "act").otherwise("ask"))


def file_score(best: Column, none: Column, passages: Column, confirm: float = 0.85, least: float = 0.6, cap: float = 0.84) -> Column:
    """Best passage's score plus half of the mass that neither it nor none took. A file of one passage, an unknown none, or a best below
    ``least`` keeps its score; below ``confirm`` the credit can't lift it over ``cap``."""
    blended = F.greatest(best, best + 0.5 * (1 - none - best))
    return F.when((passages < 2) | none.isNull() | (best < least), best).when(best >= confirm, blended).otherwise(F.least(blended, F.lit(cap)))


def tightest_near_top(rows: DataFrame, group: list[str], within: float = 0.02) -> DataFrame:
    """Of each group's rows (id, score, span) within ``within`` of its best score, that with the fewest lines, then the best score, then id."""
    best = rows.groupBy(*group).agg(F.max("score").alias("best"))
    near = rows.join(best, group).where(F.round(F.col("best") - F.col("score"), 9) <= within)
    pick = F.min(F.struct("span", (-F.col("score")).alias("minus"), "id"))
    return near.groupBy(*group).agg(pick.alias("p")).select(*group, "p.id", "p.span")


def gold_ranks(ranked_rows: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """1-based rank of the first gold id of each group (null: not listed). ``ranked_rows``: group, id, rank; ``gold``: group, id."""
    hits = gold.join(ranked_rows, [group, "id"], "left")
    return hits.groupBy(group).agg(F.min("rank").alias("rank"))
