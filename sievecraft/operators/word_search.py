"""Word search over files: the best passage of a file decides, with head words, phrases, coverage and a floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once, passages
from sievecraft.operators.ranking import round_half_up
from sievecraft.plans.lineage import cut

HEAD_COUNT, PHRASE_WEIGHT, LEAST_COVERAGE, RELATIVE_FLOOR = 3, 0.7, 0.5, 0.55


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def question_terms(question: str, stopwords: frozenset[str] = frozenset()) -> tuple[list[str], list[tuple[str, str]]]:
    """Distinct words of over two characters, and the pairs of different words that stand side by side."""
    found = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in question.lower()).split() if len(w) > 2 and w not in stopwords]
    pairs = dict.fromkeys((a, b) for a, b in zip(found, found[1:], strict=False) if a != b)
    return list(dict.fromkeys(found)), list(pairs)


def word_search(files: DataFrame, question: str, limit: int, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """path, score of the files (path, head, text) that match the question's words best, by (score, path).

    A passage is scored by BM25 over its words and, counted three times, the words of the head; two question words side by side add
    0.7 of their mean weight. A file needs half of the weight of the words that occur at all, and 0.55 of the best score. Statistics are one
    aggregate row; the passages of a file stay in its row, so only the best rows move.
    """
    terms, pairs = question_terms(question, stopwords)
    if not terms:
        return files.select("path", F.lit(0.0).alias("score")).limit(0)
    counted = lambda array, t: F.size(F.filter(array, lambda w: w == t))

    def passage(p: Column) -> Column:
        return bound_once(words(p["passage"]), counts)

    def counts(w: Column) -> Column:
        content = F.transform(F.filter(w, lambda x: F.length(x) > 2), lambda x: F.substring(x, 1, 4))
        joined = F.concat(F.lit(" "), F.array_join(content, " "), F.lit(" "))
        held = lambda j: F.array(*[F.contains(j, F.lit(f" {a[:4]} {b[:4]} ")) for a, b in pairs])
        has = bound_once(joined, held) if pairs else F.array().cast("array<boolean>")
        return F.struct(F.size(w).alias("n"), F.array(*[counted(w, t) for t in terms]).alias("tf"), has.alias("has"))

    head = words(F.coalesce("head", F.lit("")))
    files = files.withColumn("_passages", passages("text"))
    rows = cut(files.select(  # a few numbers for each passage, computed once
        "path",
        (F.size(head) * HEAD_COUNT).alias("head_size"),
        F.array(*[counted(head, t) * HEAD_COUNT for t in terms]).alias("head_tf"),
        F.transform("_passages", passage).alias("parts"),
    ))
    present = [F.exists("parts", lambda p: p["tf"][k] > 0) | (F.col("head_tf")[k] > 0) for k in range(len(terms))]  # noqa: B023
    rows = rows.withColumn("present", F.array(*present))
    sizes = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"] + F.col("head_size"))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(sizes).alias("size"), F.sum(F.size("parts")).alias("parts"), *[F.count_if(F.col("present")[k]).alias(f"d{k}") for k in range(len(terms))]
    ).first()
    df = [stats[f"d{k}"] for k in range(len(terms))]
    average = (stats["size"] or 0) / (stats["parts"] or 1) or 1.0
    idf_rows = files.sparkSession.range(1).select(*[F.log(F.lit(1 + (stats["n"] - d + 0.5) / (d + 0.5))).alias(f"i{k}") for k, d in enumerate(df)]).first()
    idf = dict(zip(terms, idf_rows, strict=True))
    total = sum(i for i, d in zip(idf_rows, df, strict=True) if d) or 1.0

    def score(p: Column) -> Column:
        norm = 1.2 * (0.25 + 0.75 * (p["n"] + F.col("head_size")) / F.lit(average))
        s = F.lit(0.0)
        for k, t in enumerate(terms):
            tf = p["tf"][k] + F.col("head_tf")[k]
            s = s + F.lit(idf[t]) * tf * 2.2 / (tf + norm)
        for k, (a, b) in enumerate(pairs):
            s = s + F.when(p["has"][k], PHRASE_WEIGHT * (idf[a] + idf[b]) / 2).otherwise(0.0)
        return s

    covered = sum((F.when(F.col("present")[k], F.lit(idf[t])).otherwise(0.0) for k, t in enumerate(terms)), F.lit(0.0))
    scored = rows.where(covered / total >= LEAST_COVERAGE - 1e-9).select("path", round_half_up(F.array_max(F.transform("parts", score))).alias("score"))
    best = scored.agg(F.max("score").alias("best")).first().best
    return scored.where(F.col("score") >= F.lit(best) * RELATIVE_FLOOR).orderBy(F.desc("score"), "path").limit(limit).select("path", "score")
