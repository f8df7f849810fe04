"""A word index of files that is kept up to date file by file, and the shortlist that a search takes from it.

Tables: files (path, set, person, sha, passages, size), postings (path, word, n), vocabulary (word, n: files that have it), stats.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sievecraft.functions.text import bound_once
from sievecraft.operators.word_search import words
from sievecraft.plans.lineage import cut

K1, B = 1.2, 0.75
SHORTLIST = 200
#: Sought words up to which they are broadcast.
MOST_SOUGHT = 100_000


@dataclass
class Index:
    files: DataFrame
    postings: DataFrame


def counted(w: Column) -> Column:
    """A map from the different words of an array to the number of times each occurs, by one sort of the array."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))

        def runs(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s) + 1))
            return F.zip_with(at, ends, lambda a, z: F.struct(F.get(s, a - 1), (z - a).cast("long")))

        return F.when(F.size(s) > 0, bound_once(starts, runs))

    return F.map_from_entries(bound_once(F.sort_array(w), of))


def index_files(files: DataFrame) -> Index:
    """Index of files (path, set, person, sha, text, passages), each path once. Null text has no words. Words are counted where the text lies, so postings are not shuffled."""
    w = words(F.coalesce("text", F.lit("")))
    listed = files.select("path", "set", F.coalesce("person", F.lit("")).alias("person"), "sha", "passages", F.size(w).cast("long").alias("size"))
    return Index(listed, files.select("path", F.explode(counted(w)).alias("word", "n")))


def updated(index: Index, changed: DataFrame, gone: DataFrame) -> Index:
    """The index after ``changed`` files (as for index_files) and ``gone`` ones (path): only their rows are made anew."""
    new = index_files(changed)
    old = changed.select("path").unionByName(gone.select("path")).distinct()
    replaced = lambda a, b: a.join(old, "path", "left_anti").unionByName(b)
    return Index(replaced(index.files, new.files), replaced(index.postings, new.postings))


def vocabulary(postings: DataFrame) -> DataFrame:
    """word and n, the number of files that have it."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bigrams(vocabulary_: DataFrame) -> DataFrame:
    """gram, word: the distinct pairs of neighbouring characters of each word."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    return vocabulary_.where(F.length("word") > 1).select(F.explode(F.array_distinct(grams)).alias("gram"), "word")


def stats(files: DataFrame) -> DataFrame:
    """Files, passages and words of each set and person."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return files.groupBy("set", "person").agg(F.count(F.lit(1)).alias("n"), total("passages"), total("size"))


def scoped(rows: DataFrame, sets: list[str], people: list[str] = ()) -> DataFrame:
    """Rows (set, person) of the named sets and, where people are named, of them or of nobody."""
    rows = rows.where(F.col("set").isin(*sets))
    return rows.where((F.col("person") == "") | F.col("person").isin(*people)) if people else rows


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two words are: twice their matching characters over all of them, by longest common blocks."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def variants(terms: DataFrame, vocabulary_: DataFrame, synonyms: DataFrame | None = None, least: float = 0.8, most: int = 3) -> DataFrame:
    """term, word: the words of a vocabulary that count as each term (term).

    They are the ``most`` most alike words of ``least`` at least (of terms over three letters; they share a pair of characters, by which they are found), words
    with the term's first five letters (or the whole of a shorter term and at most two letters more), and synonyms (term, word).
    """
    own = terms.distinct().withColumn("word", F.col("term"))
    grams = bigrams(own.where(F.length("term") > 3).select("word")).select("gram", F.col("word").alias("term")).distinct()
    pairs = grams.join(bigrams(vocabulary_), "gram").select("term", "word").distinct()
    size = lambda c: F.length(c)
    possible = 2 * F.least(size("term"), size("word")) / (size("term") + size("word")) >= least
    near = pairs.where(possible).withColumn("r", likeness("term", "word")).where(F.col("r") >= least)
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("r"), F.desc("word")))
    near = near.withColumn("rank", rank).where(F.col("rank") <= most).select("term", "word")
    stem = F.when(size("term") > 5, F.substring("term", 1, 5)).otherwise(F.col("term"))
    stems = terms.distinct().select("term", stem.alias("stem"))
    heads = vocabulary_.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.substring(F.col("word"), F.lit(1), n)))).alias("stem"))
    ends = stems.join(heads, "stem").where((size("term") > 5) | (size("word") - size("term") <= 2)).select("term", "word")
    found = near.unionByName(ends)
    if synonyms is not None:
        found = found.unionByName(synonyms.join(terms, "term", "left_semi").join(vocabulary_, "word", "left_semi").select("term", "word"))
    return found.distinct()


def shortlist(index: Index, query: DataFrame, sets: list[str], people: list[str] = (), k: int = SHORTLIST) -> DataFrame:
    """The ``k`` files in scope that match the words of ``query`` (term, word) best by BM25: path, score. Ties fall to the path; a top k is what a shortlist is.

    A term counts all of its words as one, and is as rare as the files that have any of them.
    """
    files = scoped(index.files, sets, people)
    numbers = files.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("average")).first()
    # a semi-join on the word alone, where it is broadcast, goes below the counting of postings, so words that nobody asks for are not shuffled
    sought = cut(query.select("word").distinct())
    asked = index.postings.join(F.broadcast(sought) if sought.count() <= MOST_SOUGHT else sought, "word", "left_semi")
    hits = asked.join(query.distinct(), "word").join(files.select("path", "size"), "path")
    hits = hits.groupBy("path", "size", "term").agg(F.sum("n").alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(numbers.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("size") / F.lit(float(numbers.average or 1.0)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    scores = hits.join(df, "term").groupBy("path").agg(F.sum(part).alias("s"))
    return scores.select("path", (F.floor(F.col("s") * 1000 + 0.5) / F.lit(1000.0)).alias("score")).orderBy(F.desc("score"), "path").limit(k)


def with_rows(candidates: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates (path, sha) with the label and the item (path, sha, value) that were made of just these bytes; null where they are of others."""
    rows = candidates.join(labels.select("path", "sha", F.col("value").alias("label")), ["path", "sha"], "left")
    return rows.join(items.select("path", "sha", F.col("value").alias("item")), ["path", "sha"], "left")


def picked_chunks(chunks: DataFrame, terms: list[str], budget: int, cost: Column | None = None) -> DataFrame:
    """Chunks (path, number, text) to read of each file, at most ``budget`` characters of it: all if they fit, else the best by BM25 within the file, over
    first four letters, the earlier first; from a file without more matches only the next from its top.

    A file's chunks are scored where they lie, but counted and picked in order by a stream over sorted rows, which holds one running sum.
    """
    paid = cost if cost is not None else F.length("text") + F.when(F.col("number") > 0, 105).otherwise(0)
    stems = F.transform(words(F.col("text")), lambda w: F.substring(w, 1, 4))
    tf = F.transform(F.array(*[F.lit(t[:4]) for t in terms]), lambda t: F.size(F.filter(F.col("_stems"), lambda w: w == t)))
    rows = chunks.withColumn("_stems", stems).withColumn("_tf", tf if terms else F.array().cast("array<int>")).drop("_stems")
    rows = rows.select("path", "number", paid.cast("long").alias("cost"), F.greatest(F.length("text"), F.lit(1)).alias("size"), F.col("_tf").alias("tf"))
    totals = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("average"), F.sum("cost").alias("all"), *[F.count_if(F.col("tf")[k] > 0).alias(f"d{k}") for k in range(len(terms))])
    rows = rows.join(totals, "path")
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        score = score + idf * F.col("tf")[k] * 2.2 / (F.col("tf")[k] + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("average")))
    ranked = rows.select("path", "number", "cost", "all", F.round(score, 9).alias("score"))
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("path", "number")}

    def pick(batches):
        path, used, done = None, 0, False
        for batch in batches:
            kept = []
            for p, c, total, s in zip(batch["path"], batch["cost"], batch["all"], batch["score"], strict=True):
                if p != path:
                    path, used, done = p, 0, False
                fits = total <= budget or (not done and used + c <= budget)
                done = done or (not fits and not s)
                used += c if fits else 0
                kept.append(fits)
            yield batch[kept][["path", "number"]]

    ordered = ranked.repartition("path").sortWithinPartitions("path", F.desc("score"), "number")
    return ordered.mapInPandas(pick, f"path {kind['path']}, number {kind['number']}")
