"""The end of a search: what reads as an answer, in which order, and what a last choice among a few changes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievecraft.operators.holdings import copy_kind, is_hub, stem
from sievecraft.operators.search_index import likeness

SOURCE_FLOOR, PROMOTE, CONFIRM, SUBJECT_FLOOR = 0.6, 0.9, 0.85, 0.6
TWIN_GAP, TWIN_NAMES, TWINS = 0.05, 0.5, 3
# Months by number; words before may that make it a verb.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NOT_A_MONTH_BEFORE = "will can could would should might must how what who which why where when i you we they he she it that this there one".split()


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Case-folded, without accents; plain ASCII texts are only put in lower case."""

    def fold(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t and t.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))

    return texts.map(fold)


def folded_words(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(question: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct folded words of over two characters that are no stopwords; apostrophes join."""
    words = folded_words(F.regexp_replace(question, "['’]", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stopwords) if stopwords else F.length(w) > 2))


def term_hits(terms: Column, low: Column) -> Column:
    """How many terms a folded text has; a term of over five letters also by its first five."""
    return F.size(F.filter(terms, lambda t: F.contains(low, t) | ((F.length(t) > 5) & F.contains(low, F.substring(t, 1, 5)))))


def subject_matches(terms: Column, low: Column, least: float = SUBJECT_FLOOR) -> Column:
    """Whether a text has enough of the terms; always without terms."""
    return (F.size(terms) == 0) | (term_hits(terms, low) / F.greatest(F.size(terms), F.lit(1)) >= least)


def best_lines(lines: DataFrame, group: list[str], hits: Column, place: str) -> DataFrame:
    """Of each group's lines that of the most ``hits``, the earliest of them: place, text and hits."""
    best = F.max_by(F.struct(place, "text", hits.alias("hits")), F.struct(hits, -F.col(place)))
    return lines.groupBy(*group).agg(best.alias("b")).select(*group, f"b.{place}", "b.text", "b.hits")


def dates(text: Column) -> Column:
    """Dates that a folded text names, as array of (year, month, day), null for a part it leaves out: numbers like 2026-09-08 and names of months before a day; else years."""
    number = lambda c: c.cast("int")
    kind = "array<struct<y:int,m:int,d:int>>"
    full = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])((?:19|20)[0-9]{2}-[0-9]{2}(?:-[0-9]{2})?)(?![A-Za-z0-9_])"), F.lit(1)), lambda x: F.struct(number(F.substring(x, 1, 4)).alias("y"), number(F.substring(x, 6, 2)).alias("m"), number(F.nullif(F.substring(x, 9, 2), F.lit(""))).alias("d"))).cast(kind)
    spoken = F.regexp_extract_all(text, F.lit(r"(?<![a-z])((?:[a-z]+ )?[a-z]+\.? [0-9]{1,2})(?:st|nd|rd|th)?(?![A-Za-z0-9_])"), F.lit(1))
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])

    def month_day(x: Column) -> Column:
        parts = F.split(x, " ")
        name = F.regexp_replace(F.element_at(parts, -2), r"\.$", "")
        before = F.when(F.size(parts) > 2, parts[0]).otherwise("")
        known = name.isin(*MONTHS, *[m[:3] for m in MONTHS]) & ~((name == "may") & before.isin(*NOT_A_MONTH_BEFORE))
        day = number(F.element_at(parts, -1))
        return F.when(known & day.between(1, 31), F.struct(F.lit(None).cast("int").alias("y"), F.array_position(names, F.substring(name, 1, 3)).cast("int").alias("m"), day.alias("d")))

    found = F.array_distinct(F.concat(full, F.array_compact(F.transform(spoken, month_day)).cast(kind)))
    return F.when(F.size(found) > 0, found).otherwise(years(text))


def years(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])"), F.lit(1))
    none = F.lit(None).cast("int")
    return F.array_distinct(F.transform(found, lambda x: F.struct(x.cast("int").alias("y"), none.alias("m"), none.alias("d"))))


def name_dates(path: Column) -> Column:
    """Dates in the last two parts of a path: whole ones, else years."""
    parts = F.split(path, "/")
    name = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), " ")
    found = F.regexp_extract_all(name, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2}-[0-9]{2}(?:-[0-9]{2})?)(?![0-9])"), F.lit(1))
    full = F.transform(found, lambda x: F.struct(F.substring(x, 1, 4).cast("int").alias("y"), F.substring(x, 6, 2).cast("int").alias("m"), F.nullif(F.substring(x, 9, 2), F.lit("")).cast("int").alias("d")))
    none = F.lit(None).cast("int")
    only = F.transform(F.regexp_extract_all(name, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda x: F.struct(x.cast("int").alias("y"), none.alias("m"), none.alias("d")))
    return F.array_distinct(F.when(F.size(full) > 0, full).otherwise(only))


def dates_agree(asked: Column, named: Column) -> Column:
    """true if a named date fits an asked one, parts that are left out fitting any; false if none does; null if a side names none."""
    part = lambda a, b, c: a[c].isNull() | b[c].isNull() | (a[c] == b[c])
    fits = F.exists(asked, lambda a: F.exists(named, lambda b: part(a, b, "y") & part(a, b, "m") & part(a, b, "d")))
    return F.when((F.size(asked) > 0) & (F.size(named) > 0), fits)


def plural_forms(word: Column) -> Column:
    """A word and its plain plural and singular forms."""
    singular = F.when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    shorter = F.when(word.endswith("es"), F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(word)
    return F.array_distinct(F.array(word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), singular, shorter))


def name_bonus(terms: Column, path: Column, weight: float = 1.0) -> Column:
    """Weight of the terms (array of term and idf) that a path's name or folder has, and half of those that only a folder above has; as words or plain plurals."""
    parts = F.split(F.lower(path), "/")
    of = lambda xs: F.filter(F.split(F.array_join(xs, " "), "[^a-z0-9]+"), lambda w: w != "")
    own = of(F.array(F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", ""), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")))
    above = of(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))))
    worth = lambda t: F.when(F.arrays_overlap(plural_forms(t["term"]), own), t["idf"]).when(F.arrays_overlap(plural_forms(t["term"]), above), t["idf"] * 0.5).otherwise(0.0)
    return weight * F.aggregate(F.transform(terms, worth), F.lit(0.0), lambda s, x: s + x)


def final_order(files: DataFrame, group: str, most: int = 5) -> DataFrame:
    """Files (group, path, content, inconclusive, held, route, read_rank) that are listed: group, path, score, possible, rank up to ``most``.

    A file whose own content was read needs the floor; one whose check did not finish is listed as possible, by its route; what is held is never listed.
    Read files come first, by content, then route, then the order of reading.
    """
    sure = F.coalesce(F.col("content").between(SOURCE_FLOOR, 1), F.lit(False))
    kept = files.where(~F.col("held") & (sure | F.col("inconclusive"))).withColumn("possible", ~sure)
    score = F.when(F.col("possible"), F.coalesce("route", F.lit(0.0))).otherwise(F.col("content"))
    order = [F.col("inconclusive"), F.desc("score"), F.coalesce("route", F.lit(0.0)).desc(), F.col("read_rank").asc_nulls_last(), F.desc("path")]
    ranked = kept.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select(group, "path", "score", "possible", "rank")


def with_choice(listed: DataFrame, choices: DataFrame, group: str) -> DataFrame:
    """Listed files (group, path, score, possible, rank) after a choice among them (group, winner, prob; a winner none answers nothing): place, score, possible.

    The winner moves to the front unless it is a hub or a copy behind a file of its own. Likely enough it is confirmed, and the others become possible; none, likely
    enough, drops what was only possible and leaves the rest as possible.
    """
    rows = listed.join(choices, group, "left")
    strong = F.coalesce(F.col("prob") >= PROMOTE, F.lit(False))
    stands_for = is_hub(F.col("path")) | copy_kind(F.col("path")).isNotNull()
    won = F.col("path") == F.col("winner")
    at = rows.groupBy(group).agg(F.max(F.when(won, F.col("rank"))).alias("won_at"), F.max(F.when(won, stands_for)).alias("won_hub"), F.min(F.when(~stands_for, F.col("rank"))).alias("first_own"))
    rows = rows.join(at, group)
    blocked = F.col("won_at").isNull() | (F.col("won_hub") & F.coalesce(F.col("first_own") < F.col("won_at"), F.lit(False)))
    none = F.coalesce((F.col("winner") == "none") & strong, F.lit(False))
    rows = rows.where(~(none & F.col("possible")))
    moved = F.coalesce(won & ~blocked, F.lit(False))
    place = F.row_number().over(W.partitionBy(group).orderBy((~moved), "rank"))
    confirmed = moved & strong
    score = F.when(confirmed & F.col("possible"), F.greatest("score", F.lit(CONFIRM))).otherwise(F.col("score"))
    possible = F.when(none, True).when(confirmed, False).when(strong & ~blocked, True).otherwise(F.col("possible"))
    return rows.select(group, "path", place.alias("place"), score.alias("score"), F.coalesce(possible, F.lit(False)).alias("possible"))


def near_twins(listed: DataFrame, group: str) -> DataFrame:
    """Groups whose first files (group, path, score, rank) are near twins, and how many: the first and those of the first three within a gap of its score, if the first two
    share a folder or have names alike and none stands for other files."""
    head = listed.where(F.col("rank") <= TWINS)
    best = head.where("rank = 1").select(group, F.col("path").alias("best_path"), F.col("score").alias("best"))
    close = head.join(best, group).where(F.round(F.col("best") - F.col("score"), 9) <= TWIN_GAP)
    second = F.min(F.when(F.col("rank") > 1, F.struct("rank", "path")))
    rows = close.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.first("best_path").alias("a"), second.alias("s"), F.bool_or(is_hub(F.col("path")) | copy_kind(F.col("path")).isNotNull()).alias("hub")).where("n > 1 and not hub")
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    rows = rows.select(group, "n", "a", F.col("s.path").alias("b")).withColumn("alike", likeness(stem(F.col("b")), stem(F.col("a"))))
    return rows.where((folder(F.col("a")) == folder(F.col("b"))) | (F.col("alike") >= TWIN_NAMES)).select(group, "n")


def newest(pieces: DataFrame, group: list[str]) -> DataFrame:
    """The newest piece (place, turn_rank, kind) of each group: highest rank, then latest; a header or a piece of unknown turn never is."""
    known = pieces.where("turn_rank is not null and kind <> 'header'")
    return known.groupBy(*group).agg(F.max(F.struct("turn_rank", "place")).alias("p")).select(*group, "p.place", "p.turn_rank")
