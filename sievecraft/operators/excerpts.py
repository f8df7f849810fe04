"""What a writer reads of a file: its headings and start, and of a long one passages taken evenly over the rest; and a description quoted from that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once

# Sizes of an excerpt.
HEADS, MORE_HEADS, HEAD_CHARS, START, SAMPLE_OVER, SAMPLES, SAMPLE_CHARS, QUOTED_WORDS = 15, 10, 200, 1200, 12_000, 8, 350, 60


def headings(text: Column) -> Column:
    """The first HEADS headings, and of the rest MORE_HEADS taken evenly, the last among them."""

    def shown(found: Column) -> Column:
        n = F.size(found) - HEADS
        place = lambda i: F.get(found, (F.lit(HEADS) + F.floor(i * n / MORE_HEADS)).cast("int"))
        even = F.concat(F.transform(F.sequence(F.lit(0), F.lit(MORE_HEADS - 2)), place), F.array(F.get(found, F.size(found) - 1)))
        more = F.when(n > MORE_HEADS, even).otherwise(F.slice(found, HEADS + 1, F.greatest(n, F.lit(0))))
        return F.concat(F.slice(found, 1, HEADS), F.transform(more, lambda h: F.substring(h, 1, HEAD_CHARS)))

    return bound_once(F.transform(F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("#")), lambda x: F.trim(x)), shown)


def samples(text: Column) -> Column:
    """Passages of a text of over SAMPLE_OVER characters, each from the line start behind an even place, cut at a word, none inside the one before; else none."""
    kind = "struct<last:int,found:array<string>>"
    none = F.array().cast("array<string>")

    def step(s: Column, i: Column) -> Column:
        span = F.length(text) - START
        # the place of the newline is the number of characters before the passage
        at = F.position(F.lit("\n"), text, (F.lit(START + 1) + F.floor(i * span / SAMPLES)).cast("int"))

        def taken(here: Column) -> Column:
            chunk = F.substr(text, here + 1, F.lit(SAMPLE_CHARS))
            whole = here + SAMPLE_CHARS >= F.length(text)
            shown = F.regexp_replace(F.when(whole, chunk).otherwise(F.regexp_replace(chunk, r"(?s)^(.+)[ \n][^ \n]*$", "$1")), r"^\s+|\s+$", "")
            free = (here > 0) & ((F.size(s["found"]) == 0) | (here >= s["last"] + SAMPLE_CHARS)) & (shown != "")
            return F.when(free, F.struct(here.alias("last"), F.concat(s["found"], F.array(shown)).alias("found"))).otherwise(s).cast(kind)

        return bound_once(at, taken)

    start = F.struct(F.lit(0).alias("last"), none.alias("found")).cast(kind)
    found = F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), start, step, lambda s: s["found"])
    return F.when(F.length(text) > SAMPLE_OVER, found).otherwise(none)


def excerpt(text: Column) -> Column:
    """Struct of headings, start and samples. Null is as empty."""
    parts = lambda t: F.struct(headings(t).alias("headings"), F.substring(t, 1, START).alias("start"), samples(t).alias("samples"))
    return bound_once(F.coalesce(text, F.lit("")), parts)


def quoted(path: Column, shown: Column) -> Column:
    """Struct of description, question and subject, quoted from an excerpt (``shown``): the title, up to four sections and the first words, or the first words alone."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    marks = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def words_of(start: Column) -> Column:
        body = F.filter(F.split(start, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
        return F.slice(F.filter(F.split(F.array_join(F.transform(body, lambda x: F.trim(x)), " "), r"\s+"), lambda w: w != ""), 1, QUOTED_WORDS)

    def said(s: Column) -> Column:
        say = lambda n: F.array_join(F.slice(s["words"], 1, n), " ")
        title = F.get(s["heads"], F.lit(0))
        sections = F.concat(F.lit(" with sections "), F.array_join(F.transform(F.slice(s["heads"], 2, 4), marks), ", "))
        begins = F.when(F.size(s["words"]) > 0, F.concat(F.lit(" It begins: "), marks(say(QUOTED_WORDS)))).otherwise("")
        with_title = F.concat(F.lit("This file is titled "), marks(title), F.when(F.size(s["heads"]) > 1, sections).otherwise(""), F.lit("."), begins)
        bare = F.concat(F.lit("This file begins: "), marks(say(QUOTED_WORDS)))
        question = F.when(title.isNotNull(), F.concat(F.lit("What does "), title, F.lit(" say?"))).otherwise(F.concat(F.lit("Which file says "), say(8), F.lit("?")))
        subject = F.array_join(F.slice(F.filter(F.split(F.coalesce(title, name), r"\s+"), lambda w: w != ""), 1, 4), " ")
        return F.struct(F.when(title.isNotNull(), with_title).otherwise(bare).alias("description"), question.alias("question"), subject.alias("subject"))

    heads = lambda s: F.filter(F.transform(s["headings"], lambda h: F.trim(F.regexp_replace(h, "^#+", ""))), lambda h: h != "")
    both = lambda s: F.struct(heads(s).alias("heads"), words_of(s["start"]).alias("words"))
    return bound_once(bound_once(shown, both), said)
