"""Search of a catalog of named entries: exact names, requests that say too little, and the status of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import tokens
from sievecraft.operators.ranking import FLOOR, MARGIN

# Words that carry no content, as tokens.
FILLER = frozenset(
    "it its this thi that these those them they their he him his she her we us our you your me my thing stuff something anything everything nothing whatever "
    "what which who whom whose how why when where do did done doing can could would should will shall may might must the an and or but of to in on for with at by "
    "from as is are was were be been being have has had having please no not yes if then than there here so just very too such".split()
)
# Verbs that say nothing alone, and pronouns that name nothing.
VAGUE = frozenset("update check fix change modify set add remove restart run start stop".split())
PRONOUNS = frozenset("it thi this that these those them".split())


def _in(word: Column, words: frozenset) -> Column:
    return word.isin(*sorted(words))


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda w: ~_in(w, FILLER))


def underspecified(request: Column, context: Column) -> Column:
    """True for a request that can't be searched: no content word in it or its context, or a vague verb and a pronoun alone."""
    content = content_tokens(request)
    vague = (F.size(content) == 1) & _in(F.get(content, F.lit(0)), VAGUE) & F.exists(tokens(request), lambda w: _in(w, PRONOUNS))
    return (F.size(content_tokens(F.coalesce(context, F.lit("")))) == 0) & ((F.size(content) == 0) | vague)


def plain_name(request: Column) -> Column:
    """A request as a name: trimmed, lower case, without a leading slash, quotes around it and marks behind it."""
    bare = F.regexp_replace(F.lower(F.trim(request)), "^/", "")
    return F.trim(F.regexp_replace(bare, "^[\"'`]+|[\"'`,.;:!?]+$", ""))


def exact_names(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests (request_id, text) that are the name of one entry (id, name) alone: request_id, id."""
    named = entries.groupBy(F.lower("name").alias("_name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1 and _name <> ''")
    return requests.select("request_id", plain_name(F.col("text")).alias("_name")).join(named, "_name").select("request_id", "id")


def search_status(requests: DataFrame, entries: DataFrame, judged: DataFrame) -> DataFrame:
    """status of each request (request_id, text, context): exact, clarify, suggestions, no_match or fallback, the id where it is exact, and asked:
    whether an answer decided. ``judged``: request_id, complete, no_match, n_ranked, top_confidence, margin.

    Names and requests without content need no answer. Without an answer, or with one that covers too little or ranks nothing, only local results are
    left (fallback). An answer that is not sure enough, by the floor or the margin, calls for a question (clarify).
    """
    rows = requests.join(exact_names(requests, entries), "request_id", "left").join(judged, "request_id", "left")
    exact, vague = F.col("id").isNotNull(), underspecified(F.col("text"), F.col("context"))
    failed = F.col("complete").isNull() | ~F.col("complete") | (~F.col("no_match") & (F.coalesce("n_ranked", F.lit(0)) == 0))
    sure = (F.col("top_confidence") >= FLOOR) & (F.round("margin", 9) >= MARGIN)
    told = F.when(F.coalesce("complete", F.lit(False)) & F.col("no_match"), "no_match").when(failed, "fallback").when(sure, "suggestions").otherwise("clarify")
    status = F.when(exact, "exact").when(vague, "clarify").otherwise(told)
    return rows.select("request_id", "id", status.alias("status"), (~exact & ~vague).alias("asked"))
