"""Facts read off an evidence window and the draft that is judged by it, and claims that facts contradict.

A window and its draft are bounded texts under one key, so what is brought together under a key is bounded too; keys are spread over tasks.
Sentences and patterns are fixed values, since what reads them relies on their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.operators.views import strictness
from sievecraft.operators.windows import NUMBERS
from sievecraft.plans.lineage import cut

#: What \\b means over ASCII, whatever the Java version.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# Patterns of lines and drafts (EDGE stands for a word's edge), and the most facts of a window.
HEADER = r"^\[(?:current turn|current turn reports|previous turn -\d+|session receipts)\]$"
RULE = r"^\s*(?:={3,}|-{3,})\s*$"
IDENTIFIER = r"\b([A-Za-z][A-Za-z0-9_.\-]*(?:::[A-Za-z0-9_.\-]+)+)"
REMOVED = r"^\s*(REMOVED|DELETED|DROPPED)\b\s*:?\s*(.*)$"
DRAFT_REMOVAL = r"(?i)\b(?:deleted|deleting|removed|removing|dropped|dropping|(?:is|are|was|were)\s+gone|got\s+rid\s+of)\b"
CADENCE = r"(?:bus-\d+|untagged\s*->\s*[A-Za-z0-9_.\-]+)\s*\([^)\n]*\)"
EVERY = r"(?i)every\s+([0-9,]+)\s*t\b"
DRAFT_CADENCE = r"(?i)\bevery\s+(?:turn|prompt|message|call)\b|\bevery\s+[0-9,]+\s*(?:t\b|turns?\b)"
UNIVERSAL = r"(?i)\b(?:every|all|each)\b"
N_OF_M = r"\b(\d+)\s*(?:/|\s+of\s+)\s*(\d+)\s+([A-Za-z][A-Za-z0-9_]*(?:[ _-][a-z][A-Za-z0-9_]*){0,2})"
TUPLE_ROW = r"\(\s*'([^']{1,60})'\s*,\s*'([^']{1,40})'\s*,\s*'([^']{1,40})'\s*\)"
MERGE_RECEIPT = r'(?i)^\s*MERGED\b|\bgh\s+pr\s+merge\s+\d+|"mergedAt"\s*:\s*"[^"]+"'
DRAFT_MERGES = (r"(?i)\bPR\s*#(\d+)\b[^.\n]{0,40}?\bmerged\b", r"(?i)\bmerged\b[^.\n]{0,40}?\bPR\s*#(\d+)", r"(?i)#(\d+)\b[^.\n]{0,20}?\bis\s+merged\b")
MERGE_BREAK = r"(?i)\b(?:or|nor|not|unmerged|open|pending|awaiting|instead|except|besides|rather\s+than|other\s+than)\b"
WORD_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
_ANY_NUMBER = rf"(\d{{1,3}}|{'|'.join(WORD_NUMBERS)})"
MERGE_TOTALS = (rf"(?i)\b{_ANY_NUMBER}\s+(?:PRs?|pull\s+requests?)\b[^.\n]{{0,40}}?\bmerged\b", rf"(?i)\bmerged\b[^.\n]{{0,40}}?\b{_ANY_NUMBER}\s+(?:PRs?|pull\s+requests?)\b")
MERGE_UNIVERSAL = r"(?i)\b(?:every|all|each|both)\b[^.\n]{0,70}?\bmerged\b|\bmerged\b[^.\n]{0,40}?\b(?:everything|all of (?:it|them))\b"
MOST_FACTS, MOST_CLAUSES = 24, 25
FAMILIES = ("delete-claim", "cadence", "result-table", "merge-claim")


def edged(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(edged(pattern)), F.lit(group))


def clauses(draft: Column) -> Column:
    """Clauses of a draft, each once in any case, the first MOST_CLAUSES."""
    units = F.transform(F.split(F.trim(draft), r"(?<=[.!?])\s+|;\s*|:\s+(?=\S)|\s+and\s+"), lambda u: F.trim(u))
    first = F.filter(units, lambda u, i: (u != "") & (F.array_position(F.transform(units, F.lower), F.lower(u)) == i + 1))
    return F.slice(first, 1, MOST_CLAUSES)


def cited_lines(windows: DataFrame, key: str = "window_id", text: str = "text") -> DataFrame:
    """(key, line, label, raw): lines with the header that they stand under, without headers, blank lines and rules; spaces at the end are cut."""
    rows = windows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line", "raw"))
    rows = rows.withColumn("raw", F.regexp_replace("raw", r"\s+$", ""))
    bare = F.trim("raw")
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    label = F.coalesce(F.last(F.when(bare.rlike(HEADER), bare), ignorenulls=True).over(order), F.lit("the evidence window"))
    return rows.withColumn("label", label).where((bare != "") & ~bare.rlike(HEADER) & ~F.col("raw").rlike(RULE)).select(key, "line", "label", "raw")


def _identifiers(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_all(text, IDENTIFIER), lambda m: F.regexp_replace(m, r"[.,;:!?)'\"]+$", "")), lambda m: m != ""))


def _mentions(text: Column, ident: Column) -> Column:
    """Whether a text names an identifier, in full or by its last part of four characters or more as a word."""
    tail = F.element_at(F.split(ident, "::"), -1)
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_.:\-])\Q"), tail, F.lit(r"\E(?![A-Za-z0-9_.\-])"))
    return text.contains(ident) | ((F.length(tail) >= 4) & F.rlike(text, pattern))


def _fact(rows: DataFrame, key: str, family: str, step: int, order: Column, sentence: Column) -> DataFrame:
    """Facts of one step of a family; ``order`` (two numbers) ranks them among the step's."""
    return rows.select(key, F.lit(family).alias("family"), F.lit(FAMILIES.index(family) * 10 + step).alias("step"), order.alias("order"), sentence.alias("sentence"))


def _pair(a, b=None) -> Column:
    return F.struct(a.cast("long").alias("a"), (F.lit(0) if b is None else b).cast("long").alias("b"))


def delete_facts(lines: DataFrame, drafts: DataFrame, key: str) -> list[DataFrame]:
    receipts = lines.where(F.col("raw").rlike(edged(REMOVED)))
    named = receipts.select(key, "line", "label", F.posexplode(_identifiers(F.regexp_extract("raw", edged(REMOVED), 2))).alias("at", "ident"))
    removed = named.groupBy(key, "ident").agg(F.min(F.struct("line", "at", "label")).alias("f"))
    known = lines.select(key, "line", F.posexplode(_identifiers(F.col("raw"))).alias("at", "ident")).groupBy(key, "ident").agg(F.min(F.struct("line", "at")).alias("f"))
    claiming = drafts.select(key, F.filter(clauses(F.col("draft")), lambda c: c.rlike(edged(DRAFT_REMOVAL))).alias("clauses")).where(F.size("clauses") > 0)
    claimed = known.join(removed.select(key, "ident"), [key, "ident"], "left_anti").join(claiming, key).where(F.exists("clauses", lambda c: _mentions(c, F.col("ident"))))
    rest = F.substr(F.col("raw"), F.position("ident", "raw"))
    listed = claimed.select(key, "ident", "f").join(lines, key).where(F.col("raw").contains(F.col("ident")) & ~F.col("raw").rlike(edged(REMOVED)))
    listed = listed.withColumn("rest", rest).where(F.size(_all(F.col("rest"), r"\b[0-9,]+\b", 0)) >= 2)
    still = listed.groupBy(key, "ident", "f").agg(F.min(F.struct("line", "label")).alias("l"))
    return [
        _fact(removed, key, "delete-claim", 0, _pair(F.col("f.line"), F.col("f.at")), F.concat("ident", F.lit(" removed per "), "f.label", F.lit("."))),
        _fact(still, key, "delete-claim", 1, _pair(F.col("f.line"), F.col("f.at")), F.concat("ident", F.lit(" still present in "), "l.label", F.lit(" after the claimed removal."))),
    ]


def cadence_facts(lines: DataFrame, drafts: DataFrame, key: str) -> list[DataFrame]:
    asking = drafts.where(F.col("draft").rlike(edged(DRAFT_CADENCE))).select(key, "draft")
    told = lines.withColumn("said", F.regexp_replace(F.regexp_extract("raw", edged(CADENCE), 0), r"\s+", " ")).where("said <> ''")
    named = told.select(key, "line", "label", "said", F.posexplode(_identifiers(F.col("raw"))).alias("at", "ident")).join(asking, key).where(_mentions(F.col("draft"), F.col("ident")))
    first = named.groupBy(key, "ident").agg(F.min(F.struct("line", "at", "label", "said")).alias("f"))
    n = F.nullif(F.replace(F.regexp_extract("f.said", edged(EVERY), 1), F.lit(","), F.lit("")), F.lit("")).try_cast("long")
    tail = F.when(n > 1, F.concat(F.lit(" — that is every "), n.cast("string"), F.lit(" turns, not every turn."))).when(n == 1, " — that is every turn.").otherwise(".")
    return [_fact(first, key, "cadence", 0, _pair(F.col("f.line"), F.col("f.at")), F.concat("ident", F.lit(" cadence in "), "f.label", F.lit(': "'), "f.said", F.lit('"'), tail))]


def table_facts(lines: DataFrame, drafts: DataFrame, key: str) -> list[DataFrame]:
    """Counts of a results table, where the draft claims something of all and names one of the table's labels (a word of four letters or more)."""
    raw = F.col("raw")
    groups = lambda p: F.arrays_zip(*[_all(raw, p, k).alias(f"g{k}") for k in (1, 2, 3)])
    counted = lines.select(key, "line", F.posexplode(groups(N_OF_M)).alias("at", "g")).select(key, "line", "at", *[F.col(f"g.g{k}").alias(f"g{k}") for k in (1, 2, 3)])
    counted = counted.withColumn("label", F.lower(F.regexp_replace("g3", r"\s+", " ")))
    rows = lines.select(key, F.explode(groups(TUPLE_ROW)).alias("g")).select(key, F.col("g.g2").alias("expected"), F.col("g.g3").alias("actual"))
    labels = counted.select(key, "label").unionByName(rows.select(key, F.lower("expected").alias("label"))).unionByName(rows.select(key, F.lower("actual").alias("label")))
    words = labels.select(key, F.explode(F.split("label", "[ _-]+")).alias("word")).where(F.length("word") >= 4)
    universal = drafts.where(F.col("draft").rlike(edged(UNIVERSAL))).select(key, F.lower("draft").alias("draft"))
    asked = words.join(universal, key).where(F.col("draft").contains(F.col("word"))).select(key).distinct()
    number = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    told = counted.join(asked, key, "left_semi")
    sentence = F.concat(F.lit("table shows "), number(F.col("g1")), F.lit(" of "), number(F.col("g2")), F.lit(" "), "label", F.lit("."))
    rows = rows.join(asked, key, "left_semi")
    totals = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(strictness(F.col("expected")).isNull() | strictness(F.col("actual")).isNull()).alias("unknown"),
        F.count_if(strictness(F.col("actual")) > strictness(F.col("expected"))).alias("stricter"), F.count_if(strictness(F.col("actual")) < strictness(F.col("expected"))).alias("looser"),
    )
    actual = rows.groupBy(key, "actual").agg(F.count(F.lit(1)).alias("k")).join(totals, key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("k"), "actual"))
    one = F.concat(F.lit("table shows "), F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" mismatch rows with actual "), "actual", F.lit("."))
    ranked = F.concat(F.lit("table shows "), F.col("stricter").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" mismatch rows stricter than expected, "), F.col("looser").cast("string"), F.lit(" more permissive."))
    return [
        _fact(told, key, "result-table", 0, _pair(F.col("line"), F.col("at")), sentence),
        _fact(actual.withColumn("place", place), key, "result-table", 1, _pair(F.col("place")), one),
        _fact(totals.where("unknown = 0"), key, "result-table", 2, _pair(F.lit(0)), ranked),
    ]


def merge_facts(lines: DataFrame, drafts: DataFrame, key: str) -> list[DataFrame]:
    number = F.coalesce(*[F.nullif(F.regexp_extract("raw", edged(p), 1), F.lit("")) for p in NUMBERS]).try_cast("long")
    receipts = lines.where(F.col("raw").rlike(edged(MERGE_RECEIPT))).withColumn("number", number).where("number is not null")
    found = receipts.groupBy(key, "number").agg(F.min_by("label", "line").alias("label"))
    pairs = F.concat(*[F.arrays_zip(_all(F.col("draft"), p, 0).alias("m"), _all(F.col("draft"), p, 1).alias("n")) for p in DRAFT_MERGES])
    # only the first place of the number in a match is taken out of it
    gap = lambda p: F.concat(F.split_part(p["m"], p["n"], F.lit(1)), F.lit(" "), F.substr(p["m"], F.position(p["n"], p["m"]) + F.length(p["n"])))
    claims = F.filter(pairs, lambda p: ~gap(p).rlike(edged(MERGE_BREAK)))
    claimed = drafts.select(key, F.explode(F.array_distinct(F.transform(claims, lambda p: p["n"].try_cast("long")))).alias("number")).where("number is not null")
    missing = claimed.join(found, [key, "number"], "left_anti")
    named = F.create_map(*[F.lit(x) for k, w in enumerate(WORD_NUMBERS, 1) for x in (w, k)])
    values = F.coalesce(F.element_at(named, F.lower("word")).cast("long"), F.col("word").try_cast("long"))
    words = F.concat(*[_all(F.col("draft"), p) for p in MERGE_TOTALS])
    totals = drafts.select(key, F.explode_outer(words).alias("word"), F.col("draft").rlike(edged(MERGE_UNIVERSAL)).alias("all")).groupBy(key, "all").agg(F.max(values).alias("total"))
    counts = totals.join(found.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = lines.select(key).distinct()
    counts = counts.join(some, key, "left_semi").where("(total is not null and total > n) or (total is null and all)")
    said = F.when(F.col("total").isNotNull(), F.concat(F.lit("the draft claims "), F.col("total").cast("string"), F.lit(" merged"))).otherwise("the draft claims every item merged")
    bare = F.concat(F.lit("merge receipts in window: 0; "), said, F.lit("; the window carries no merge receipt at all, so this claim is unsupported here."))
    few = F.concat(F.lit("merge receipts in window: "), F.col("n").cast("string"), F.lit("; "), said, F.lit("; the draft's session-wide total cannot be checked here."))
    numbered = lambda head, tail: F.concat(F.lit(head), F.col("number").cast("string"), *tail)
    return [
        _fact(found, key, "merge-claim", 0, _pair(F.col("number")), numbered("merge receipt found for PR #", [F.lit(" in "), F.col("label"), F.lit(".")])),
        _fact(missing.join(some, key, "left_semi"), key, "merge-claim", 1, _pair(F.col("number")), numbered("no merge receipt for PR #", [F.lit(" in window.")])),
        _fact(counts, key, "merge-claim", 2, _pair(F.lit(0)), F.when(F.col("n") == 0, bare).otherwise(few)),
    ]


def window_facts(windows: DataFrame, key: str = "window_id") -> DataFrame:
    """(key, place, family, sentence): facts of windows (key, text, draft), each sentence once, the first MOST_FACTS in the order of families.

    A null text or draft counts as empty; a window without lines has no facts. ``key`` names a window: rows that repeat it are one window.
    """
    whole = windows.groupBy(key).agg(F.min(F.coalesce("draft", F.lit(""))).alias("draft"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # all families read both, some several times
    drafts, lines = cut(whole.select(key, "draft")), cut(cited_lines(whole.select(key, "text"), key))
    found = reduce(DataFrame.unionByName, [f for family in (delete_facts, cadence_facts, table_facts, merge_facts) for f in family(lines, drafts, key)])
    first = found.groupBy(key, "sentence").agg(F.min(F.struct("step", "order", "family")).alias("f"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("f.step", "f.order", "sentence"))
    return first.select(key, place.alias("place"), "f.family", "sentence").where(F.col("place") <= MOST_FACTS)


# Words of a claim that a fact may contradict.
DELTA = r"(?i)\b(added|removed|deleted|new|extra|more|additional|fewer|introduced)\b"
RUN_CUES = r"(?i)\b(ran|run|passed|failed|collected|total|the (?:full|whole) (?:suite|run))\b"
PASSING = r"(?i)\b(\d+)\s+pass(?:ed|es|ing)?\b"
TRACKED, NOT_TRACKED = r"(?i)\b(tracked|checked in|committed)\b", r"(?i)\bnot\s+(?:tracked|checked in|committed)\b"
ABSENT = r"(?i)\bno\s+(?:such|longer)\b|\bdoes not exist\b|\bwas removed\b|\bdeleted\b"
PUSHED, NOT_PUSHED = r"(?i)\bpush(?:ed)?\b", r"(?i)\bnot\s+push|\bunpushed\b|\bnot\s+yet\s+pushed\b|\bstill\s+needs?\s+to\s+be\s+pushed\b"
CLAIM_NUMBER, CLAIM_MERGED = r"(?i)\bPR\s*#(\d+)\b", r"(?i)\bmerged\b"
CHECKS_GREEN = r"(?i)\bchecks?\s+(?:are\s+|all\s+)?(?:green|pass(?:ed|ing)?)\b|\ball\s+checks?\s+(?:are\s+)?(?:green|pass(?:ed|ing)?)\b"


def contradicted(claims: DataFrame, facts: DataFrame, key: str = "run") -> DataFrame:
    """(key, place, rule, name, reason): claims (key, place, claim) that a fact (key, at, kind, name, flag, number, said) of their run flatly contradicts.

    Kinds and what they hold: tests (number passed), tracked (flag: in the index), length (flag: exists), commit (flag: in the log), branch (flag: exists),
    push-state (number ahead), pr-state (said: the state), pr-checks (said: the failing ones, or empty). Of facts of one kind and name the last counts, in the place of the first;
    of tests and push states the first. The first of rules 1 to 5 settles a claim; else rule 6 may, and the first of 7 and 8. A run's facts and claims are bounded by its window.
    """
    one = F.col("kind").isin("tests", "push-state")
    last = facts.groupBy(key, "kind", F.when(one, "").otherwise(F.col("name")).alias("name")).agg(
        F.min("at").alias("first"), F.when(F.first("kind").isin("tests", "push-state"), F.min_by(F.struct("name", "flag", "number", "said"), "at")).otherwise(F.max_by(F.struct("name", "flag", "number", "said"), "at")).alias("v")
    )
    met = claims.join(last.select(key, "kind", "first", "v.*"), key)
    c, name, has = F.col("claim"), F.col("name"), lambda p: F.col("claim").rlike(edged(p))
    inside = c.contains(name)
    passed = _all(c, PASSING)
    claimed = F.get(passed, F.lit(0)).try_cast("long")
    same_pr = F.regexp_extract(c, edged(CLAIM_NUMBER), 1) == name
    is_ = lambda kind: F.col("kind") == kind
    yes, no = F.col("flag"), ~F.col("flag")
    rules = [
        (1, is_("tests") & F.col("number").isNotNull() & has(RUN_CUES) & ~has(DELTA) & (F.size(passed) == 1) & (claimed != F.col("number")),
         F.concat(F.lit("claims "), claimed.cast("string"), F.lit(" passing but the run reports "), F.col("number").cast("string"), F.lit(" passed"))),
        (2, is_("tracked") & inside & has(TRACKED) & ~has(NOT_TRACKED) & no, F.concat(F.lit("claims "), name, F.lit(" is tracked, but it is not in the git index"))),
        (2, is_("tracked") & inside & has(NOT_TRACKED) & yes, F.concat(F.lit("claims "), name, F.lit(" is not tracked, but it is in the git index"))),
        (3, is_("length") & inside & no & ~F.replace(c, name, F.lit(" ")).rlike(edged(ABSENT)), F.concat(F.lit("names "), name, F.lit(", which does not exist on disk"))),
        (4, is_("commit") & inside & no, F.concat(F.lit("names commit "), name, F.lit(", which is not in the log"))),
        (5, is_("branch") & inside & no, F.concat(F.lit("names branch "), name, F.lit(", which does not exist"))),
        (6, is_("push-state") & has(PUSHED) & ~has(NOT_PUSHED) & (F.col("number") > 0), F.concat(F.lit("claims pushed, but "), name, F.lit(" has "), F.col("number").cast("string"), F.lit(" commit(s) not pushed"))),
        (7, is_("pr-state") & same_pr & has(CLAIM_MERGED) & (F.upper("said") != "MERGED"), F.concat(F.lit("claims PR #"), name, F.lit(" is merged, but its state is "), "said")),
        (8, is_("pr-checks") & same_pr & has(CHECKS_GREEN) & (F.col("said") != ""), F.concat(F.lit("claims PR #"), name, F.lit(" checks are green, but failing: "), "said")),
    ]
    hit = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(n).alias("rule"), reason.alias("reason"))) for n, when, reason in rules]))
    hits = met.select(key, "place", "first", "name", F.explode(hit).alias("h")).select(key, "place", "h.rule", "first", "name", "h.reason")
    stage = F.when(F.col("rule") <= 5, 1).when(F.col("rule") == 6, 2).otherwise(3)
    best = hits.groupBy(key, "place", stage.alias("stage")).agg(F.min(F.struct("rule", "first", "name", "reason")).alias("h"))
    settled = F.min("stage").over(Window.partitionBy(key, "place"))
    kept = best.withColumn("least", settled).where("stage = 1 or least > 1")
    return kept.select(key, "place", "h.rule", "h.name", "h.reason")
