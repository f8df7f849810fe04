"""Searches in stages: from folders to files, and from descriptions to passages that may be handed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.operators.ranking import ranked
from sievecraft.operators.relational import with_neighbours

WORD_WEIGHT, KEEP_FOLDERS, POOL = 0.5, 8, 40


def zoom_folders(folders: DataFrame, words: DataFrame, hits: DataFrame, keep: int = KEEP_FOLDERS) -> DataFrame:
    """Folders (q, folder, score) that a search looks into: q, folder, fused, place. Half of a folder's score is its best file's word score (words: q, path, folder, score) over the best of all.

    The first ``keep`` are kept, and the folders of the word search's own hits (q, path, folder) behind them, whatever their score.
    """
    best = words.groupBy("q").agg(F.max("score").alias("best"))
    own = words.join(best, "q").groupBy("q", "folder").agg(F.max(F.col("score") / F.greatest("best", F.lit(1e-300))).alias("word"))
    fused = (1 - WORD_WEIGHT) * F.col("score") + WORD_WEIGHT * F.coalesce("word", F.lit(0.0))
    rows = folders.join(own, ["q", "folder"], "left").withColumn("fused", F.round(fused, 9))
    rows = ranked(rows, ["q"], [F.desc("fused"), F.col("folder")]).withColumnRenamed("rank", "place")
    met = hits.select("q", "folder").distinct().withColumn("hit", F.lit(True))
    return rows.join(met, ["q", "folder"], "left").where((F.col("place") <= keep) | F.col("hit")).select("q", "folder", "fused", "place")


def zoom_pool(folders: DataFrame, files: DataFrame, hits: DataFrame, most: int = POOL) -> DataFrame:
    """Files to look at: q, path, rank. The hits (q, path, rank) come first; then each kept folder (q, folder, place) gives its next file (q, folder, path, nth) in turn, so none crowds out another."""
    turns = files.join(folders.select("q", "folder", "place"), ["q", "folder"]).select("q", "path", F.lit(1).alias("late"), F.col("nth").alias("a"), F.col("place").alias("b"))
    first = hits.select("q", "path", F.lit(0).alias("late"), F.col("rank").alias("a"), F.lit(0).alias("b"))
    each = first.unionByName(turns).groupBy("q", "path").agg(F.min(F.struct("late", "a", "b")).alias("at"))
    return ranked(each, ["q"], [F.col("at"), F.col("path")]).where(F.col("rank") <= most).select("q", "path", "rank")


def _gate(answers: DataFrame, stage: str) -> DataFrame:
    """What a stage's judgement of bundles (request, stage, source, fit, confidence, complete) comes to: complete, and the bundle taken: of a direct fit alone, the surest."""
    mine = answers.where(F.col("stage") == stage)
    direct = F.when((F.col("fit") == 1) & (F.col("confidence") >= 0.6), F.struct(F.col("confidence"), (-F.col("source")).alias("minus"), "source"))
    return mine.groupBy("request").agg(F.bool_and("complete").alias(f"{stage}_complete"), F.max(direct).alias("best")).select("request", f"{stage}_complete", F.col("best.source").alias(f"{stage}_taken"))


def _state(chunks: DataFrame, states: DataFrame, stage: str) -> DataFrame:
    """Whether any chunk (request, source, idx) of a stage may not be sent, for want of a preparation (source, idx, state)."""
    rows = chunks.join(states, ["source", "idx"], "left")
    return rows.groupBy("request").agg(F.bool_or(F.coalesce("state", F.lit("unknown")) != "ok").alias(f"{stage}_pending"))


def retrieval(described: DataFrame, chunks: DataFrame, states: DataFrame, answers: DataFrame, docs: int = 3, most: int = 4, neighbours: bool = True) -> DataFrame:
    """Status of each request and the source it was answered from: request, status, stage, source.

    ``described``: request, source, score, confidence, complete: the judged descriptions; ``chunks``: request, source, idx, score: all chunks; ``states``: source, idx, state;
    ``answers``: request, stage, source, fit, confidence, complete. The best chunks of the first ``docs`` sources are judged (narrow), else the best of all (wide), else
    those with their neighbours. A judgement that covers too little refuses, and nothing unprepared is ever sent.
    """
    order = [F.desc("score"), F.desc("confidence"), F.col("source")]
    listed = ranked(described, ["request"], order).where(F.col("rank") <= docs).select("request", "source")
    base = described.groupBy("request").agg(F.bool_and("complete").alias("complete"))
    top = lambda rows: ranked(rows.where("score > 0"), ["request"], [F.desc("score"), F.col("source"), F.col("idx")]).where(F.col("rank") <= most).select("request", "source", "idx")
    narrow, wide = top(chunks.join(listed, ["request", "source"], "left_semi")), top(chunks)
    key = lambda rows: rows.select(F.concat_ws("/", F.col("request").cast("string"), F.col("source").cast("string")).alias("source"), "idx", F.col("request").alias("r"), F.col("source").alias("s"))
    around = with_neighbours(key(wide).select("source", "idx"), key(chunks)).join(key(chunks), ["source", "idx"]).select(F.col("r").alias("request"), F.col("s").alias("source"), "idx")
    rows = base.join(narrow.groupBy("request").agg(F.count(F.lit(1)).alias("found")), "request", "left")
    stages = [("narrow", narrow), ("wide", wide)] + ([("neighbours", around)] if neighbours else [])
    for stage, picked in stages:
        rows = rows.join(_state(picked, states, stage), "request", "left").join(_gate(answers, stage), "request", "left")
    status = F.when(~F.col("complete"), "refused/descriptions").when(F.col("found").isNull(), "no-match/narrow")
    source = F.when(F.lit(False), F.lit(None).cast(described.schema["source"].dataType))
    open_ = F.col("complete") & F.col("found").isNotNull()
    for stage, _ in stages:
        status = (
            status.when(F.coalesce(F.col(f"{stage}_pending"), F.lit(False)), f"preparation-required/{stage}")
            .when(~F.coalesce(F.col(f"{stage}_complete"), F.lit(False)), f"refused/{stage}")
            .when(F.col(f"{stage}_taken").isNotNull(), f"ready/{stage}")
        )
        ready = open_ & ~F.coalesce(F.col(f"{stage}_pending"), F.lit(False)) & F.coalesce(F.col(f"{stage}_complete"), F.lit(False))
        source = source.when(ready & F.col(f"{stage}_taken").isNotNull(), F.col(f"{stage}_taken"))
        open_ = ready & F.col(f"{stage}_taken").isNull()
    told = rows.select("request", F.split(status.otherwise("no-match/end"), "/").alias("t"), source.alias("taken"))
    return told.select("request", F.col("t")[0].alias("status"), F.col("t")[1].alias("stage"), F.when(F.col("t")[0] == "ready", F.col("taken")).alias("source"))


def front_matter(text: Column) -> Column:
    """The lines between the first two lines of three dashes, if the text starts with one; else empty."""
    return F.regexp_extract(text, r"^[ \t]*---[ \t]*\r?\n([\s\S]*?)(?:^|\n)[ \t]*---[ \t]*(?:\r?\n|$)", 1)


def description(text: Column) -> Column:
    """The description of a front matter: what stands behind its name, without quotes, or the indented lines below, as one line."""
    front = front_matter(text)
    plain = F.regexp_extract(front, r"(?m)^description:[ \t]?(.*)$", 1)
    block = F.regexp_extract(front, r"(?m)^description:[ \t]?(?:[|>]-?)?[ \t]*\n((?:(?:[ \t]+.*|[ \t]*)(?:\n|$))*)", 1)
    folded = F.trim(F.regexp_replace(block, r"\s+", " "))
    return F.when(F.trim(plain).isin("", "|", ">", "|-", ">-"), folded).otherwise(F.regexp_replace(F.trim(plain), "^([\"'])(.*)\\1$", "$2"))


def trigger_phrases(text: Column) -> Column:
    """Phrases of the lines that start with Trigger(s) or Use when, in quotes, then in backticks, then slash names; the first of each whatever its case."""
    body = F.when(front_matter(text) != "", F.regexp_replace(text, r"^[ \t]*---[ \t]*\r?\n[\s\S]*?\n[ \t]*---[ \t]*(?:\r?\n|$)", "")).otherwise(text)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)^\**\s*(?:Triggers?|Use when)\**\s*:?"))
    quoted, ticked = '"([^"]+)"', "`([^`]+)`"

    def of(line: Column) -> Column:
        rest = F.regexp_replace(line, r"(?i)^\**\s*(?:Triggers?|Use when)\**\s*:?\s*", "")
        bare = F.regexp_replace(rest, quoted, " ")
        names = F.regexp_extract_all(F.regexp_replace(bare, ticked, " "), F.lit(r"/[a-zA-Z][A-Za-z0-9_-]*"), F.lit(0))
        return F.concat(F.regexp_extract_all(rest, F.lit(quoted), F.lit(1)), F.regexp_extract_all(bare, F.lit(ticked), F.lit(1)), names)

    clean = F.filter(F.transform(F.flatten(F.transform(lines, of)), lambda p: F.trim(F.regexp_replace(F.trim(p), "[.:;]+$", ""))), lambda p: p != "")
    return first_of_each(clean)


def first_of_each(phrases: Column) -> Column:
    """The phrases without those that an earlier one equals in any case."""
    keys = F.transform(phrases, lambda p: F.lower(p))
    return F.filter(phrases, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1)


def catalog_records(files: DataFrame, most: int = 300) -> DataFrame:
    """Catalog rows of skill files (folder, text): id, text (the description, at most ``most`` characters), utterances: triggers, the slash name, and two forms of the description."""
    told = files.select("folder", description(F.col("text")).alias("d"), trigger_phrases(F.col("text")).alias("t"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("d"), r"[^A-Za-z0-9_\s/-]", ""), r"\s+", " "))
    clause = F.trim(F.regexp_extract("d", r"^([^.,;]*)", 1))
    forms = F.filter(F.array(F.concat(F.lit("/"), "folder"), plain, clause), lambda x: x != "")
    return told.select(F.col("folder").alias("id"), F.substring("d", 1, most).alias("text"), first_of_each(F.concat("t", forms)).alias("utterances"))


SUMMARY = (
    r"(?i)^\s*(?:ℹ)\s*(?:tests|suites|pass|fail|cancelled|skipped|todo)\s+\d+|^\s*\d+\s+(?:passing|failing|pending)\b|^\s*=+.*?\b\d+\s+(?:passed|failed|error)|\b\d+\s+(?:passed|failed|xfailed|xpassed|deselected|errors?)\b"
    r"|^\s*collected\s+\d+\s+items?|^\s*(?:Tests|Test\s+Suites|Test\s+Files|Snapshots|Assertions)\s*:|^\s*Ran\s+\d+\s+tests?\b|^\s*(?:OK|FAILED)\s*(?:\(|$)|^\s*(?:ok|FAIL|PASS|---\s*FAIL)\s+\S|^\s*test\s+result:\s|^\s*\d+\s*/\s*\d+\s+(?:passed|pass)\b"
)  # fixed values: lines that sum up a test run


def test_counts(output: Column) -> Column:
    """Struct of collected, passed and failed that the summary lines of a run's output tell, null for what none does; the last number counts."""
    lines = F.array_join(F.filter(F.split(output, "\n"), lambda x: (F.trim(x) != "") & x.rlike(SUMMARY)), "\n")
    last = lambda pattern: F.element_at(F.regexp_extract_all(lines, F.lit(pattern), F.lit(1)), -1).cast("int")
    some = lambda pattern: F.when(lines.rlike(pattern), last(pattern))
    passed = F.coalesce(some(r"(?i)\b(\d+)\s+passed\b"), some(r"(?i)ℹ\s*pass\s+(\d+)"))
    failed = F.coalesce(some(r"(?i)\b(\d+)\s+failed\b"), some(r"(?i)ℹ\s*fail\s+(\d+)"))
    collected = F.coalesce(some(r"(?i)collected\s+(\d+)\s+items?"), some(r"(?i)ℹ\s*tests\s+(\d+)"), passed + F.coalesce(failed, F.lit(0)))
    return F.struct(collected.alias("collected"), passed.alias("passed"), failed.alias("failed"))


def first_holder(stores: list[DataFrame], key: str) -> DataFrame:
    """Rows of several stores as one: of the rows that share the ``key`` that of the first store which holds it."""
    rows = None
    for k, store in enumerate(stores):
        marked = store.withColumn("_store", F.lit(k))
        rows = marked if rows is None else rows.unionByName(marked)
    first = rows.groupBy(key).agg(F.min("_store").alias("_store"))
    return rows.join(first, [key, "_store"]).drop("_store")


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int, most: int = 100) -> DataFrame:
    """A page of a listing: at most ``most`` rows, which is what a page is."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"a page has 1 to {most} rows and starts at 0 or later")
    return rows.orderBy(*order).offset(offset).limit(limit)


def growth(counts: DataFrame, key: str, order: str) -> DataFrame:
    """Scans (key, order, n) with how much each found beyond the scan before: n, added (all of it for the first)."""
    before = F.lag("n").over(W.partitionBy(key).orderBy(order))
    return counts.select(key, order, "n", (F.col("n") - F.coalesce(before, F.lit(0))).alias("added"))
