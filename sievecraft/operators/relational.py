"""Joins, set operations and deduplication over records, runs, catalogs and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once, catalog_key, phrase_key
from sievecraft.plans.lineage import cut
from sievecraft.plans.spread import partitions_for, spread

#: Phrases that are broadcast, of about 100 bytes each; more are joined by a shuffle.
MOST_PHRASES = 200_000
#: Phrases up to which their words are looked up in the row of a text.
FEW_PHRASES = 2_000
#: Rows of sets and paths that a task groups.
PAIRS_OF_TASK = 500_000
#: Sets of a path in one row; names of holders, with repeats, that a task groups.
SETS_OF_LIST, NAMES_OF_TASK = 256, 1_000_000


def assign_ids(records: DataFrame, pos: str = "pos") -> DataFrame:
    """Trimmed id, or records/<pos> where it is blank, and whether it occurs more than once."""
    own = F.nullif(F.trim("id"), F.lit(""))
    rows = records.withColumn("id", F.coalesce(own, F.concat(F.lit("records/"), F.col(pos).cast("string"))))
    counts = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return rows.join(counts, "id")


# Keys that are never given.
RESERVED = ("constructor", "prototype", "__proto__", "toString", "hasOwnProperty")
SAFE = "^[A-Za-z][A-Za-z0-9_]{0,63}$"


def safe_keys(records: DataFrame, pos: str = "pos") -> DataFrame:
    """A key for each id: letters, digits and underscores; r_ before one that starts otherwise, is reserved or too long (cut at 64).

    In order of ``pos`` a key that is taken gets the first of _2, _3 and so on that is free. Only a key that is the other's with such a
    suffix can be in its way, so keys without such a neighbour are numbered by a window. The others are met in order,
    in one stream for each stem, of which a task holds a number for each different key.
    """
    plain = F.regexp_replace("id", "[^A-Za-z0-9_]", "_")
    led = F.substring(F.concat(F.lit("r_"), plain), 1, 64)
    unsafe = ~plain.rlike(SAFE) | plain.isin(*RESERVED)
    rows = records.withColumn("key", F.when(~unsafe, plain).when(led.rlike(SAFE), led).otherwise(F.concat(F.lit("r_"), F.col(pos).cast("string"))))
    rows = rows.withColumn("_stem", F.regexp_replace("key", "(?:_[0-9]+)+$", ""))
    counts = rows.groupBy("_stem", "key").agg(F.count(F.lit(1)).alias("n"))
    upper = counts.where("n > 1").select("_stem", F.col("key").alias("upper"))
    below = counts.select("_stem", F.regexp_replace("key", "_[1-9][0-9]*$", "").alias("upper"), "key").where("key <> upper")
    tied = cut(below.join(upper, ["_stem", "upper"]).select("_stem").distinct())
    nth = F.row_number().over(W.partitionBy("key").orderBy(pos))
    free = rows.join(tied, "_stem", "left_anti").withColumn("key", F.when(nth == 1, F.col("key")).otherwise(F.concat_ws("_", "key", nth.cast("string"))))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stem, following = None, {}  # for each key met, the next number to try
        for batch in batches:
            keys = []
            for s, key in zip(batch["_stem"], batch["key"], strict=True):
                if s != stem:
                    stem, following = s, {}
                upper, _, suffix = key.rpartition("_")
                met = key in following
                # a new key may have been given to a repeated shorter one, whose numbers have passed it
                given = suffix.isdigit() and suffix[0] != "0" and 2 <= int(suffix) < following.get(upper, 2)
                n = following.setdefault(key, 2)
                if not met and not given:
                    keys.append(key)
                    continue
                while f"{key}_{n}" in following:
                    n += 1
                following[key] = n + 1
                keys.append(f"{key}_{n}")
            yield batch.assign(key=keys)

    ordered = rows.join(tied, "_stem", "left_semi").repartition("_stem").sortWithinPartitions("_stem", pos)
    return free.unionByName(ordered.mapInPandas(numbered, ordered.schema)).drop("_stem")


def phrase_members(catalog: DataFrame) -> DataFrame:
    """A row for each phrase, id and role (utterance or negative), with the phrase's ids in each role: owners, first_owner, deniers, first_denier.

    Counts are made before they meet the rows, so a phrase that many ids have costs a row for each, no pairs and no list.
    """
    role = lambda column, name: catalog.select("id", F.lit(name).alias("role"), F.explode(column).alias("x"))
    rows = role("utterances", "utterance").unionByName(role("negatives", "negative"))
    rows = rows.select(catalog_key(F.col("x")).alias("phrase"), "id", "role").where("phrase <> ''").distinct()
    of = lambda name: F.when(F.col("role") == name, F.col("id"))
    counts = rows.groupBy("phrase").agg(
        F.count(of("utterance")).alias("owners"), F.min(of("utterance")).alias("first_owner"), F.count(of("negative")).alias("deniers"), F.min(of("negative")).alias("first_denier")
    )
    return rows.join(counts.where("owners + deniers > 1"), "phrase")


def shared_utterances(members: DataFrame) -> DataFrame:
    """The ids (of phrase_members) of each utterance that more than one id has, a row for each."""
    return members.where("role = 'utterance' and owners > 1").select("phrase", "id", "owners", "first_owner")


def colliding_members(members: DataFrame) -> DataFrame:
    """Rows of phrase_members that collide: a negative that another id utters, an utterance that another id denies."""
    denied = (F.col("role") == "negative") & ((F.col("owners") > 1) | (F.col("first_owner") != F.col("id")))
    uttered = (F.col("role") == "utterance") & ((F.col("deniers") > 1) | (F.col("first_denier") != F.col("id")))
    return members.where(denied | uttered)


def triggers(catalog: DataFrame) -> DataFrame:
    """Phrases of two words or more that one id alone has: id, phrase, n (words)."""
    rows = catalog.select("id", F.explode("utterances").alias("u")).select("id", phrase_key(F.col("u")).alias("phrase")).distinct()
    rows = rows.withColumn("n", F.size(F.split("phrase", " "))).where("n > 1 and phrase <> ''")
    shared = rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("owners"))
    return rows.join(shared.where("owners = 1"), "phrase").select("id", "phrase", "n")


def phrase_hits(requests: DataFrame, phrases: DataFrame) -> DataFrame:
    """Requests (request_id, text) that hold a phrase (id, phrase) as whole words: request_id, id, phrase.

    Only positions of a phrase's longest word are met, and there the whole phrase is compared. A position carries the words around it, as many as the longest
    phrase has, and not its text; of few phrases the words are looked up in the row of the text, so no other position leaves it.
    """
    of_phrase = F.split("phrase", " ")
    longest = F.array_max(F.transform(of_phrase, lambda w, i: F.struct(F.length(w).alias("size"), (-i).alias("minus"), w.alias("word"))))
    sought = phrases.where("phrase <> ''").select("id", "phrase", F.size(of_phrase).alias("n"), longest.alias("l")).distinct()
    sought = cut(sought.select("id", "phrase", "n", F.col("l.word").alias("word"), (-F.col("l.minus")).alias("offset")))
    words = F.split(phrase_key(F.col("text")), " ")
    count, span = sought.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(1))).first()
    listed = [r.word for r in sought.select("word").distinct().collect()] if count <= FEW_PHRASES else None

    def positions(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word")))
        few = every if listed is None else F.filter(every, lambda p: p["word"].isin(listed))
        first = lambda p: F.greatest(p["at"] - span, F.lit(0))
        return F.transform(few, lambda p: F.struct(p["at"].alias("at"), p["word"].alias("word"), first(p).alias("first"), F.slice(w, first(p) + 1, F.lit(2 * span)).alias("near")))

    placed = requests.select("request_id", F.explode(bound_once(words, positions)).alias("p")).select("request_id", "p.*")
    met = placed.join(F.broadcast(sought) if count <= MOST_PHRASES else sought, "word")
    begin = F.col("at") - F.col("offset")
    same = F.array_join(F.slice("near", F.greatest(begin - F.col("first"), F.lit(0)) + 1, F.col("n")), " ") == F.col("phrase")
    return met.where((begin >= 0) & same).select("request_id", "id", "phrase").distinct()


def trigger_hits(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requests (request_id, text) that hold a trigger (id, phrase, n) as whole words."""
    return phrase_hits(requests, found.select("id", "phrase"))


def negative_hits(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests that hold a negative of a catalog row (id, negatives) as whole words: request_id, id, phrase."""
    negatives = catalog.select("id", F.explode("negatives").alias("n")).select("id", phrase_key(F.col("n")).alias("phrase"))
    return phrase_hits(requests, negatives)


def compare_runs(a: DataFrame, b: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Cases (case_id, verdict, decision) of two runs: same, drift, window change, known drift, only in a, only in b."""
    rows = a.select("case_id", F.col("verdict").alias("verdict_a"), F.col("decision").alias("decision_a")).join(
        b.select("case_id", F.col("verdict").alias("verdict_b"), F.col("decision").alias("decision_b")), "case_id", "full_outer"
    )
    listed = F.lit(False)
    if known is not None:
        rows = rows.join(known.select("case_id", F.lit(True).alias("listed")).distinct(), "case_id", "left")
        listed = F.coalesce("listed", F.lit(False))
    same_text = F.col("verdict_a") == F.col("verdict_b")
    state = (
        F.when(F.col("decision_b").isNull(), "only in a")
        .when(F.col("decision_a").isNull(), "only in b")
        .when(F.col("decision_a") == F.col("decision_b"), "same")
        .when(same_text & listed, "known drift")
        .when(same_text, "drift")
        .otherwise("window change")
    )
    return rows.select("case_id", state.alias("state"))


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths of two snapshots (path, sha): new, gone, changed or same."""
    rows = before.select("path", F.col("sha").alias("was")).join(now.select("path", F.col("sha").alias("is")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    return rows.select("path", state.alias("state"))


def coverage(expected: DataFrame, held: DataFrame) -> DataFrame:
    """For each set (set, path): complete if every path is held by any set, and the other sets it borrows from, of which there are few.

    Rows are dealt once by path, and the sets of a path are listed, SETS_OF_LIST at most in a row. What goes to a set that lacks a path is a list of its holders and no row for each.
    """
    one = lambda rows, is_held: rows.select("path", "set", F.lit(is_held).alias("held"))
    both = one(expected, False).unionByName(one(held.where(F.col("path").isNotNull() & F.col("set").isNotNull()), True))
    pairs = spread(both, ["path"], PAIRS_OF_TASK).groupBy("path", "set").agg(F.bool_or("held").alias("held"), F.bool_or(~F.col("held")).alias("expected"))
    nth = F.row_number().over(W.partitionBy("path").orderBy("set"))
    lacks = F.col("expected") & ~F.col("held")
    lists = pairs.withColumn("list", F.floor((nth - 1) / SETS_OF_LIST)).groupBy("path", "list").agg(
        F.collect_list(F.when(F.col("held"), F.col("set"))).alias("holders"),
        F.collect_list(F.when(lacks, F.col("set"))).alias("lacking"),
        F.bool_or(F.col("set").isNull()).alias("nameless"),
        F.count(F.lit(1)).alias("n"),
    )
    no_name = F.array(F.lit(None).cast(pairs.schema["set"].dataType))
    lists = lists.withColumn("lacking", F.when(F.col("nameless"), F.concat("lacking", no_name)).otherwise(F.col("lacking")))
    alone = (F.col("list") == 0) & (F.col("n") < SETS_OF_LIST)
    lists = cut(lists.where(~alone | (F.size("lacking") > 0)).select("path", "holders", "lacking", alone.alias("alone")))
    # lists of one path meet where it has several
    of_many = lists.where(~F.col("alone"))
    met = of_many.where(F.size("lacking") > 0).select("path", "lacking").join(of_many.where(F.size("holders") > 0).select("path", "holders"), "path", "left")
    met = lists.where("alone").select("lacking", "holders").unionByName(met.select("lacking", "holders"))
    met = met.withColumn("missing", F.coalesce(F.size("holders"), F.lit(0)) < 1)
    tasks = partitions_for(met, NAMES_OF_TASK, F.size("lacking") * (F.greatest(F.size("holders"), F.lit(0)) + 1))
    sets = expected.select("set").distinct().select("set", F.lit(None).cast(met.schema["holders"].dataType).alias("holders"), F.lit(False).alias("missing"))
    found = met.select(F.explode("lacking").alias("set"), "holders", "missing").unionByName(sets).repartition(tasks, "set")
    borrowed = found.select("set", "missing", F.explode_outer("holders").alias("holder")).groupBy("set", "holder").agg(F.bool_or("missing").alias("missing"))
    borrows = F.when(F.col("set").isNotNull(), F.array_join(F.array_sort(F.collect_list("holder")), ",")).otherwise("")
    return borrowed.groupBy("set").agg((~F.bool_or("missing")).alias("complete"), borrows.alias("borrows"))


def with_neighbours(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Selected chunks (source, idx) and those right before and behind them, each once, with base: whether it was selected."""
    around = selected.select("source", F.explode(F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 1)).alias("idx"), F.col("idx").alias("of"))
    near = around.groupBy("source", "idx").agg(F.bool_or(F.col("idx") == F.col("of")).alias("base"))
    return chunks.join(near, ["source", "idx"]).select("source", "idx", "base")


def called_by(parts: DataFrame, calls: DataFrame, most: int = 3, least: int = 4) -> DataFrame:
    """Files whose parts are called from another: path, name, caller. Names of over ``most`` files or under ``least`` letters don't link."""
    short = F.element_at(F.split("name", r"\."), -1)
    defined = parts.select("path", short.alias("name")).where(F.length("name") >= least).distinct()
    rare = defined.groupBy("name").agg(F.count(F.lit(1)).alias("homes")).where(F.col("homes") <= most).select("name")
    return defined.join(rare, "name").join(calls.select(F.col("path").alias("caller"), "name").distinct(), "name").where("path <> caller").select("path", "name", "caller")


def only_in_either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone has: key, side (a or b)."""
    rows = a.select(key).distinct().withColumn("a", F.lit(True)).join(b.select(key).distinct().withColumn("b", F.lit(True)), key, "full_outer")
    return rows.where("a is null or b is null").select(key, F.when(F.col("b").isNull(), "a").otherwise("b").alias("side"))


def without_views(rows: DataFrame) -> DataFrame:
    """Rows (path, upstream) without the views whose upstream is itself among the rows."""
    return rows.alias("v").join(rows.select(F.col("path").alias("p")).alias("o"), F.col("v.upstream") == F.col("o.p"), "left_anti")


def leaking_identities(cases: DataFrame) -> DataFrame:
    """Identities (kind, value) that cases of more than one split share."""
    splits = cases.groupBy("kind", "value").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return splits.where(F.size("splits") > 1).select("kind", "value", F.array_join("splits", ",").alias("splits"))


def duplicate_sources(sources: DataFrame) -> DataFrame:
    """Groups of sources with byte-identical text and description: canonical id (the smallest), number, sha of the text."""
    keys = [F.sha2(F.col("text"), 256).alias("text_sha"), F.sha2(F.col("description"), 256).alias("description_sha")]
    groups = sources.select("id", *keys).groupBy("text_sha", "description_sha").agg(F.min("id").alias("canonical_id"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").select("canonical_id", "n", "text_sha")


def first_by_priority(parts: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """Union of frames in which the first frame that holds a key wins; ``order`` breaks ties within a frame."""
    rows = None
    for k, part in enumerate(parts):
        marked = part.withColumn("_priority", F.lit(k))
        rows = marked if rows is None else rows.unionByName(marked)
    rank = F.row_number().over(W.partitionBy(*key).orderBy("_priority", *order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_priority")


def paired_replay(old: DataFrame, new: DataFrame, wobble: float) -> DataFrame:
    """Cases (case_id, ok, margin) of two runs: gained, lost, same, or inconclusive where both margins are within the wobble."""
    rows = old.select("case_id", F.col("ok").alias("ok_a"), F.col("margin").alias("m_a")).join(new.select("case_id", F.col("ok").alias("ok_b"), F.col("margin").alias("m_b")), "case_id")
    passing, failing = F.when(F.col("ok_b"), F.col("m_b")).otherwise(F.col("m_a")), F.when(F.col("ok_b"), F.col("m_a")).otherwise(F.col("m_b"))
    state = F.when(F.col("ok_a") == F.col("ok_b"), "same").when((passing < wobble) & (failing > -wobble), "inconclusive").when(F.col("ok_b"), "gained").otherwise("lost")
    return rows.select("case_id", state.alias("state"))
