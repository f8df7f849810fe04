"""What is held of files: kinds of paths, labels, who may see what, copies, skips, states and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Stems of files that point at others, folders of notes that retell a change, states of a set from the best on.
HUBS = ("index", "catalog", "tools-used", "handoff", "readme")
WRITEUPS = ("pr-history",)
STATES = ("ready", "stale", "refreshing", "failed")
# Folders of fixtures and samples.
FIXTURES = (
    r"(?i)(^|/)(__fixtures__|__mocks__|test[-_]?data|sample[-_]data)/"
    r"|(^|/)(tests?|__tests__|specs?|e2e|docs|examples|bench(marks?)?)/(.+/)?(fixtures?/|evidence/(.+/)?sources/)"
)


def stem(path: Column) -> Column:
    """Lower-case file name without its last suffix; a name that only starts with a dot is its own stem."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def copy_kind(path: Column, writeups: tuple[str, ...] = WRITEUPS) -> Column:
    """hub, copy or writeup (below a folder of that name) for a path that stands for other files; null for a file of its own."""
    folders = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), F.lower)
    own = stem(path)
    copied = F.exists(folders, lambda x: (x == "_staging") | x.contains("template"))
    return (
        F.when(own.isin(*HUBS, "profile"), "hub")
        .when(own.contains("template") | copied, "copy")
        .when(F.exists(folders, lambda x: x.isin(*writeups)), "writeup")
    )


def is_hub(path: Column) -> Column:
    return stem(path).isin(*HUBS) | stem(path).contains("template")


def is_fixture(path: Column, named: Column | None = None) -> Column:
    """A file in a folder of fixtures or samples; of one that is ``named`` exactly only the folder counts, as ever."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    return (path if named is None else F.when(named, folder).otherwise(path)).rlike(FIXTURES)


def excluded(path: Column, folders: tuple[str, ...]) -> Column:
    """A path that is one of the folders or lies in it."""
    inside = F.lit(False)
    for f in folders:
        inside = inside | (path == f) | path.startswith(f + "/")
    return inside


def candidate_files(entries: DataFrame, banned: tuple[str, ...] = ()) -> DataFrame:
    """One entry (set, path, order, pass) for each path that passed and is no fixture or excluded: that of the first set by ``order``."""
    rows = entries.where(F.col("pass") & ~is_fixture(F.col("path")) & ~excluded(F.col("path"), banned))
    first = F.min(F.struct("order", "set"))
    return rows.groupBy("path").agg(first.alias("f")).select("path", "f.set")


def one_per_file(files: DataFrame) -> DataFrame:
    """Of the names (real, path, root) of each physical file that of the first root, then the first path."""
    first = F.min(F.struct("root", "path"))
    return files.groupBy("real").agg(first.alias("f"), F.count(F.lit(1)).alias("names")).select("real", "f.path", "f.root", "names")


def checked_labels(drafts: DataFrame, kinds: tuple[str, ...], statuses: tuple[str, ...]) -> DataFrame:
    """Labels (id, kind, status, as_of, subject) with every value outside its list, or no date or text, as unknown; and the sentence they make."""
    listed = lambda c, values: F.when(F.col(c).isin(*values), F.col(c)).otherwise("unknown")
    as_of = F.when(F.col("as_of").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("as_of")).otherwise("unknown")
    subject = F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.lit("unknown"))
    rows = drafts.select("id", listed("kind", kinds).alias("kind"), listed("status", statuses).alias("status"), as_of.alias("as_of"), subject.alias("subject"))
    dated = F.when(F.col("as_of") != "unknown", F.concat(F.lit(" as of "), "as_of")).otherwise("")
    sentence = F.concat(F.lit("This file is a "), "kind", F.lit(" about "), "subject", F.lit(". Its status is "), "status", dated, F.lit("."))
    return rows.withColumn("sentence", sentence)


def label_matches(labels: DataFrame, today: Column, status: str | None = None, kind: str | None = None, subject: str | None = None, days: int | None = None) -> DataFrame:
    """Labels that match every given filter, and those that only an unknown date keeps out: id, match, undated."""
    ok = F.lit(True)
    for name, value in (("status", status), ("kind", kind)):
        ok = ok & (F.col(name) == value) if value else ok
    if subject:
        ok = ok & F.lower("subject").contains(subject.lower())
    date = F.to_date(F.when(F.col("as_of").rlike("^[0-9]{4}-(0[1-9]|1[0-2])-([0-2][0-9]|3[01])$"), F.expr("try_to_date(as_of, 'yyyy-MM-dd')")))
    near = F.lit(True) if days is None else F.datediff(today, date) <= days
    undated = F.lit(False) if days is None else ok & date.isNull()
    return labels.select("id", F.coalesce(ok & near, F.lit(False)).alias("match"), undated.alias("undated"))


def skip_lines(skips: DataFrame, shown: int = 5) -> DataFrame:
    """For each reason of skips (reason, label): their number, the ``shown`` commonest labels with theirs, and how many more labels there are."""
    counts = skips.groupBy("reason", "label").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("reason").orderBy(F.desc("n"), "label")))
    named = F.when(F.col("rank") <= shown, F.struct("rank", F.concat("label", F.lit(" "), F.col("n").cast("string")).alias("text")))
    rows = ranked.groupBy("reason").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(named)).alias("top"), F.count(F.lit(1)).alias("labels"))
    return rows.select("reason", "n", F.array_join(F.transform("top", lambda x: x["text"]), ", ").alias("top"), F.greatest(F.col("labels") - shown, F.lit(0)).alias("more"))


def folded_states(parts: DataFrame) -> DataFrame:
    """State of each set from its parts (set, state, notes): the worst, and the sum of the notes."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    worst = F.element_at(F.array(*map(F.lit, STATES)), F.max(rank).cast("int"))
    return parts.groupBy("set").agg(worst.alias("state"), F.sum(F.coalesce("notes", F.lit(0))).cast("long").alias("notes"))


def visible(sets: DataFrame, principal: str) -> DataFrame:
    """Sets (set, principals) that serve a principal."""
    return sets.where(F.array_contains("principals", principal))


def visibility_faults(can_see: DataFrame, connected: DataFrame) -> DataFrame:
    """Pairs (set, principal) on one side only: may see without having connected (unconnected), or connected without being allowed (unseen)."""
    rows = can_see.distinct().withColumn("sees", F.lit(True)).join(connected.distinct().withColumn("holds", F.lit(True)), ["set", "principal"], "full_outer")
    return rows.where("sees is null or holds is null").select("set", "principal", F.when(F.col("holds").isNull(), "unconnected").otherwise("unseen").alias("fault"))


def watched_refusals(sets: DataFrame, files: DataFrame, watched: DataFrame) -> DataFrame:
    """Sets that may not hold files of a folder that another set watches for fewer principals: set, watcher, n files.

    ``sets``: set, principals; ``files``: set, path; ``watched``: set, folder. Files meet folders by each of the folders they lie in.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = files.select("set", "path", F.explode(folders).alias("folder"))
    met = above.join(watched.select(F.col("set").alias("watcher"), "folder"), "folder").where("set <> watcher").select("set", "watcher", "path").distinct()
    counts = met.groupBy("set", "watcher").agg(F.count(F.lit(1)).alias("n"))
    own = counts.join(sets.select("set", "principals"), "set").join(sets.select(F.col("set").alias("watcher"), F.col("principals").alias("served")), "watcher")
    return own.where(F.size(F.array_except("principals", "served")) > 0).select("set", "watcher", "n")


def nearest_home(paths: DataFrame, homes: DataFrame) -> DataFrame:
    """Owner of each path (path) by the deepest home (folder, person) it lies in: path, person; null for none."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    rows = paths.select("path", F.explode(above).alias("a")).select("path", "a.depth", "a.folder").join(homes, "folder")
    return paths.join(rows.groupBy("path").agg(F.max_by("person", "depth").alias("person")), "path", "left")


def folder_coverage(on_disk: DataFrame, registered: DataFrame) -> DataFrame:
    """Of each folder's files (folder, real, supported): how many could be connected, are (registered: real), and are of no supported type."""
    rows = on_disk.join(registered.select("real").distinct().withColumn("held", F.lit(True)), "real", "left")
    can = F.col("supported")
    return rows.groupBy("folder").agg(F.count_if(can).alias("connectable"), F.count_if(can & F.col("held")).alias("connected"), F.count_if(~can).alias("unsupported"))


def usable(chunks: DataFrame, preparations: DataFrame) -> DataFrame:
    """Chunks (source, idx, sha) with their preparation (source, idx, sha, reviewed): ok, unknown (none), unreviewed, stale (of other bytes), tested in that order."""
    made = preparations.select("source", "idx", F.col("sha").alias("of"), "reviewed", F.lit(True).alias("made"))
    rows = chunks.join(made, ["source", "idx"], "left")
    state = F.when(F.col("made").isNull(), "unknown").when(~F.col("reviewed"), "unreviewed").when(F.col("of") != F.col("sha"), "stale").otherwise("ok")
    return rows.select("source", "idx", state.alias("state"))


def needed_hits(hundredths: Column, n: Column) -> Column:
    """The smallest number of hits at or above a rate, in whole numbers."""
    return F.ceil(hundredths * n / 100)


def bar_state(kind: Column, bar: Column, hits: Column, n: Column, left: Column) -> Column:
    """true or false as soon as the cases that have not run can't change it, else null. ``bar``: hundredths of a rate, or the most of a count."""
    total = n + left
    short = needed_hits(bar, total)
    count = F.when(hits > bar, False).when(left == 0, True)
    rate = F.when(hits >= short, True).when(hits + left < short, False)
    return F.when(total == 0, False).when(kind == "count", count).otherwise(rate)


def verdict(met: Column, stop: Column) -> Column:
    """supported needs a complete run with every bar met; a run that stopped for another reason than a bar out of reach is incomplete."""
    finished = (stop == "complete") | stop.startswith("bar-unreachable")
    return F.when(~F.coalesce(finished, F.lit(False)), "incomplete").when(met & (stop == "complete"), "supported").otherwise("not supported")


def gate_reasons(checks: dict[str, Column]) -> tuple[Column, Column]:
    """ACCEPT or REJECT, and the reasons (keys of the checks that hold), in their order."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), reason) for reason, bad in checks.items()]))
    return F.when(F.size(reasons) > 0, "REJECT").otherwise("ACCEPT"), reasons


def only_judge_blocks(verdicts: DataFrame, kinds: DataFrame, weak: tuple[str, ...] | None = None) -> DataFrame:
    """Runs (run, arm, verdict, blocks) whose every blocking verdict is of a judge arm (arm, kind) and, if given, one of the ``weak`` ones: run, only_judge.

    An unknown arm counts as one that can't be overruled; without a blocking verdict the answer is no.
    """
    rows = verdicts.join(kinds, "arm", "left")
    soft = F.col("kind") == "judge"
    if weak is not None:
        soft = soft & F.col("verdict").isin(*weak)
    blocking = F.col("blocks")
    every = F.bool_and(F.when(blocking, F.coalesce(soft, F.lit(False))))
    return rows.groupBy("run").agg(F.coalesce(every, F.lit(False)).alias("only_judge"))


def drift_baseline(a: DataFrame, b: DataFrame, changed: DataFrame) -> DataFrame:
    """For runs a and b (case_id, decision) over the ``changed`` cases: truths blocked (false) and lies allowed (true) in each."""
    both = a.withColumn("run", F.lit("a")).unionByName(b.withColumn("run", F.lit("b"))).join(changed.select("case_id").distinct(), "case_id", "left_semi")
    return both.groupBy("run").agg(F.count_if(F.col("decision") == "false").alias("truths_blocked"), F.count_if(F.col("decision") == "true").alias("lies_allowed"))


def frozen_scores(expected: DataFrame, told: DataFrame) -> DataFrame:
    """Whether told rows (id, before, after) cover the expected ids (id) exactly once each, and never score worse: one row with the counts of each fault."""
    once = told.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("after") < F.col("before")).alias("worse"))
    rows = expected.select("id").distinct().withColumn("asked", F.lit(True)).join(once, "id", "full_outer")
    faults = rows.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("worse")).alias("worse")
    )
    return faults.withColumn("ok", (F.col("missing") + F.col("unknown") + F.col("repeated") + F.col("worse")) == 0)


def merged_saved(harvested: DataFrame, current: DataFrame, key) -> DataFrame:
    """Saved cases (question, gold, at) by their question's ``key``: a current one wins over a harvested one, a later over an earlier."""
    rows = harvested.withColumn("own", F.lit(0)).unionByName(current.withColumn("own", F.lit(1))).withColumn("key", key(F.col("question")))
    return rows.groupBy("key").agg(F.max(F.struct("own", "at", "question", "gold")).alias("r")).select("key", "r.question", "r.gold", "r.own")


def retry_queue(misses: DataFrame, tries: DataFrame, most: int = 5) -> DataFrame:
    """Keys of misses (key, at) with the number of tries since the last (key, at, ok): retry, done (one worked) or dropped (``most`` failed)."""
    last = misses.groupBy("key").agg(F.max("at").alias("missed"))
    since = tries.join(last, "key").where("at > missed").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("ok").alias("done"))
    rows = misses.select("key").distinct().join(since, "key", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("key", n.alias("tries"), F.when(F.coalesce("done", F.lit(False)), "done").when(n >= most, "dropped").otherwise("retry").alias("state"))
