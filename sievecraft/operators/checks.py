"""Checks that fail closed, and what drafts and windows say: clauses, tables of results, edited files, scripted answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.operators.cascade import first_of_each
from sievecraft.operators.views import strictness

MOST_CLAUSES = 25
CATEGORY = "^[a-z][a-z0-9_-]{0,39}$"


def draft_clauses(draft: Column) -> Column:
    """The first MOST_CLAUSES clauses of a draft, the feature's own limit: cut behind sentence marks, at semicolons, colons and the word and; each once, whatever its case."""
    units = F.transform(F.split(F.trim(draft), r"(?<=[.!?])\s+|;\s*|:\s+(?=\S)|\s+and\s+"), lambda u: F.trim(u))
    return F.slice(first_of_each(F.filter(units, lambda u: u != "")), F.lit(1), F.lit(MOST_CLAUSES))


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """Chunks (source, first_line, last_line, sha, text) that can't be trusted: bad offsets, no digest, no text, or an identity that is repeated."""
    key = ["source", "first_line", "last_line"]
    counts = chunks.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.count(F.lit(1)).alias("n"))
    offsets = F.coalesce((F.col("first_line") >= 1) & (F.col("last_line") >= F.col("first_line")), F.lit(False))
    digest = F.coalesce(F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False))
    fault = F.when(~offsets, "offsets").when(~digest, "digest").when(F.coalesce(F.col("text"), F.lit("")) == "", "text").when(F.col("n") > 1, "repeated")
    rows = chunks.join(counts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).select(*key, fault.alias("fault"))
    return rows.where("fault is not null")


def unasked(selected: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Selections of ids that were never asked about: any is a reason to stop."""
    return selected.join(asked.select(*key).distinct(), key, "left_anti")


def organizer_faults(records: DataFrame, categories: DataFrame, most: int = 100) -> DataFrame:
    """What is wrong with an organiser's input, one row for each fault: records (id, text), categories (name, description)."""
    n = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("ids"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("texts"), F.countDistinct("id").alias("d"), F.count("id").alias("k"))
    c = categories.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == "other").alias("other"), F.count_if(~F.coalesce(F.col("name").rlike(CATEGORY), F.lit(False)) | F.col("name").isin("constructor", "prototype")).alias("names"),
        F.count_if(F.coalesce(F.trim("description"), F.lit("")) == "").alias("empty"),
    )
    of_records = F.array(F.when(~F.col("n").between(1, most), "number of records"), F.when(F.col("ids") + F.col("texts") > 0, "empty record"), F.when(F.col("d") < F.col("k"), "repeated id"))
    of_categories = F.array(F.when(~F.col("n").between(2, 30), "number of categories"), F.when(F.col("other") == 0, "no other"), F.when(F.col("names") + F.col("empty") > 0, "category"))
    told = n.select(F.explode(F.array_compact(of_records)).alias("fault"))
    return told.unionByName(c.select(F.explode(F.array_compact(of_categories)).alias("fault")))


def edited_held(files: DataFrame) -> DataFrame:
    """Edited files that no set (path, set_rank, sha, reviewed_sha, readable, secret, stuck) can read, and why: secret, stuck or refresh, as the first of their sets has it. A file that is gone (null sha) isn't edited."""
    there = files.where(F.col("sha").isNotNull())
    why = F.when(F.col("secret"), "secret").when(F.col("stuck"), "stuck").otherwise("refresh")
    out = there.groupBy("path").agg(F.bool_or((F.col("sha") == F.col("reviewed_sha")) | F.col("readable")).alias("read"), F.min_by(why, "set_rank").alias("why"))
    return out.where("not read").select("path", "why")


def mismatch_facts(rows: DataFrame, group: str) -> DataFrame:
    """Of each table's rows (expected, actual) how many have each actual value, and how many are stricter and looser than expected (null if any word is no verdict): group, actual, n, of, stricter, looser."""
    marked = rows.withColumn("_e", strictness(F.col("expected"))).withColumn("_a", strictness(F.col("actual")))
    whole = marked.groupBy(group).agg(F.count(F.lit(1)).alias("of"), F.bool_and(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("known"), F.count_if(F.col("_a") > F.col("_e")).alias("up"), F.count_if(F.col("_a") < F.col("_e")).alias("down"))
    counts = marked.groupBy(group, "actual").agg(F.count(F.lit(1)).alias("n")).join(whole, group)
    return counts.select(group, "actual", "n", "of", F.when(F.col("known"), F.col("up")).alias("stricter"), F.when(F.col("known"), F.col("down")).alias("looser"))


def scripted_answers(asked: DataFrame, script: DataFrame, options: list[str]) -> DataFrame:
    """Answers to asked keys (key, id) from a script (id, choice, confidence): the choice gets its confidence, an equal share at least, the other options the rest in equal parts. Keys without a line get none."""
    lead = F.greatest("confidence", F.lit(1 / len(options)))
    share = F.when(F.lit(len(options) > 1), (1 - lead) / max(1, len(options) - 1)).otherwise(0.0)
    values = F.array(*[F.when(F.col("choice") == o, lead).otherwise(share) for o in options])
    rows = asked.join(script.where(F.col("choice").isin(*options)), "id")
    return rows.select("key", "id", "choice", "confidence", F.map_from_arrays(F.array(*map(F.lit, options)), values).alias("probabilities"))


def revisits(visits: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of a walk (root, id, depth) that lead back to a document it had reached: root, src, dst. They are noted and not followed."""
    out = visits.select("root", F.col("id").alias("src"), F.col("depth").alias("from")).join(links, "src")
    into = visits.select("root", F.col("id").alias("dst"), F.col("depth").alias("to"))
    return out.join(into, ["root", "dst"]).where(F.col("to") <= F.col("from")).select("root", "src", "dst").distinct()
