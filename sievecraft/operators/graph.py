"""Bounded walks, beam search over a tree, folder roll-up and connected groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.plans.lineage import cut


def walk(roots: DataFrame, links: DataFrame, max_depth: int = 3) -> DataFrame:
    """Breadth-first walk from each root (root): root, id, depth of the first visit. One join for each level of a small bound.

    ``links``: src, dst. A second arrival, in a cycle or not, is not followed again.
    """
    seen = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, max_depth + 1):
        following = front.join(links, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        front = cut(following.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen


def walk_report(visits: DataFrame, links: DataFrame, docs: DataFrame, max_depth: int = 3) -> DataFrame:
    """For each root: visited, dangling (visited ids that are no document), depth reached, and truncated (a document at the bound has links)."""
    known = docs.select(F.col("id"), F.lit(True).alias("known")).distinct()
    linked = links.select(F.col("src").alias("id"), F.lit(True).alias("linked")).distinct()
    rows = visits.join(known, "id", "left").join(linked, "id", "left")
    return rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("visited"),
        F.count_if(F.col("known").isNull()).alias("dangling"),
        F.max(F.when(F.col("known"), F.col("depth"))).alias("depth"),
        F.bool_or((F.col("depth") == max_depth) & F.col("known").isNotNull() & F.col("linked").isNotNull()).alias("truncated"),
    )


def beam(requests: DataFrame, edges: DataFrame, rounds: int, width: int, p: Column | None = None, none: Column | None = None) -> DataFrame:
    """Beam search: the ``width`` best paths of each request by the geometric mean of their edges' probabilities.

    ``edges``: request, parent, child, p; a branch without edges is a leaf and stays. Ties fall to the path.
    Without request they are one tree for all; ``p`` is then made of request and child as paths reach them. Where a branch's likeliest choice is
    none (the probability ``none``, made of request and node), the branch is pruned and none of its children is followed.
    """
    front = requests.select("request", F.lit("root").alias("node"), F.lit("root").alias("path"), F.lit(0.0).alias("log"), F.lit(0).alias("steps"))
    for _ in range(rounds):
        grown = front.join(edges.withColumnRenamed("parent", "node"), [c for c in ("request", "node") if c != "request" or c in edges.columns], "left")
        grown = grown if p is None else grown.withColumn("p", p)
        if none is not None:
            best = grown.groupBy("request", "path").agg(F.max("p").alias("_best"))
            grown = grown.join(best, ["request", "path"]).where(F.col("child").isNull() | (F.col("_best") >= none)).drop("_best")
        moved = F.col("child").isNotNull()
        front = grown.select(
            "request",
            F.coalesce("child", "node").alias("node"),
            F.when(moved, F.concat_ws("/", "path", "child")).otherwise(F.col("path")).alias("path"),
            (F.col("log") + F.when(moved, F.log(F.greatest("p", F.lit(5e-324)))).otherwise(0.0)).alias("log"),
            (F.col("steps") + moved.cast("int")).alias("steps"),
        )
        score = F.when(F.col("steps") > 0, F.exp(F.col("log") / F.col("steps"))).otherwise(1.0)
        front = front.withColumn("score", score)
        rank = F.row_number().over(W.partitionBy("request").orderBy(F.round("score", 9).desc(), "path"))
        front = front.withColumn("rank", rank).where(F.col("rank") <= width)
    return front.select("request", "node", "path", "score", "rank")


def folder_units(files: DataFrame, least: int = 5) -> DataFrame:
    """path, unit: the folder a file is listed under. Folders of fewer than ``least`` files pass theirs to the parent, never above ``top``.

    ``files``: path, top. Counting and moving repeat until nothing moves; a round moves one level, so the depth of the tree bounds them.
    """
    parent = F.regexp_replace("unit", "/?[^/]*$", "")
    rows = cut(files.withColumn("unit", F.regexp_replace("path", "/?[^/]*$", "")))
    while True:
        small = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("unit", F.lit(True).alias("small"))
        marked = rows.join(small, "unit", "left")
        moves = F.col("small").isNotNull() & (F.col("unit") != F.col("top")) & (F.length("unit") > F.length("top"))
        moved = cut(marked.select("path", "top", F.when(moves, parent).otherwise(F.col("unit")).alias("unit"), moves.alias("moved")))
        rows = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return rows.select("path", "unit")


def connected(members: DataFrame) -> DataFrame:
    """Members (member, key) that share keys, directly or not: member, group (the smallest member).

    A key links all of its members to the smallest of them, so these links, each once, stand for the keys: all rows are shuffled twice
    and not in every round. Labels pass along the links until stable. A label also takes the label of the member it names, and hands its
    own smaller label to that member, so the rounds don't follow the length of a chain.
    """
    heads = members.groupBy("key").agg(F.min("member").alias("head"))
    # one row for each key, so hashing it spares sorting all rows
    pairs = cut(members.join(heads.hint("shuffle_hash"), "key").select("member", F.col("head").alias("key")).where("member is not null").distinct())
    labels = pairs.groupBy("member").agg(F.min("key").alias("group"))
    while True:
        of_key = pairs.join(labels, "member").groupBy("key").agg(F.min("group").alias("group"))
        near = pairs.join(of_key, "key").groupBy("member").agg(F.min("group").alias("near"))
        told = labels.join(near, "member").groupBy("group").agg(F.min("near").alias("near")).withColumnRenamed("group", "member")
        new = near.unionByName(told).groupBy("member").agg(F.min("near").alias("group"))
        named = new.select(F.col("member").alias("group"), F.col("group").alias("least"))
        new = cut(new.join(named, "group").select("member", F.col("least").alias("group")))
        if new.join(labels, ["member", "group"], "left_anti").isEmpty():
            return new
        labels = new


def folder_rows(files: DataFrame, most: int = 40, least: int = 5) -> DataFrame:
    """unit, n and names of each folder's files (path, top): the first ``most`` names below the folder, in order, cut there since a listing is what it is for.

    A name is counted once, however many tops list its file.
    """
    units = folder_units(files, least)
    name = F.when(F.col("unit") == "", F.col("path")).otherwise(F.expr("substring(path, length(unit) + 2)"))
    named = units.select("unit", name.alias("name"))
    first = named.distinct().withColumn("rank", F.row_number().over(W.partitionBy("unit").orderBy("name"))).where(F.col("rank") <= most)
    listed = first.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "|").alias("names"))
    return named.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).join(listed, "unit")
