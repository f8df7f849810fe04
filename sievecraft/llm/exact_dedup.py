"""Exact deduplication with a split of heavy hitters (DataFrame functions only).

A Misra-Gries summary names the few digests that may hold a large share of all
rows. Their exact group sizes and winners come from a map-side combined
aggregate and are broadcast (at most ``max_hot`` rows), so the rows of a huge
group of copies never meet in one task. All other digests, each of a bounded
share of the rows, are shuffled in the ordinary way. Only a narrow table of
(doc_id, length, digest) is shuffled, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.llm.common import cut, keep_rows, table, text_or_empty, text_print

#: Of the Misra-Gries summary: every digest of over 3.5 / HOT_TRACKED of all rows is found.
HOT_TRACKED = 4096
#: At most so many digests are broadcast, of about 120 bytes each.
HOT_BROADCAST = 1000
#: Partial summaries that one task merges.
HOT_FAN_IN = 64


def normalised(column: str = "text") -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: doc_id, n (code points), digest (32 bytes), print (of the text), rid (of the row)."""
    return cut(
        docs.select(
            F.col("doc_id"),
            F.length(text_or_empty()).alias("n"),
            F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"),
            text_print().alias("print"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )


def hot_digests(rows: DataFrame, tracked: int = HOT_TRACKED, most: int = HOT_BROADCAST) -> DataFrame:
    """Digests (as 64-bit prints) that the Misra-Gries summary reports as frequent: at most ``most`` rows.

    Summaries are mergeable, so they are built for each group of partitions and then merged.
    """
    part = F.spark_partition_id()
    sketch = (
        rows.select(F.xxhash64("digest").alias("print"), (part / HOT_FAN_IN).cast("int").alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(print, {tracked})").alias("sketch"))
        .groupBy(F.lit(0).alias("all"))  # by a key, since a merge without any row or in an empty partition fails
        .agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    )
    return sketch.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("hot")).select(
        F.col("hot.item").alias("print")
    )


def order_of_rows() -> list[Column]:
    """Which of equal texts stays: most code points, then smallest doc_id (null last), then the earlier row."""
    return [F.col("n").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid").asc()]


def exact_groups(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with its group of equal normalised texts.

    Result: doc_id, keep_id, group_size, kept, text_sha256, print (text_print of the row). Null text is empty, empty texts form one group. Of rows
    repeated with one doc_id exactly one is kept. A null doc_id stays only where its
    group has no other. Other columns of ``docs`` are ignored.
    """
    rows = digests(docs.select("doc_id", "text"))
    hot = cut(hot_digests(rows))
    is_hot = F.broadcast(hot)
    keyed = rows.withColumn("print", F.xxhash64("digest"))
    winners = (
        keyed.join(is_hot, "print", "left_semi")
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"),
        )
        .where("group_size > 1")
        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    )
    winners = F.broadcast(cut(winners))  # verified; of at most HOT_BROADCAST rows
    of_hot = rows.join(winners, "digest").withColumn("kept", F.col("rid") == F.col("keep_rid"))
    group = W.partitionBy("digest")
    ranked = group.orderBy(*order_of_rows())
    of_rest = (
        rows.join(winners, "digest", "left_anti")
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("keep_id", F.first("doc_id").over(ranked))
        .withColumn("kept", F.col("rank") == 1)
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "print"]
    return of_hot.select(*columns).unionByName(of_rest.select(*columns))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay of their groups."""
    return keep_rows(docs, exact_groups(docs).select("doc_id", "print", "kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("print")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM t
"""
