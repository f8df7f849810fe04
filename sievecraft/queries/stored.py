"""Queries of the answer store: documents as answers put in three versions, pages of the state, and turns of conversations as asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.operators import answer_store as A
from sievecraft.plans.lineage import cut, scratch
from sievecraft.queries.documents import table
from sievecraft.queries.evaluation import d, digit


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a pointer that is registered, and registered again: those of even digit with other sources."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("pointer")).distinct()
    agents = F.array(F.concat(F.lit("agent"), digit("ag", F.col("pointer"), 3).cast("string")), F.lit("lead"))
    first = A.registered(spark.createDataFrame([], A.POINTER), names.select("pointer", F.lit("f1").alias("fingerprint"), agents.alias("principals")), F.lit("g1"))
    again = names.select("pointer", F.when(digit("re", F.col("pointer"), 4) == 0, "f2").otherwise("f1").alias("fingerprint"), agents.alias("principals"))
    return A.registered(first, again, F.lit("g2"))


def g7_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations asking what documents answer, by their store after three versions, of which one takes answers away, and a compaction between."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        key, F.col("source").alias("pointer"), F.concat(F.lit("  What of "), (key % 4000).cast("string"), F.lit("?? ")).alias("question"), F.lit("g1").alias("generation"),
        F.when(digit("st", key, 6) == 0, "f0").otherwise("f1").alias("fingerprint"), F.md5(F.coalesce("text", F.lit(""))).alias("answer"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    slot = F.col("conv_id") * 31 + F.col("turn")
    asks = turns.withColumn("pointer", F.concat(F.lit("src"), ((slot % 997) % 21).cast("string"))).select(
        "conv_id", "turn", "pointer", F.concat(F.lit("what OF "), (slot % 997).cast("string")).alias("question"), F.concat(F.lit("agent"), (slot % 3).cast("string")).alias("principal"))
    with scratch(spark) as folder:
        store = A.Store(spark, folder)
        store.put(rows)
        store.put(rows.where(digit("up", key, 3) == 0).withColumn("answer", F.concat(F.lit("new "), "answer")))
        store.compact()
        store.put(rows.where(digit("del", key, 5) == 0).withColumn("deleted", F.lit(True)))
        return cut(A.answered(asks, _pointers(spark, sf_dir), store.state()).drop("question"))


G7 = f"""WITH r AS (SELECT doc_id, source AS pointer, 'what of ' || (doc_id % 4000) AS question, CASE WHEN {d('st', 'doc_id', 6)} = 0 THEN 'f0' ELSE 'f1' END AS fingerprint, md5(coalesce(text, '')) AS answer FROM documents),
c AS (SELECT pointer, question, 1 AS v, false AS deleted, fingerprint, answer FROM r UNION ALL SELECT pointer, question, 2, false, fingerprint, 'new ' || answer FROM r WHERE {d('up', 'doc_id', 3)} = 0
      UNION ALL SELECT pointer, question, 3, true, fingerprint, answer FROM r WHERE {d('del', 'doc_id', 5)} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY pointer, question ORDER BY v DESC, fingerprint DESC, answer DESC) AS n FROM c),
s AS (SELECT * FROM k WHERE n = 1 AND NOT deleted),
p AS (SELECT DISTINCT source AS pointer, CASE WHEN {d('re', 'source', 4)} = 0 THEN 'g2' ELSE 'g1' END AS g, CASE WHEN {d('re', 'source', 4)} = 0 THEN 'f2' ELSE 'f1' END AS f, 'agent' || {d('ag', 'source', 3)} AS agent FROM documents),
a AS (SELECT conv_id, turn, 'src' || (((conv_id * 31 + turn) % 997) % 21) AS pointer, 'what of ' || ((conv_id * 31 + turn) % 997) AS question, 'agent' || ((conv_id * 31 + turn) % 3) AS principal FROM conversations),
t AS (SELECT conv_id, turn, a.pointer, principal, answer, CASE WHEN p.g IS NULL THEN 'no-pointer' WHEN principal <> agent THEN 'not-allowed' WHEN s.answer IS NULL THEN 'missing' WHEN p.g <> 'g1' THEN 'old-generation' WHEN s.fingerprint <> p.f THEN 'stale' ELSE 'hit' END AS state
      FROM a LEFT JOIN p USING (pointer) LEFT JOIN s ON s.pointer = a.pointer AND s.question = a.question)
SELECT conv_id, turn, pointer, principal, state, CASE WHEN state = 'hit' THEN answer END AS answer FROM t"""

QUERIES = {"g7_answers": g7_answers}
SQL = {"g7_answers": G7}
