"""Queries over readers and writers: tables are written as files into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.plans.lineage import cut, scratch
from sievecraft.queries.documents import table
from sievecraft.queries.evaluation import d, digit
from sievecraft.sources import records as S


def s1_read_records(spark, sf_dir):
    """Documents as lines of JSON, some without id, written as a run and read as records; those without text are rows too."""
    key = F.col("doc_id")
    meta = F.when(F.col("lang").isNotNull(), F.struct("lang"))
    rows = table(spark, sf_dir, "documents").select(F.when(digit("id", key, 9) > 0, key.cast("string")).alias("id"), "text", meta.alias("meta"))
    with scratch(spark) as folder:
        S.write_run({"records": rows}, folder)
        return cut(S.read_records(spark, f"{folder}/records", need_text=False).select("id", F.md5("text").alias("text_md5"), "meta"))


def s3_read_catalog(spark, sf_dir):
    """Lines of documents as a catalog; its rows have their places, and those without id are named after them."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(digit("id", key, 4) > 0, key.cast("string")).alias("id"), "text", F.when(digit("u", key, 3) > 0, F.split("text", "\n")).alias("utterances"))
    with scratch(spark) as folder:
        rows.write.json(folder)
        found = S.read_catalog(spark, folder)
        named = (F.col("id") == F.concat(F.lit("record_"), F.col("pos").cast("string"))).alias("by_place")
        return cut(found.groupBy(named).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.greatest(F.size("utterances"), F.lit(0)), F.lit(0))).cast("long").alias("utterances"), F.countDistinct("id").alias("ids")))


def s10_read_journal(spark, sf_dir):
    """Events as an append-only journal, in two appends."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("runId"), F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("type"), F.col("event_id").cast("long").alias("step"), F.col("props").alias("data"))
    with scratch(spark) as folder:
        S.append_ledger(rows.where("type = 'click'"), folder)
        S.append_ledger(rows.where("type is null or type <> 'click'"), folder)
        return cut(S.read_journal(spark, folder).select("runId", "type", "step", F.md5("data").alias("data_md5")))


def s11_read_decisions(spark, sf_dir):
    """Decisions over documents as tab-separated lines."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(key.cast("string").alias("case_id"), F.concat(F.lit("verdict "), digit("v", key, 50).cast("string")).alias("verdict"), F.when(digit("d", key, 2) == 0, "true").otherwise("false").alias("decision"))
    with scratch(spark) as folder:
        rows.write.option("sep", "\t").option("quote", "").csv(folder)
        return cut(S.read_decisions(spark, folder))


QUERIES = {"s1_read_records": s1_read_records, "s3_read_catalog": s3_read_catalog, "s10_read_journal": s10_read_journal, "s11_read_decisions": s11_read_decisions}
SQL = {
    "s1_read_records": f"""SELECT CASE WHEN {d('id', 'doc_id', 9)} > 0 THEN CAST(doc_id AS VARCHAR) END AS id, md5(text) AS text_md5, '{{"lang":"' || lang || '"}}' AS meta FROM documents""",
    "s3_read_catalog": f"""
        WITH x AS (SELECT {d('id', 'doc_id', 4)} = 0 AS by_place, CASE WHEN {d('u', 'doc_id', 3)} > 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS u FROM documents)
        SELECT by_place, count(*) AS n, CAST(sum(u) AS BIGINT) AS utterances, count(*) AS ids FROM x GROUP BY by_place""",
    "s10_read_journal": """SELECT CAST(user_id AS VARCHAR) AS "runId", event_type AS type, CAST(event_id AS BIGINT) AS step, md5(props) AS data_md5 FROM events""",
    "s11_read_decisions": f"SELECT CAST(doc_id AS VARCHAR) AS case_id, 'verdict ' || {d('v', 'doc_id', 50)} AS verdict, CASE WHEN {d('d', 'doc_id', 2)} = 0 THEN 'true' ELSE 'false' END AS decision FROM documents",
}
