"""Queries that run as streams: events arrive in parts, and the stream is started anew from its checkpoint after each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.plans.lineage import cut, scratch
from sievecraft.queries.documents import table
from sievecraft.queries.evaluation import d, digit
from sievecraft.queries.files import SQL as FILES_SQL
from sievecraft.queries.state import SQL as STATE_SQL
from sievecraft.sources.records import read_journal
from sievecraft.streaming import runs as R
from sievecraft.streaming import state as S

ARRIVALS = 3


def t4_autosave_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of wins of each user after the last event, kept as state between batches and starts."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(key.cast("string"), 19, "0")).alias("seq"),
        F.when(digit("k", key, 11) == 0, "miss").otherwise("lookup").alias("kind"), digit("w", key, 3).cast("string").alias("winner"), (digit("p", key, 7) == 0).alias("partial"), "ts",
    )
    with scratch(spark) as folder:
        found = S.current_runs(R.file_stream(spark, f"{folder}/in", rows.schema))
        R.in_arrivals(rows, "ts", f"{folder}/in", ARRIVALS, lambda _: R.run_batches(found, f"{folder}/run", "update"))
        told = R.latest(R.batches(spark, f"{folder}/run", found.schema), "key")
        return cut(told.select(F.col("key").cast("long").alias("user_id"), F.col("winner").cast("long").alias("winner"), "wins"))


def k3_journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a journal by a stream, and the journal read back."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("runId"), F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("type"), F.col("event_id").cast("long").alias("step"), F.col("props").alias("data"), "ts")
    with scratch(spark) as folder:
        stream = R.file_stream(spark, f"{folder}/in", rows.schema).drop("ts")
        R.in_arrivals(rows, "ts", f"{folder}/in", ARRIVALS, lambda _: R.append_journal(stream, f"{folder}/journal", f"{folder}/run"))
        return cut(read_journal(spark, f"{folder}/journal").select("runId", "type", "step", F.md5("data").alias("data_md5")))


def t7_labelled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces; two of three have an outcome after some minutes, which labels its trace if it comes within the hour. A last pair of rows far behind lets the watermark pass all others."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("lookup_id"), F.col("ts").cast("timestamp").alias("ts"))
    late = rows.agg(F.lit(-1).cast("long").alias("lookup_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    made = table(spark, sf_dir, "events").where(digit("has", key, 3) > 0).select(
        F.col("event_id").alias("lookup_id"), F.concat(F.lit("r"), digit("res", key, 4).cast("string")).alias("result"), F.timestamp_add("MINUTE", digit("wait", key, 90).cast("int"), F.col("ts").cast("timestamp")).alias("ts")
    )
    with scratch(spark) as folder:
        traces, outcomes = R.file_stream(spark, f"{folder}/traces", rows.schema), R.file_stream(spark, f"{folder}/outcomes", made.schema)
        found = S.labelled_traces(traces, outcomes)
        last = late.select("lookup_id", F.lit("none").alias("result"), "ts")
        made.coalesce(1).write.mode("append").parquet(f"{folder}/outcomes")
        R.in_arrivals(rows, "ts", f"{folder}/traces", ARRIVALS, lambda _: R.run_batches(found, f"{folder}/run"))
        for _ in range(2):  # the second pair makes a batch in which what the first has let pass is told
            late.coalesce(1).write.mode("append").parquet(f"{folder}/traces")
            last.coalesce(1).write.mode("append").parquet(f"{folder}/outcomes")
            R.run_batches(found, f"{folder}/run")
        told = R.batches(spark, f"{folder}/run", found.schema).where("lookup_id >= 0")
        return cut(told.select("lookup_id", "result"))


QUERIES = {"t4_autosave_stream": t4_autosave_stream, "k3_journal_stream": k3_journal_stream, "t7_labelled_stream": t7_labelled_stream}
SQL = {
    "t4_autosave_stream": STATE_SQL["w1_current_runs"],
    "k3_journal_stream": FILES_SQL["s10_read_journal"],
    "t7_labelled_stream": f"""SELECT event_id AS lookup_id, CASE WHEN {d('has', 'event_id', 3)} > 0 AND {d('wait', 'event_id', 90)} <= 60 THEN 'r' || {d('res', 'event_id', 4)} END AS result FROM events""",
}
