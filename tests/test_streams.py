import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sievecraft.operators import logs as L
from sievecraft.sources.records import read_journal
from sievecraft.streaming import runs as R
from sievecraft.streaming import state as S


def made(spark):
    r = random.Random(5)
    rows = [(f"u{r.randrange(4)}", f"{k:05}", r.choice(["lookup"] * 4 + ["miss"]), r.choice("ab"), r.random() < 0.2, 1_700_000_000 + k * 60) for k in range(300)]
    frame = spark.createDataFrame(rows, "key string, seq string, kind string, winner string, partial boolean, at long")
    return frame.withColumn("ts", F.col("at").cast("timestamp")).drop("at")


def test_state_equals_the_batch_form_after_a_crash_between_write_and_commit(spark, tmp_path):
    rows, folder = made(spark), str(tmp_path / "run")
    found = S.current_runs(R.file_stream(spark, str(tmp_path / "in"), rows.schema))
    crashed = []

    def crash(frame, number):
        frame.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")
        crashed.append(number)
        raise RuntimeError("lost after the write")

    def arrived(k):
        if k == 1:
            writer = found.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
            with pytest.raises(StreamingQueryException):
                writer.foreachBatch(crash).start().awaitTermination()
        R.run_batches(found, folder, "update")

    R.in_arrivals(rows, "ts", str(tmp_path / "in"), 3, arrived)
    got = R.latest(R.batches(spark, folder, found.schema), "key").collect()
    want = L.current_runs(rows, "key", ["seq"]).collect()
    assert crashed == [1] and sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4
    assert R.batches(spark, folder, found.schema).select("batch").distinct().count() == 3


def test_a_journal_holds_each_event_once(spark, tmp_path):
    rows = made(spark).select(F.col("key").alias("runId"), F.col("ts").cast("string").alias("timestamp"), F.col("kind").alias("type"), F.col("seq").cast("long").alias("step"), F.col("winner").alias("data"), "ts")
    stream = R.file_stream(spark, str(tmp_path / "in"), rows.schema).drop("ts")
    append = lambda _: R.append_journal(stream, str(tmp_path / "journal"), str(tmp_path / "run"))
    R.in_arrivals(rows, "ts", str(tmp_path / "in"), 3, append)
    append(0)
    got = read_journal(spark, str(tmp_path / "journal")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.drop("ts").collect())) and len(got) == 300


def test_late_outcomes_leave_their_traces_without_a_label(spark, tmp_path):
    at = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", (F.col("at") + 1_700_000_000).cast("timestamp")).drop("at")
    traces = at([(1, 0), (2, 60), (3, 120), (4, 7200), (9, 10**6)], "lookup_id long, at long")
    outcomes = at([(1, "right", 30), (2, "wrong", 3661), (3, "right", 3720), (4, "right", 7199), (9, "none", 10**6)], "lookup_id long, result string, at long")
    found = S.labelled_traces(R.file_stream(spark, str(tmp_path / "t"), traces.schema), R.file_stream(spark, str(tmp_path / "o"), outcomes.schema))
    for part in ("lookup_id < 4", "lookup_id >= 4", "lookup_id = 9"):
        traces.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        outcomes.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
        R.run_batches(found, str(tmp_path / "run"))
    got = {r.lookup_id: r.result for r in R.batches(spark, str(tmp_path / "run"), found.schema).where("lookup_id < 9").collect()}
    assert got == {1: "right", 2: None, 3: "right", 4: None}


def test_an_arrival_of_many_files_is_one_batch(spark, tmp_path):
    rows = spark.range(600).selectExpr("cast(id % 7 AS string) AS key", "lpad(cast(id AS string), 5, '0') AS seq", "'lookup' AS kind", "'a' AS winner", "false AS partial", "timestamp_seconds(id) AS ts").repartition(4)
    found = S.current_runs(R.file_stream(spark, str(tmp_path / "in"), rows.schema))
    R.in_arrivals(rows, "ts", str(tmp_path / "in"), 3, lambda _: R.run_batches(found, str(tmp_path / "run"), "update"))
    told = R.batches(spark, str(tmp_path / "run"), found.schema)
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 3 and told.select("batch").distinct().count() == 3
    assert {(r.key, r.wins) for r in R.latest(told, "key").collect()} == {(str(k), len(range(k, 600, 7))) for k in range(7)}
