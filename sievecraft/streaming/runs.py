"""Running a stream to the end of what there is, in starts that go on from a checkpoint, and reading what its batches left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, all that have come in a batch, or ``files`` of them in the order in which they came. A folder that isn't there yet is made."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run_batches(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Run until all that has come is done. Each batch is a folder of its own that a repeated batch replaces, so a batch that is run again after a loss counts once."""

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()


def batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What all batches have left, with ``batch``, their number."""
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/batches")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last batch of each key."""
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(key, "r.*")


def append_journal(stream: DataFrame, path: str, folder: str) -> None:
    """Append a stream's rows to a journal of JSON lines; the sink's own log keeps a batch that is run again from counting twice."""
    writer = stream.writeStream.format("json").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", path).trigger(availableNow=True)
    writer.start().awaitTermination()


def in_arrivals(rows: DataFrame, order: str, path: str, arrivals: int, between: Callable[[int], None]) -> None:
    """Write the rows in arrivals, one after the other, cut by equal stretches of ``order`` (a timestamp); ``between`` runs after each, which has as many files as the rows have partitions."""
    seconds = F.col(order).cast("timestamp").cast("double")
    low, high = rows.agg(F.min(seconds), F.max(seconds)).first()
    stretch = ((high or 0) - (low or 0)) / arrivals + 1
    for k in range(arrivals):
        part = rows.where(F.floor((seconds - F.lit(low or 0)) / F.lit(stretch)) == k)
        part.write.mode("append").parquet(path)
        between(k)
