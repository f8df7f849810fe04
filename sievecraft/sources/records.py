"""Readers of records, questions, catalogs, journals and decisions, and writers of runs. All through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once
from sievecraft.plans.lineage import cut

# Spark's JSON parser takes strings of 20,000,000 characters by itself.
MOST_CHARS = str(2**31 - 1)
RECORD = "id variant, text variant, meta variant, _corrupt string"
CATALOG = "id string, text string, utterances array<string>, negatives array<string>, tags array<string>, _corrupt string"
EVENT = "runId string, timestamp string, type string, step bigint, data string, _corrupt string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").option("maxStringLen", MOST_CHARS).json(path)


def checked(rows: DataFrame, wrong, what: str) -> DataFrame:
    """The rows, failing the job at the first for which ``wrong`` holds."""
    return rows.where(F.when(wrong, F.raise_error(F.lit(what)).cast("boolean")).otherwise(True))


def read_records(spark: SparkSession, path: str, need_text: bool = True) -> DataFrame:
    """id, text, meta of a JSON-lines file. A bad line or an id that is no string fails the job, with ``need_text`` also one without text; blank lines are passed over."""
    field = lambda v: F.try_variant_get(v, "$", "string")
    refused = lambda what: F.raise_error(F.lit(what)).cast("struct<id:string,text:string,meta:string>")

    def told(r: Column) -> Column:
        is_text = F.schema_of_variant(r["text"]) == "STRING"
        told = F.coalesce(is_text & (F.trim(field(r["text"])) != ""), F.lit(False)) if need_text else F.coalesce(is_text, F.lit(True))
        named = F.coalesce(F.schema_of_variant(r["id"]).isin("STRING", "VOID"), F.lit(True))
        record = F.struct(field(r["id"]).alias("id"), field(r["text"]).alias("text"), F.to_json(r["meta"]).alias("meta"))
        bad = ~F.ltrim("value").startswith("{") | r["_corrupt"].isNotNull() | ~told
        return F.when(bad, refused("a record is not valid JSON or has no text")).when(~named, refused("the id of a record is not a string")).otherwise(record)

    read = F.from_json("value", RECORD, {"columnNameOfCorruptRecord": "_corrupt", "maxStringLen": MOST_CHARS})
    lines = spark.read.text(path).where(F.trim("value") != "").select(bound_once(read, told).alias("r"))
    return lines.where(F.col("r").isNotNull()).select("r.*")  # the filter, so that a bad line fails any job over the rows


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with pos, their number from 0 in the order of their files: the parts of files are counted, and only their few counts are added up in one place."""
    marked = cut(rows.withColumns({"_file": F.input_file_name(), "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = marked.groupBy("_file", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file", "_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_file", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_file", "_part").orderBy("_at")) - 1
    return marked.join(offsets, ["_file", "_part"]).withColumn("pos", F.col("_before") + nth).drop("_file", "_part", "_at", "_before")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows with pos; a row without id is named record_<pos>. Missing lists stay null."""
    rows = numbered(checked(_json(spark, path, CATALOG), F.col("_corrupt").isNotNull(), "a catalog row is not valid JSON").drop("_corrupt"))
    return rows.withColumn("id", F.coalesce("id", F.concat(F.lit("record_"), F.col("pos").cast("string"))))


def read_journal(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of an append-only journal; with ``strict`` a bad line fails the job and is named, else it stays in _corrupt."""
    rows = _json(spark, path, EVENT)
    if not strict:
        return rows
    wrong = F.raise_error(F.concat(F.lit("a journal line is not valid JSON: "), F.substring("_corrupt", 1, 200))).cast("boolean")
    return rows.where(F.when(F.col("_corrupt").isNotNull(), wrong).otherwise(True)).drop("_corrupt")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """case_id, verdict, decision of a file of tab-separated lines; the last line of a case counts."""
    rows = spark.read.schema("case_id string, verdict string, decision string").option("sep", "\t").option("quote", "").csv(path)
    marked = rows.withColumn("at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return marked.groupBy("case_id").agg(F.max_by(F.struct("verdict", "decision"), "at").alias("r")).select("case_id", "r.verdict", "r.decision")


def read_files(spark: SparkSession, path: str, pattern: str = "*.md", most_bytes: int = 1 << 20) -> DataFrame:
    """path, sha, text, disposition of all files below ``path``: admitted, or why a file is held."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    held = (
        F.when(F.col("length") > most_bytes, "too large")
        .when(F.col("path").rlike(r"/\.[^/]+(/|$)"), "hidden")
        .when(text.isNull(), "not UTF-8")
        .when(F.instr(text, "\0") > 0, "binary")
        .otherwise("admitted")
    )
    kept = F.when(held == "admitted", text)
    return rows.select("path", F.sha2("content", 256).alias("sha"), kept.alias("text"), held.alias("disposition"))


def held_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def write_run(frames: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder for each named frame; an existing run is never overwritten."""
    for name, rows in frames.items():
        rows.write.mode("errorifexists").json(f"{folder}/{name}")


def append_ledger(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)
