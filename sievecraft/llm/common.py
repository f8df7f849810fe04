"""Shared pieces of the corpus operators: cutting lineage, the folder for it, and decisions applied to rows without moving texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own only where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="sievecraft-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder, so that later steps reread it and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """A hint to collect the driver's garbage: only then Spark deletes the shuffle files of steps that were cut."""
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared folder, for what is wide or read in parts, until ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete_folder(self.spark, self.path)


def delete_folder(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of an Arrow batch that a Python function works on at once: what it holds stays small, however large the batches are.
ROWS_AT_ONCE = 256


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


#: Bytes of a text whose words are listed at once.
PIECE = 1 << 20


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words between blanks, of some PIECE bytes at a time: of a very long text few are held at once."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Rows of an Arrow batch, where the session doesn't say otherwise: rows hold whole texts, and both sides of a Python function hold whole batches.
BATCH_ROWS, BATCH_SETTING, SPARKS_OWN = "512", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets the session's Arrow batches to BATCH_ROWS unless it has a number of its own."""
    if spark.conf.get(BATCH_SETTING, SPARKS_OWN) == SPARKS_OWN:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Keys that are broadcast as they are, of 20 bytes each; more are broadcast as a Bloom filter.
MAX_BROADCAST_KEYS = 200_000
#: Bits of one bitmap of a filter (fixed by bitmap_construct_agg), bitmaps of the largest filter (64 MB), bits that each key sets and may take.
BITMAP, MAX_BITMAPS, PROBES, BITS_OF_KEY = 32768, 16384, 4, 16


def text_print(column: str = "text"):
    """64-bit print of a text: with doc_id it names a row even where ids repeat or are null."""
    return F.xxhash64(text_or_empty(column))


def _probe(doc_id: Column, print_: Column, k: int, size: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, print_, F.lit(k)), F.lit(size)).cast("int")


def split_by_filter(rows: DataFrame, keys: DataFrame, n: int, of_row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text, any others) whose key may be among the ``n`` keys (k_id, k_print), and those that surely are not.

    ``of_row`` is the print of a row where it is not that of its text. The filter is of bounded size: of many more keys than it holds well, more rows pass as possible, and none is lost.
    """
    bitmaps = max(1, min(MAX_BITMAPS, -(-n * BITS_OF_KEY // BITMAP)))
    names: list[str] = []
    for name in ("of", "bits", "print"):
        names.append(fresh([*rows.columns, *names], name))
    of, bits, print_ = names
    places = F.array(*[_probe(F.col("k_id"), F.col("k_print"), k, BITMAP) for k in range(1, PROBES + 1)])
    held = keys.select(_probe(F.col("k_id"), F.col("k_print"), 0, bitmaps).alias(of), F.explode(places).alias("place"))
    held = cut(held.groupBy(of).agg(F.bitmap_construct_agg("place").alias(bits)))
    named = rows.withColumn(print_, text_print() if of_row is None else of_row)
    met = named.withColumn(of, _probe(F.col("doc_id"), F.col(print_), 0, bitmaps)).join(F.broadcast(held), of, "left")

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, place % 8) == 1

    among = F.col(bits).isNotNull()
    for k in range(1, PROBES + 1):
        among = among & is_set(_probe(F.col("doc_id"), F.col(print_), k, BITMAP))
    among = F.coalesce(among, F.lit(False))
    return met.where(among).select(*rows.columns), met.where(~among).select(*rows.columns)


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, print, kept; a row for each row of docs) keeps.

    Few keys of dropped rows are broadcast. Many are broadcast as a Bloom filter of bounded size, and only the rows that it lets
    pass, dropped ones nearly all, meet the keys in a shuffle; the texts of other rows stay where they are.
    Rows that repeat a kept key, of which decisions keep only one, are thinned to one. No column name of ``docs`` is reserved.
    """
    keys = decisions.groupBy("doc_id", "print").agg(F.max("kept").alias("any"), F.sum((~F.col("kept")).cast("long")).alias("dropped"))
    keys = cut(keys.where("not any or dropped > 0").select(F.col("doc_id").alias("k_id"), F.col("print").alias("k_print"), "any"))
    counts = {r["any"]: r["count"] for r in keys.groupBy("any").count().collect()}
    n = sum(counts.values())
    if not n:
        return docs
    names: list[str] = []
    for name in ("k_id", "k_print", "any", "print"):
        names.append(fresh([*docs.columns, *names], name))
    k_id, k_print, some, print_ = names
    few = n <= MAX_BROADCAST_KEYS
    maybe, rest = (docs, None) if few else split_by_filter(docs, keys, n)
    renamed = keys.select(F.col("k_id").alias(k_id), F.col("k_print").alias(k_print), F.col("any").alias(some))
    same = F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(print_) == F.col(k_print))
    met = maybe.withColumn(print_, text_print()).join(F.broadcast(renamed) if few else renamed, same, "left")
    kept = met.where(F.col(some).isNull()).select(*docs.columns)
    if counts.get(True):
        kept = kept.unionByName(met.where(some).dropDuplicates(["doc_id", print_]).select(*docs.columns))
    return kept if rest is None else kept.unionByName(rest)
