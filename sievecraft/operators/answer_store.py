"""A store of approved answers as versioned tables: changes are written first and published after, so a reader sees whole versions only.

A version is a folder of changes (put or deleted answers) and a marker that publishes it. A writer claims the next version by a file that only one can create: a second one that
wrote the same version fails and merges again on top of the new state. Changes that were written and never published belong to no version, and a claim whose writer was lost before its
marker is an empty version once its lease is over. A reader takes of each key the last change up to
the version that it reads; compaction writes the state of a version as a table of its own, from which later reads start. All tables are read and written by Spark's own sources.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.text import question_key

ENTRY = "pointer string, question string, generation string, fingerprint string, answer string"
CHANGE = ENTRY + ", deleted boolean, version bigint"
POINTER = "pointer string, generation string, fingerprint string, principals array<string>"


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class Store:
    """The store in a folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, folder: str, lease: float = 600.0):
        self.spark, self.folder, self.lease = spark, folder, lease
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path = lambda *parts: jvm.Path("/".join((folder, *parts)))
        self.files = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("claims", "published", "compacted"):
            self.files.mkdirs(self.path(part))

    def _numbers(self, part: str) -> dict[int, str]:
        """Version and table of each marker; a marker is named by both."""
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(part))]
        return {int(n): table for n, _, table in (x.partition("=") for x in names if "=" in x)}

    def version(self) -> int:
        """The last version, 0 of an empty store: versions come in order, each published or, once its claim's lease is over, empty."""
        published, now = self._numbers("published"), time.time()
        claims = {int(s.getPath().getName()): s.getModificationTime() / 1000 for s in self.files.listStatus(self.path("claims")) if s.getPath().getName().isdigit()}
        last = 0
        while last + 1 in published or now - claims.get(last + 1, now) > self.lease:
            last += 1
        return last

    def _publish(self, version: int, table: str) -> None:
        began = time.time()
        try:
            self.files.create(self.path("claims", str(version)), False).close()
        except Exception as e:
            raise Conflict(f"version {version} was claimed by another writer") from e
        if time.time() - began > self.lease / 2:
            raise Conflict(f"version {version} was claimed too long ago")
        self.files.create(self.path("published", f"{version}={table}"), False).close()

    def write(self, changes: DataFrame, based_on: int) -> str:
        """Write the changes (ENTRY and deleted) of the version that follows ``based_on``, unseen by readers: the name of their table."""
        table = uuid.uuid4().hex
        rows = changes.select(*[x.split()[0] for x in ENTRY.split(", ")], "deleted", F.lit(based_on + 1).cast("long").alias("version"))
        rows.write.parquet(f"{self.folder}/tables/{table}")
        return table

    def publish(self, table: str, based_on: int) -> int:
        """Make a written table the next version. Conflict if that is not the version that it was based on."""
        if self.version() != based_on:
            raise Conflict(f"version {self.version()} has been published since {based_on}")
        self._publish(based_on + 1, table)
        return based_on + 1

    def put(self, answers: DataFrame, tries: int = 5) -> int:
        """Merge answers (ENTRY; deleted, if there, takes one away) as a new version, again on top of what others have published meanwhile. Of rows with one key one is kept, the greatest."""
        rows = answers if "deleted" in answers.columns else answers.withColumn("deleted", F.lit(False))
        rows = rows.withColumn("question", question_key(F.col("question")))
        own = F.struct("deleted", "generation", "fingerprint", "answer")
        rows = rows.groupBy("pointer", "question").agg(F.max(own).alias("r")).select("pointer", "question", "r.generation", "r.fingerprint", "r.answer", "r.deleted")
        for _ in range(tries):
            before = self.version()
            try:
                return self.publish(self.write(rows, before), before)
            except Conflict:
                continue
        raise Conflict(f"no version could be published in {tries} tries")

    def changes(self, upto: int | None = None) -> DataFrame:
        """Changes up to a version, from the last compacted state on."""
        upto = self.version() if upto is None else upto
        bases = {v: t for v, t in self._numbers("compacted").items() if v <= upto}
        base = max(bases, default=0)
        tables = [t for v, t in sorted(self._numbers("published").items()) if base < v <= upto]
        paths = [f"{self.folder}/tables/{t}" for t in ([bases[base]] if bases else []) + tables]
        return self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)

    def state(self, upto: int | None = None) -> DataFrame:
        """ENTRY of the answers that stand at a version: of each key the last change, unless it is a deletion. Combined map-side, so a key that is often changed costs each task a row."""
        last = self.changes(upto).groupBy("pointer", "question").agg(F.max(F.struct("version", "deleted", "generation", "fingerprint", "answer")).alias("r"))
        return last.where("not r.deleted").select("pointer", "question", "r.generation", "r.fingerprint", "r.answer")

    def compact(self, pointers: DataFrame | None = None) -> int:
        """Write the state of the last version as one table. With ``pointers``, answers of an older generation or of a pointer that is gone are left out: no lookup finds them any more."""
        version = self.version()
        rows = self.state(version)
        if pointers is not None:
            rows = rows.join(pointers.select("pointer", "generation").distinct(), ["pointer", "generation"], "left_semi")
        table = uuid.uuid4().hex
        rows.select(*[x.split()[0] for x in ENTRY.split(", ")], F.lit(False).alias("deleted"), F.lit(version).cast("long").alias("version")).write.parquet(f"{self.folder}/tables/{table}")
        self.files.create(self.path("compacted", f"{version}={table}"), False).close()  # two of one version hold the same
        return version

    def vacuum(self) -> int:
        """Delete tables that no reader of the last version needs: changes before the last compacted state and tables that were never published. Not while others write."""
        bases, published = self._numbers("compacted"), self._numbers("published")
        base = max(bases, default=0)
        kept = {t for v, t in published.items() if v > base} | ({bases[base]} if bases else set())
        tables = self.path("tables")
        stale = [s.getPath() for s in self.files.listStatus(tables) if s.getPath().getName() not in kept] if self.files.exists(tables) else []
        for path in stale:
            self.files.delete(path, True)
        return len(stale)


def answered(asks: DataFrame, pointers: DataFrame, state: DataFrame) -> DataFrame:
    """(ask columns, state, answer): what the store says to asks (pointer, question, principal).

    In this order: no-pointer, not-allowed (the principal is none of the pointer's), missing, old-generation (the pointer was registered anew since), stale (its sources have changed), hit.
    Only a hit has the answer. ``pointers``: POINTER, a row for each pointer.
    """
    p = pointers.select("pointer", F.col("generation").alias("now"), F.col("fingerprint").alias("print"), "principals")
    s = state.select("pointer", F.col("question").alias("asked"), F.col("generation").alias("then"), F.col("fingerprint").alias("of"), "answer")
    rows = asks.withColumn("asked", question_key(F.col("question"))).join(p, "pointer", "left").join(s, ["pointer", "asked"], "left")
    told: Column = (
        F.when(F.col("now").isNull(), "no-pointer")
        .when(~F.coalesce(F.array_contains("principals", F.col("principal")), F.lit(False)), "not-allowed")
        .when(F.col("then").isNull(), "missing")
        .when(F.col("then") != F.col("now"), "old-generation")
        .when(~F.col("of").eqNullSafe(F.col("print")), "stale")
        .otherwise("hit")
    )
    return rows.withColumn("state", told).select(*asks.columns, "state", F.when(F.col("state") == "hit", F.col("answer")).alias("answer"))


def registered(before: DataFrame, rows: DataFrame, new_generation: Column) -> DataFrame:
    """POINTER after pointers (pointer, fingerprint, principals) are registered: one of which nothing has changed keeps its generation, any other gets ``new_generation`` (its saved answers are then of an older one)."""
    old = before.select("pointer", F.col("generation").alias("g"), F.col("fingerprint").alias("f"), F.array_sort("principals").alias("p"))
    new = rows.select("pointer", "fingerprint", F.array_sort("principals").alias("principals")).withColumn("fresh", new_generation)
    same = F.col("f").eqNullSafe(F.col("fingerprint")) & F.col("p").eqNullSafe(F.col("principals"))
    both = old.join(new, "pointer", "full_outer")
    left = F.col("fresh").isNull()
    generation = F.when(left | (F.col("g").isNotNull() & same), F.col("g")).otherwise(F.col("fresh"))
    return both.select("pointer", generation.alias("generation"), F.when(left, F.col("f")).otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(left, F.col("p")).otherwise(F.col("principals")).alias("principals"))
