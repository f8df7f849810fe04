"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints are made one document at a time, in Arrow batches. Equal fingerprints are
collapsed before the search. The search is exact: with a vector m(i) of r + 1 bits for each of
the 64 positions, and for each non-zero v the mask of positions with <m(i), v> = 1, any r
differing positions are orthogonal to some v, so every pair within radius r agrees under the
mask of that v. Of 2^(r+1) - 1 tables, a pair is reported by the first that holds it.

A bucket of over BUCKET fingerprints is dealt again by a covering family over the positions that
its mask leaves free; where even that leaves a larger bucket, each fingerprint looks up the
ball of radius r over the few positions still free, which costs a fixed number of rows. So no
bucket is paired with itself beyond BUCKET rows, and no pair is lost.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import cut, in_slices, keep_rows, table, text_print
from sievecraft.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 128
#: Shingles whose bits are counted at once: bounds the memory for very long texts.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the UTF-8 text: lower-cased A-Z, ASCII white space splits words, bit set in over half the shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
        n = 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = np.fromiter(map(digest, shingles), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        octets = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        prints = [fingerprint(x or b"") for x in batch.column(2).to_pylist()]
        made = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["doc_id", "print", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (text_print) and fp (64 bits, as a signed long) of each row."""
    rows = docs.select("doc_id", text_print().alias("print"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, print bigint, fp bigint")


def _free(mask: int) -> list[int]:
    return [p for p in range(BITS) if not mask >> p & 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(positions: list[int], radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """Masks of which every set of up to ``radius`` of the positions is missed by at least one."""
    width = radius + 1
    vectors = [1 + k % ((1 << width) - 1) for k in range(len(positions))]
    random.Random(seed).shuffle(vectors)
    return [
        sum(1 << p for p, m in zip(positions, vectors, strict=True) if bin(m & v).count("1") % 2)
        for v in range(1, 1 << width)
    ]


def _buckets(rows: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and table: t, key, fp."""
    of = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
    return rows.select("fp", F.explode(F.array(*of)).alias("b")).select("b.t", "b.key", "fp")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _pairs(small: DataFrame) -> DataFrame:
    left = small.withColumnRenamed("fp", "u")
    right = small.withColumnRenamed("fp", "v")
    return left.join(right, ["t", "key"]).where((F.col("u") < F.col("v")) & _near("u", "v")).select("u", "v")


def _sized(rows: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets that can be paired as they are, and of larger ones. Buckets of one are left out."""
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = cut(rows.join(sizes, ["t", "key"]))
    return sized.where(F.col("size") <= bucket).drop("size"), sized.where(F.col("size") > bucket).drop("size")


def near_pairs(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs u < v of the distinct fingerprints in ``rows`` (fp) that differ in at most RADIUS bits; each at least once."""
    masks = covering_masks(list(range(BITS)))
    small, large = _sized(_buckets(rows, masks), bucket)
    found = _pairs(small)
    if large.isEmpty():
        return found
    again = [(t, [mask | m for m in covering_masks(_free(mask), seed=SEED + 1 + t)]) for t, mask in enumerate(masks)]
    deeper = [
        F.struct(F.lit(100 * (t + 1) + k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, deep in again
        for k, m in enumerate(deep)
    ]
    n = len(deeper) // len(masks)
    choose = F.coalesce(*[F.when(F.col("t") == t, F.array(*deeper[t * n : t * n + n])) for t in range(len(masks))])
    second = large.select("fp", F.explode(choose).alias("b")).select("b.t", "b.key", "fp")
    small, large = _sized(second, bucket)
    found = found.unionByName(_pairs(small))
    if large.isEmpty():
        return found
    flips = [
        (100 * (t + 1) + k, _signed(x))
        for t, deep in again
        for k, m in enumerate(deep)
        for x in _ball(_free(m))
    ]
    ball = F.broadcast(rows.sparkSession.createDataFrame(flips, "t int, flip bigint"))  # of a fixed size: one ball for each mask
    probes = large.join(ball, "t").select(F.col("fp").alias("u"), F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    return found.unionByName(probes.where("u < v").distinct().join(rows.withColumnRenamed("fp", "v"), "v", "left_semi").select("u", "v"))


def _ball(free: list[int]) -> list[int]:
    return [sum(1 << p for p in c) for r in range(1, RADIUS + 1) for c in combinations(free, r)]


def rooted_prints(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and fp with root (one fp of its component), both cut."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.select("fp").distinct())
    roots = components(near_pairs(distinct))
    return prints, cut(distinct.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is
    a row as any other but never names a component, unless the component has only such rows (null).
    Repeated rows are all returned. Other columns of ``docs`` are ignored.
    """
    prints, rooted = rooted_prints(docs)
    least = rooted.join(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    named = rooted.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_fingerprint_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component that with the smallest doc_id (null last)."""
    return keep_first(docs, *rooted_prints(docs))


#: Name of earlier versions.
drop_near_copies = drop_fingerprint_copies


def keep_first(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those of ``prints`` (doc_id, print, fp) that aren't the first of their root in ``rooted`` (fp, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    first = prints.groupBy("fp").agg(F.min(order).alias("first")).join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    stays = rooted.join(first, "root").select("fp", F.col("first.doc_id").alias("stay_id"), F.col("first.print").alias("stay_print"))
    kept = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("print") == F.col("stay_print"))
    decided = prints.join(stays, "fp").select("doc_id", "print", kept.alias("kept"))
    again = decided.where("kept").groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("kept"))
    return keep_rows(docs, decided.unionByName(again.where("n > 1").drop("n")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
