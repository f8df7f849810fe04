"""Documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from MinHash: of BANDS bands of ROWS minima each, a pair of similarity s shares
none with probability (1 - s^ROWS)^BANDS, 5e-8 at 0.8 and less above it. Each candidate is decided
by the exact similarity of its sets, in whole numbers. Equal sets are collapsed before the search.

A bucket is first held against one of its sets only, so a large group of near copies costs a row for each of them. Sets of
buckets that this leaves in several components are then joined by prefixes: in the order of their frequency, rarest first, two
sets of that similarity share a shingle among the first ninth of the smaller and the first fifth of the larger, at places that leave enough
to share. So sets that have frequent passages in common, but too little else, don't meet; pairs within one component
can't change the result and aren't formed. The prefixes are exact, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import MAX_BROADCAST_KEYS, cut, in_slices, split_by_filter, text_print
from sievecraft.llm.components import components
from sievecraft.llm.simhash import keep_first, rooted_prints

SHINGLE = 5
BANDS = 32
ROWS = 4
SEED = 42
#: Shingles whose minima are taken at once: bounds the memory for very long texts.
BLOCK = 1 << 11

_random = np.random.default_rng(SEED)
_WORD = _random.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _random.integers(0, 2**63, BANDS * ROWS, np.uint64)
_TIMES = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; a shorter text is one run, one without words none. Words as in simhash."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        of = np.concatenate([of, np.zeros(SHINGLE - len(words), np.uint64)])
    n = len(of) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h += of[k : k + n] * _WORD[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), t) for t, b in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        sets = [shingles(x or b"") for x in batch.column(2).to_pylist()]
        keys = [bands(s).view(np.int64) if len(s) else [] for s in sets]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        sizes = pa.array([len(s) for s in sets], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), sizes, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "print", "fp", "n", "keys"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        sets = [shingles(x or b"").view(np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "hashes"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of similarity 0.8 at least: 10 i >= 8 (a + b - i)."""
    u = sets.select(F.col("fp").alias("u"), F.col("hashes").alias("hu"))
    v = sets.select(F.col("fp").alias("v"), F.col("hashes").alias("hv"))
    both = F.size(F.array_intersect("hu", "hv"))
    return pairs.join(v, "v").join(u, "u").where(9 * both >= 4 * (F.size("hu") + F.size("hv"))).select("u", "v")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sets are in different components of ``roots`` (vertex, root)."""
    of = lambda c: roots.select(F.col("vertex").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def _sized(a: str, b: str):
    """Sets whose sizes allow 0.8."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


#: Counters by which shingles are ordered, of 8 bytes each. A count is of all shingles of a counter, so never too small; whatever it is, the order is one for all sets, which is all that exactness asks.
COUNTERS = 1 << 20


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets (fp, c, hashes) of different components c that may have a similarity of 0.8: every such pair, and few others."""
    return joined_prefixes(prefixes(sets))


def prefixes(sets: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Postings (h, fp, c, n, short, i) of the first fifth of each set in the order of frequency: i is the place, short the end of the first ninth.

    Shingles are counted in a table of ``counters``, which every task has, and each set is ordered where it lies: no row is made for a shingle but those of the prefix that another set may have.
    """
    spark = sets.sparkSession
    counted = sets.select(F.explode("hashes").alias("h")).groupBy(F.pmod("h", F.lit(counters)).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("df"))
    many = counted.where("df > 1").toArrow()  # a row for each counter at most
    df = np.ones(counters, np.int64)
    df[many.column("at").to_numpy()] = many.column("df").to_numpy()
    table = spark.sparkContext.broadcast(df)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sizes, ends, places, found = [], [], [], []
            for h in batch.column(2).to_pylist():
                h, n = np.array(h, np.int64), len(h)
                often = table.value[h % counters]
                first = np.lexsort((h, often))[: n - -(-4 * n // 5) + 1]
                at = np.flatnonzero(often[first] > 1)  # a shingle that no other set has is the rarest
                sizes.append(n)
                ends.append(n - -(-8 * n // 9) + 1)
                places.append(at)
                found.append(h[first[at]])
            lists = [pa.array(places, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(ends, pa.int32()), *lists], ["fp", "c", "n", "short", "i", "h"])

    kind = {x: sets.schema[x].dataType.simpleString() for x in ("fp", "c")}
    first = sets.select("fp", "c", "hashes").mapInArrow(ordered, f"fp {kind['fp']}, c {kind['c']}, n int, short int, i array<bigint>, h array<bigint>")
    return first.select("fp", "c", "n", "short", F.inline(F.arrays_zip("i", "h")))


def prefix_stars(first: DataFrame) -> DataFrame:
    """Pairs (u, v) of each posting with one of its shingle, drawn by a hash of both: a row for each posting at most, so a large group of copies is linked without meeting as pairs."""
    one = first.groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "fp").alias("r"), "fp", "n", "i", "c")).alias("o"))
    sized = 5 * F.least("n", "o.n") >= 4 * F.greatest("n", "o.n")
    met = first.join(one, "h").where((F.col("c") != F.col("o.c")) & sized)
    return met.select(F.least("fp", "o.fp").alias("u"), F.greatest("fp", "o.fp").alias("v")).distinct()


def joined_prefixes(first: DataFrame) -> DataFrame:
    """Pairs (u, v) of postings of one shingle, of different components."""
    a = first.where("i < short").select("h", F.col("fp").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
    b = first.select("h", F.col("fp").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    enough = (9 * left >= 4 * (F.col("na") + F.col("nb"))) & (5 * F.col("na") >= 4 * F.col("nb"))
    met = a.join(b, "h").where((F.col("ca") != F.col("cb")) & smaller & enough)
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def similar_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, print and fp (of the set) of each row with words; and fp with root (one fp of its component)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_print().alias("print"), F.col("text").cast("binary").alias("text"))
    sketches = cut(rows.mapInArrow(_sketched, f"doc_id {kind}, print bigint, fp bigint, n int, keys array<bigint>").where("n > 0"))
    buckets = sketches.dropDuplicates(["fp"]).select("fp", "n", F.explode("keys").alias("key")).repartition("key")  # one shuffle for sizes and join
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("fp", "n")).alias("first")).where("size > 1")
    members = cut(buckets.join(sizes, "key").select("key", "fp", "n", F.col("first.fp").alias("u"), F.col("first.n").alias("m")))

    asked = members.select("fp").distinct()
    texts = sketches.select("doc_id", "print", "fp").join(asked, "fp").groupBy("fp").agg(F.min(F.struct("print", "doc_id")).alias("k"))
    texts = cut(texts.select("fp", F.col("k.print").alias("k_print"), F.col("k.doc_id").alias("k_id")))
    n = texts.count()
    near = docs.select("doc_id", "text") if n <= MAX_BROADCAST_KEYS else split_by_filter(docs.select("doc_id", "text"), texts, n)[0]
    of = near.select("doc_id", text_print().alias("print"), F.col("text").cast("binary").alias("text")).join(F.broadcast(texts) if n <= MAX_BROADCAST_KEYS else texts, (F.col("print") == F.col("k_print")) & F.col("doc_id").eqNullSafe(F.col("k_id"))).select("fp", "text")
    sets = cut(of.mapInArrow(_listed, "fp bigint, hashes array<bigint>").dropDuplicates(["fp"]))

    candidates = members.where("fp <> u").where(_sized("n", "m")).groupBy("u", F.col("fp").alias("v")).agg(F.count(F.lit(1)).alias("bands"))
    candidates = cut(candidates)
    # first each set with the one it shares most buckets with, then only what this leaves in different components: copies of one text meet once each, not once a band
    likeliest = candidates.groupBy("v").agg(F.max(F.struct("bands", "u")).alias("b")).select("b.u", "v")
    first = cut(_similar(likeliest, sets))
    roots = components(first)
    rest = cut(_similar(_apart(candidates.select("u", "v"), roots), sets))
    if not rest.isEmpty():
        first = cut(first.unionByName(rest))
        roots = components(first)
    named = members.join(roots, F.col("fp") == F.col("vertex"), "left").select("key", "fp", F.coalesce("root", "fp").alias("c"))
    inside = named.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("key")
    open_ = cut(named.join(inside, "key").select("fp", "c").distinct())
    if not open_.isEmpty():
        postings = cut(prefixes(sets.join(open_, "fp")))
        stars = cut(_similar(prefix_stars(postings), sets))
        if not stars.isEmpty():
            first = cut(first.unionByName(stars))
            roots = components(first)
            of = roots.select(F.col("vertex").alias("fp"), F.col("root").alias("now"))
            postings = cut(postings.join(of, "fp", "left").withColumn("c", F.coalesce("now", "fp")).drop("now"))
        second = cut(_similar(joined_prefixes(postings), sets))
        if not second.isEmpty():
            roots = components(first.unionByName(second))

    prints = sketches.select("doc_id", "print", "fp")
    return prints, cut(prints.select("fp").distinct().join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", F.coalesce("root", "fp").alias("root")))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component that with the smallest doc_id (null last). Rows without words stay."""
    return keep_first(docs, *similar_roots(docs))


def joined_roots(rooted: DataFrame, prints: DataFrame, sets: DataFrame, set_roots: DataFrame) -> DataFrame:
    """fp and root over both relations: components of fingerprints (rooted: fp, root; prints: doc_id, print, fp) that a component of word sets spans are one.

    Only components that are spanned become edges, each to the smallest of its span.
    """
    key = lambda p: [F.col("doc_id").alias(f"{p}_id"), F.col("print").alias(f"{p}_print")]
    a = prints.join(rooted, "fp").select(*key("a"), F.col("root").alias("a")).distinct()
    b = sets.join(set_roots, "fp").select(*key("b"), F.col("root").alias("b")).distinct()
    both = cut(a.join(b, (F.col("a_print") == F.col("b_print")) & F.col("a_id").eqNullSafe(F.col("b_id"))).select("a", "b").distinct())
    spans = both.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least < most")
    edges = both.join(spans, "b").where("a <> least").select(F.col("a").alias("u"), F.col("least").alias("v"))
    joined = components(edges).withColumnRenamed("root", "joined")
    return cut(rooted.join(joined, F.col("root") == F.col("vertex"), "left").select("fp", F.coalesce("joined", "root").alias("root")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of near copies, that with the smallest doc_id (null last).

    Links are SimHash fingerprints within their radius and, since that misses most copies with a few changed words, sets of five-word
    shingles of similarity 0.8 or more. Null and empty texts are copies of each other. Of repeated rows one stays; other columns, whatever their names, are kept.
    """
    prints, rooted = rooted_prints(docs)
    return keep_first(docs, prints, joined_roots(rooted, prints, *similar_roots(docs)))
