"""Removal of long byte strings that occur again anywhere in the corpus, by longest-previous-factor arrays.

A suffix array of a whole corpus doesn't fit one machine, so the corpus is first narrowed to the places where a
match is possible, without losing any:

1. Every string of ``least`` bytes holds WINDOW grams of ``least - WINDOW + 1`` bytes; that with the smallest hash is its
   anchor. Equal strings have equal anchors at equal offsets. The strings of one anchor place are a short context.
2. Anchors that occur once can't belong to a repeated string, and their places are dropped. Contexts that have one hash
   stand for each other: of each the bytes of its first place are read, and of its last where there is another.
3. The differing contexts of each anchor are brought together (equal bytes once, since a copy's longest earlier match is the first of them), and a longest-previous-factor array over them, from the previous and
   next smaller places in suffix order, tells which of their strings occur earlier (or, with the next factors, at all).
   What it finds in the last copy of a context holds for all of its copies.
   The differing contexts of an anchor with over GROUP of them aren't gathered: each is held against its own copy only, and their
   strings are matched by hash, in all tasks.

Hashes are sums of random 64-bit values over powers modulo 2^64; contexts are compared by anchor and own hash (128 bits).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import Scratch, cut, split_by_filter, table, text_print
from sievecraft.llm.factors import repeats

LEAST = 200
#: Grams in a string of LEAST bytes.
WINDOW = 150
#: Strings of a text that are hashed at once.
BLOCK = 1 << 18
LOW = (1 << 20) - 1
#: Differing contexts of an anchor that one task compares.
GROUP = 2000
#: Contexts with over this share of all places, at most as many as its inverse, are broadcast instead of shuffled.
HOT_SHARE = 1 / 2000
#: Kinds of context places whose bytes are read: the only one, the first and the last of several, a first one that only its last is held against, one whose
#: strings are hashed. Contexts of a hot anchor share strings, but stand in arrays in no order; so of them only last copies, which are repeated whole, are told.
ONLY, FIRST, LAST, MET, HASHED = 0, 1, 2, 3, 4
#: Bytes of contexts in one array.
ARRAY = 1 << 18
#: Keys of documents that are broadcast to filter texts before a shuffle (about 24 bytes each).
MAX_KEYS = 400_000
PLACES = "doc_id {kind}, print bigint, anchor bigint, context bigint, lo int, hi int"


_MADE: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers and their inverses, made once in each task."""
    if not _MADE:
        _MADE.append(_new_tables())
    return _MADE[0]


_tables.cache_clear = _MADE.clear


def _new_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    values = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    n = BLOCK + 2 * LEAST + 2
    base = 0x9E3779B97F4A7C15
    power, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return values, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xCA9B0C7EBA1DA115)
    return x ^ (x >> np.uint64(32))


def _sums(part: np.ndarray) -> np.ndarray:
    values, power, _ = _tables()
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(values[part] * power[: len(part)], out=sums[1:])
    return sums


def places(text: bytes, least: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """anchor, context, lo, hi: the strings that start from lo to hi have one anchor place. In blocks of a bounded size."""
    _, _, inverse = _tables()
    gram = least - window + 1
    data = np.frombuffer(text, np.uint8)
    for begin in range(0, len(data) - least + 1, BLOCK):
        part = data[begin : begin + BLOCK + least - 1]
        sums = _sums(part)
        n = len(part) - gram + 1
        hashes = _mix((sums[gram:] - sums[:-gram]) * inverse[:n])
        least_of = (hashes & np.uint64(~LOW & (1 << 64) - 1)) | np.arange(n, dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            least_of = np.minimum(least_of[:-size], least_of[size:])
            size *= 2
        if size < window:
            least_of = np.minimum(least_of[: len(least_of) - (window - size)], least_of[window - size :])
        anchor = (least_of & np.uint64(LOW)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        hi = np.concatenate([lo[1:] - 1, [len(anchor) - 1]])
        at = anchor[lo]
        whole = (sums[hi + least] - sums[lo]) * inverse[lo]
        shape = ((hi - lo) * 4096 + (at - lo)).astype(np.uint64)
        context = _mix(whole + _mix(shape + np.uint64(77)))
        yield hashes[at].view(np.int64), context.view(np.int64), (lo + begin).astype(np.int32), (hi + begin).astype(np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_print().alias("print"), F.col("text").cast("string").cast("binary").alias("text"))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def anchor_places(docs: DataFrame, least: int, window: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "print", "anchor", "context", "lo", "hi"]
        for batch in batches:
            rows, columns, size = [], [], 0
            for k, text in enumerate(batch.column(2)):
                for found in places(text.as_py() or b"", least, window):
                    columns.append(found)
                    rows.append(np.full(len(found[0]), k))
                    size += len(found[0])
                    if size > 100_000 or (k == batch.num_rows - 1 and columns):
                        yield _batch(batch, rows, columns, names)
                        rows, columns, size = [], [], 0
            if columns:
                yield _batch(batch, rows, columns, names)

    return _keyed(docs).mapInArrow(made, PLACES.format(kind=_kind(docs)))


def _batch(batch: pa.RecordBatch, rows: list, columns: list, names: list[str]) -> pa.RecordBatch:
    at = pa.array(np.concatenate(rows))
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]], names)


def _same_key(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.print") == F.col(f"{b}.print"))


def _with_lists(docs: DataFrame, rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Texts with the list of structs ``found`` of their key in ``rows``. Nearly all texts without any are left out before the shuffle, by their ``n`` ``keys``."""
    own = docs.select("doc_id", "text")
    named = keys.select(F.col("doc_id").alias("k_id"), F.col("print").alias("k_print"))
    if n > MAX_KEYS:
        own = _keyed(split_by_filter(own, named, n)[0])
    else:
        own = _keyed(own).alias("a").join(F.broadcast(keys).alias("b"), _same_key("a", "b"), "left_semi")
    lists = rows.groupBy("doc_id", "print").agg(F.collect_list("found").alias("found"))
    return own.alias("a").join(lists.alias("b"), _same_key("a", "b")).select("a.doc_id", "a.print", "text", "found")


def _edge_rows(docs: DataFrame, edges: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """For each place in ``edges`` its bytes (part), or for a HASHED one a row for each of its strings (hash, lo)."""
    fields = [("group", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("kind", pa.int32()), ("once", pa.bool_()), ("part", pa.binary()), ("hash", pa.int64())]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, inverse = _tables()
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                for e in batch.column(3)[k].as_py():
                    part = text[e["lo"] : e["hi"] + least]
                    own = (k, e["group"], e["anchor"], e["context"])
                    if e["kind"] == HASHED:
                        sums = _sums(np.frombuffer(part, np.uint8))
                        n = len(part) - least + 1
                        hashes = _mix((sums[least:] - sums[:-least]) * inverse[:n]).view(np.int64).tolist()
                        rows += [(*own, e["lo"] + i, HASHED, e["once"], None, h) for i, h in enumerate(hashes)]
                    else:
                        rows.append((*own, e["lo"], e["kind"], e["once"], part, None))
                if len(rows) > 20_000 or (k == batch.num_rows - 1 and rows):
                    at, *columns = zip(*rows, strict=True)
                    at = pa.array(at)
                    arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *arrays], ["doc_id", "print", *[n for n, _ in fields]])
                    rows = []

    found = edges.withColumn("found", F.struct("group", "anchor", "context", "lo", "hi", "kind", "once"))
    keys = cut(edges.select("doc_id", "print").distinct())
    texts = _with_lists(docs, found, keys, keys.count())
    kinds = "group bigint, anchor bigint, context bigint, lo int, kind int, once boolean, part binary, hash bigint"
    return scratch.store(texts.mapInArrow(made, f"doc_id {_kind(docs)}, print bigint, {kinds}"))


def _compared(parts: DataFrame, least: int, first_stays: bool, kind: str) -> DataFrame:
    """Spans (doc_id, print, anchor, context, kind, lo, begin, end) of the strings in each part that the factor arrays of its group find repeated."""

    def compare(rows: list[tuple]) -> list[tuple]:
        # equal parts of a group stand in the array once: the longest earlier match of a later one is the first, and goes on to its end
        first: dict[tuple, int] = {}
        copies: Counter[tuple] = Counter()
        differing: Counter = Counter()
        for k, row in enumerate(rows):
            part = row[0], row[-1]
            copies[part] += 1
            if first.setdefault(part, k) == k:
                differing[row[0]] += 1
        several = {part: i for i, part in enumerate(part for part in first if differing[part[0]] > 1)}
        starts, previous, other = repeats([part for _, part in several], least)
        flagged = previous if first_stays else other
        out: list[tuple] = []
        for k, (group, doc_id, print_, lo, place, anchor, context, part) in enumerate(rows):
            if place == MET:
                continue
            key = group, part
            if (first[key] < k) if first_stays else copies[key] > 1:
                out.append((doc_id, print_, anchor, context, place, lo, lo, lo + len(part)))
            elif key in several:
                start = starts[several[key]]
                inside = np.concatenate([[0], flagged[start : start + len(part)].astype(np.int8), [0]])
                edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
                out += [(doc_id, print_, anchor, context, place, lo, lo + a, lo + b - 1 + least) for a, b in edges.tolist()]
        return out

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, schema = 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in compare(held)], schema)

        for batch in batches:
            fields = [("anchor", pa.int64()), ("context", pa.int64()), ("kind", pa.int32()), ("lo", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("print", pa.int64()), *fields])
            for row in zip(*(batch[c].to_pylist() for c in ("group", "doc_id", "print", "lo", "kind", "anchor", "context", "part")), strict=True):
                if held and row[0] != held[-1][0] and size > ARRAY:
                    yield done()
                    held, size = [], 0
                if not held or row[:5] != held[-1][:5]:  # a repeated row has its places once
                    held.append(row)
                    size += len(row[-1])
        if held:
            yield done()

    together = parts.repartition(F.col("group")).sortWithinPartitions("group", F.col("doc_id").asc_nulls_last(), "print", "lo", "kind")
    return together.mapInArrow(made, f"doc_id {kind}, print bigint, anchor bigint, context bigint, kind int, lo int, begin int, end int")


def _counted(strings: DataFrame, least: int, first_stays: bool) -> DataFrame:
    """Spans of the strings of hot anchors that occur in several contexts, by counts of their hashes."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "lo")
    strings = strings.select("doc_id", "print", "lo", "once", "anchor", "hash").distinct()
    counts = strings.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first")).where("n > 1")
    met = strings.join(counts, ["anchor", "hash"]).where((own != F.col("first")) if first_stays else F.col("once"))
    return met.select("doc_id", "print", F.col("lo").alias("begin"), (F.col("lo") + least).alias("end"))


def repeated_spans(docs: DataFrame, least: int = LEAST, window: int = WINDOW, first_stays: bool = False, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """Spans of bytes (doc_id, print, begin, end; they may overlap) covered by strings of ``least`` bytes that also start elsewhere.

    With ``first_stays`` only strings with an earlier start count, in the order of (doc_id, print, place), so the first copy stays.
    The tables that it stores are in ``scratch``, to be dropped when the spans have been used.
    """
    kind = _kind(docs)
    scratch = scratch or Scratch(docs.sparkSession, "spans")
    found = anchor_places(docs, least, window)
    # stored, so that the join has an exchange of its own, of which Spark can split the partition of a hot anchor
    again = scratch.store(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    found = scratch.store(found.join(again, "anchor", "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "lo", "hi")
    contexts = scratch.store(found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last")))
    sizes = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("differing"), F.min("n").alias("fewest"))
    told = contexts.join(sizes, "anchor").withColumn("hot", F.col("differing") > group).withColumn("once", F.col("n") == 1)

    def taken(at: str, kind_: int, where: Column) -> DataFrame:
        return told.where(where).select(f"{at}.doc_id", f"{at}.print", "anchor", "context", f"{at}.lo", f"{at}.hi", F.lit(kind_).alias("kind"), "once", "hot")

    several = ~F.col("once")
    differing = (F.col("differing") > 1) & (F.lit(first_stays) | (F.col("fewest") == 1))
    edges = taken("first", ONLY, F.col("once") & differing & ~F.col("hot")).unionByName(taken("first", FIRST, several & ~F.col("hot")))
    edges = edges.unionByName(taken("first", MET, several & F.col("hot"))).unionByName(taken("last", LAST, several))
    edges = edges.unionByName(taken("first", HASHED, differing & F.col("hot")))
    # the contexts of a hot anchor are groups of their own
    edges = edges.withColumn("group", F.when(F.col("hot") & (F.col("kind") != HASHED), F.xxhash64("anchor", "context")).otherwise(F.col("anchor")))
    rows = _edge_rows(docs, edges.drop("hot"), least, scratch)
    compared = scratch.store(_compared(rows.where("part is not null"), least, first_stays, kind))
    own = compared.where(F.col("kind").isin(ONLY, FIRST) if first_stays else F.col("kind") == ONLY).select("doc_id", "print", "begin", "end")
    copies = _copies(found, contexts, compared.where(F.col("kind") == LAST), place, first_stays, scratch)
    return own.unionByName(copies).unionByName(_counted(rows.where("part is null"), least, first_stays))


def _copies(found: DataFrame, contexts: DataFrame, last: DataFrame, place: Column, first_stays: bool, scratch: Scratch) -> DataFrame:
    """What the arrays found in the last copy of each context, for all places of it (but the first, with ``first_stays``).

    The few contexts of which very many copies exist are broadcast, so that their places aren't shuffled into one task.
    """
    within = last.select("anchor", "context", (F.col("begin") - F.col("lo")).alias("a"), (F.col("end") - F.col("lo")).alias("b"))
    ranges = scratch.store(contexts.where("n > 1").select("anchor", "context", "n", "first").join(within, ["anchor", "context"]))
    least = found.count() * HOT_SHARE
    hot, rest = F.broadcast(ranges.where(F.col("n") > least)), ranges.where(F.col("n") <= least)
    known = F.broadcast(cut(ranges.where(F.col("n") > least).select("anchor", "context").distinct()))
    key = ["anchor", "context"]
    met = found.join(hot, key).unionByName(found.join(known, key, "left_anti").join(rest, key))
    if first_stays:
        met = met.where(place != F.col("first"))
    return met.select("doc_id", "print", (F.col("lo") + F.col("a")).alias("begin"), (F.col("lo") + F.col("b")).alias("end"))


def without_repeats(docs: DataFrame, least: int = LEAST, first_stays: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, concatenated) of each row.

    Null text is empty; shorter texts than ``least`` stay whole. Of rows repeated with one doc_id and text all have the same result
    (with ``first_stays`` they count as copies of each other and the first row can't be told, so the first stays in all).
    A very long text is hashed in blocks; other columns are ignored. The tables between are dropped once the spans are known.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    spans = cut(repeated_spans(docs, least, first_stays=first_stays, scratch=scratch).distinct())
    scratch.drop()
    keys = cut(spans.select("doc_id", "print").distinct())
    n = keys.count()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                text, kept, at, runs = text.as_py() or b"", [], 0, 0
                runs_end = -1
                for begin, end in sorted((x["begin"], x["end"]) for x in found.as_py()):
                    if begin > runs_end:
                        runs += 1
                        kept.append(text[at:begin])
                    runs_end = at = max(at, end)
                rest = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(rest), runs, rest))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    listed = spans.withColumn("found", F.struct("begin", "end"))
    touched = _with_lists(docs, listed, keys, n).mapInArrow(remove, f"doc_id {_kind(docs)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    rest = _untouched(docs, keys, n)
    zero = F.lit(0).cast("long")
    text = F.coalesce("text", F.lit(b""))
    untouched = rest.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), text.alias("kept"))
    return touched.unionByName(untouched)


def _untouched(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The texts of no key. Where the keys are many, only texts that a filter of them lets pass are shuffled."""
    if n <= MAX_KEYS:
        return _keyed(docs).alias("a").join(F.broadcast(keys).alias("b"), _same_key("a", "b"), "left_anti")
    named = keys.select(F.col("doc_id").alias("k_id"), F.col("print").alias("k_print"))
    maybe, rest = split_by_filter(docs.select("doc_id", "text"), named, n)
    return _keyed(maybe).alias("a").join(keys.alias("b"), _same_key("a", "b"), "left_anti").unionByName(_keyed(rest))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = without_repeats(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
