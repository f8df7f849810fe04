"""Removal of runs of words that already stand in a document of a smaller id, by suffix trees split by prefixes.

The suffix tree of a corpus doesn't fit one machine, so it is split where its top branches: suffixes that begin with one prefix are a
subtree of their own, and a prefix is made longer until its subtree has at most LEAVES suffixes. Suffixes are cut at ``least`` words;
an internal node of that depth is a repeat, and its leaves in documents after the smallest are copies. A prefix of ``least``
words with more leaves than that is such a node already, and needs no tree: its smallest document is a minimum, combined map-side.

Before that the suffixes are narrowed without losing a repeat. Every window of ``least`` words has an anchor, its gram of GRAM words
with the smallest hash; equal windows have equal anchors at equal offsets. Windows in a row with one anchor place are a context.

1. Anchors of one document hold no repeat and are dropped.
2. Contexts that are equal stand for each other: in all documents after their smallest they are repeated whole, and only the smallest document's is looked at.
3. Suffixes of contexts whose anchor has contexts of other smallest documents go into the subtrees.

Words are compared by 64-bit hashes, contexts by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import PIECE, Scratch, cut, table, text_print, word_lists
from sievecraft.llm.repeated_spans import _kind, _mix, _untouched, _with_lists

LEAST, GRAM = 13, 5
#: Suffixes of a subtree.
LEAVES = 2000
#: Words of a long text whose anchors are found at once (of short texts some 4 BLOCK bytes), and suffixes that a task sorts at once (beyond them only the subtree that it is in).
BLOCK, TOGETHER = 1 << 16, 20_000
#: Bits of a bitmap (fixed by bitmap_construct_agg), bitmaps of the largest filter (64 MB as such), and bits for each key.
BITMAP, MAX_BITMAPS, FILTER_BITS = 32768, 16384, 8
LOW = (1 << 20) - 1
#: White space as blanks, other bytes of UTF-8 as themselves.
WORD_BYTES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: A place that is repeated whole; others have a bit for each repeated window.
WHOLE = -1


class Hasher:
    """Hashes of words: sums of random values of their bytes over powers, modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.values = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            power, inverse = np.full(n, self.BASE, np.uint64), np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
            power[0] = inverse[0] = 1
            self.power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Hashes of the words of each of some short texts, which are hashed as one array."""
        data = np.frombuffer(b" ".join(texts).translate(WORD_BYTES), np.uint8)
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=sums[1:])
        edges = np.flatnonzero(np.diff((data != 32).astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        hashes = _mix((sums[ends] - sums[starts]) * self.inverse[starts])
        places = np.cumsum([len(t) + 1 for t in texts])
        return np.split(hashes, np.searchsorted(starts, places[:-1]))

    def words(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text, some PIECE bytes at a time; a word is never cut."""
        return np.concatenate(self.of([text]) if len(text) <= PIECE else [self.of([b" ".join(words)])[0] for words in word_lists(text.translate(WORD_BYTES))])


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    sums = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k, factor in enumerate(_factors(n)):
        sums += ids[k : k + len(sums)] * factor
    return _mix(sums)


def _rolled_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at some places."""
    sums = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(_factors(n)):
        sums += ids[at + k] * factor
    return _mix(sums)


def places(parts: list[tuple[int, int, np.ndarray]], least: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, anchor, context, lo, hi: the windows of a row that start from lo to hi have one anchor place.

    A part (row, place of its first word, hashes) is a text or a stretch of one, which shares ``least`` - 1 words with the next; all are hashed as one array.
    """
    size = least - gram + 1
    ids = np.concatenate([x for _, _, x in parts])
    ends = np.cumsum([len(x) for _, _, x in parts])
    of = np.repeat(np.arange(len(parts)), [len(x) for _, _, x in parts])
    # no window reaches into the next part
    begins = np.flatnonzero(ends[of] - np.arange(len(ids)) >= least)
    if not len(begins):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = _rolled(ids, gram)
    keyed = (grams & np.uint64(~LOW & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64)
    smallest = keyed[: len(keyed) - size + 1].copy()
    for k in range(1, size):
        np.minimum(smallest, keyed[k : k + len(smallest)], out=smallest)
    anchor = (smallest[begins] & np.uint64(LOW)).astype(np.int64)
    changes = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(begins) != 1)) + 1
    lo, hi = begins[np.concatenate([[0], changes])], begins[np.concatenate([changes - 1, [len(begins) - 1]])]
    at = anchor[np.concatenate([[0], changes])]
    # the first and the last window overlap, so with the offset of the last they tell all words between
    shape = ((hi - lo) * 4096 + (at - lo)).astype(np.uint64)
    context = _mix(_rolled_at(ids, lo, least) + _mix(_rolled_at(ids, hi, least) + shape))
    part = of[lo]
    rows, first = np.array([r for r, _, _ in parts]), np.array([f for _, f, _ in parts])
    base = first[part] - (ends - [len(x) for _, _, x in parts])[part]
    return rows[part], grams[at].view(np.int64), context.view(np.int64), lo + base, hi + base


def anchor_places(docs: DataFrame, least: int, gram: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts: list[tuple[int, int, np.ndarray]] = []
            short: list[tuple[int, bytes]] = []
            size = 0

            def done() -> pa.RecordBatch:
                if short:
                    parts.extend((k, 0, ids) for (k, _), ids in zip(short, hasher.of([x for _, x in short]), strict=True))
                row, anchor, context, lo, hi = places(parts, least, gram)
                at = pa.array(row)
                found = [pa.array(anchor), pa.array(context), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *found], ["doc_id", "print", "anchor", "context", "lo", "hi"])

            for k, text in enumerate(batch.column(2)):
                text = text.as_py() or b""
                if len(text) <= BLOCK:
                    short.append((k, text))
                    size += len(text)
                else:
                    ids = hasher.words(text)
                    for begin in range(0, len(ids) - least + 1, BLOCK):
                        parts.append((k, begin, ids[begin : begin + BLOCK + least - 1]))
                        size += len(parts[-1][2])
                        if size > BLOCK:
                            yield done()
                            parts, short, size = [], [], 0
                if size > 4 * BLOCK:
                    yield done()
                    parts, short, size = [], [], 0
            if parts or short:
                yield done()

    texts = docs.select("doc_id", text_print().alias("print"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(made, f"doc_id {_kind(docs)}, print bigint, anchor bigint, context bigint, lo int, hi int")


def _perhaps(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose anchor may be among the ``n`` of ``keys``: all that are, and few others as long as the keys fit a broadcast filter of 64 MB."""
    bitmaps = max(1, min(MAX_BITMAPS, -(-n * FILTER_BITS // BITMAP)))
    place = lambda k: F.pmod(F.xxhash64("anchor", F.lit(k)), F.lit(BITMAP)).cast("int")
    of = F.pmod(F.xxhash64("anchor"), F.lit(bitmaps))
    set_ = keys.select(of.alias("of"), F.explode(F.array(place(1), place(2))).alias("place")).groupBy("of").agg(F.bitmap_construct_agg("place").alias("bits"))
    number = lambda i: F.conv(F.hex(F.substring("bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    filter_ = cut(set_.select("of", F.transform(F.sequence(F.lit(0), F.lit(BITMAP // 32 - 1)), number).alias("numbers")))

    def is_set(p: Column) -> Column:
        # in a number of four bytes the first has the lowest places
        return F.getbit(F.element_at("numbers", F.shiftright(p, 5) + 1), (3 - F.shiftright(p, 3) % 4) * 8 + p % 8) == 1

    met = rows.withColumn("of", of).join(F.broadcast(filter_), "of")
    return met.where(is_set(place(1)) & is_set(place(2))).select(*rows.columns)


def _suffixes(docs: DataFrame, undecided: DataFrame, least: int) -> DataFrame:
    """(doc_id, anchor, context, window, words): the suffixes of the places of ``undecided``, each cut at ``least`` words; a word is 8 bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            held, size = [], 0

            def done() -> pa.RecordBatch:
                rows, anchor, context, window, words = (np.concatenate(x) for x in zip(*held, strict=True))
                ends = pa.py_buffer((np.arange(len(rows) + 1) * 8 * least).astype(np.int32).tobytes())
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(words.astype(">u8").tobytes())])
                columns = [batch.column(0).take(pa.array(rows)), pa.array(anchor), pa.array(context), pa.array(window.astype(np.int32)), binary]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "anchor", "context", "window", "words"])

            ends = batch.column(3).offsets.to_numpy()
            lo, hi, anchors, contexts = (batch.column(3).values.field(c).to_numpy() for c in ("lo", "hi", "anchor", "context"))
            for k in range(batch.num_rows):
                ids = np.lib.stride_tricks.sliding_window_view(hasher.words(batch.column(2)[k].as_py()), least)
                for begin in range(ends[k], ends[k + 1], 1000):
                    own = slice(begin, min(begin + 1000, ends[k + 1]))
                    sizes = hi[own] - lo[own] + 1
                    window = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    each = [np.repeat(x[own], sizes) for x in (anchors, contexts)]
                    held.append((np.full(len(window), k), *each, window, ids[np.repeat(lo[own], sizes) + window]))
                    size += len(window)
                    if size > TOGETHER:
                        yield done()
                        held, size = [], 0
            if held:
                yield done()

    rows = undecided.withColumn("found", F.struct("lo", "hi", "anchor", "context"))
    keys = cut(undecided.select("doc_id", "print").distinct())
    texts = _with_lists(docs, rows, keys, keys.count())
    return texts.mapInArrow(made, f"doc_id {_kind(docs)}, anchor bigint, context bigint, window int, words binary")


def internal_nodes(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, begin, end) of the internal nodes of the tree over sorted suffixes; ``common``: words that each shares with the one before it."""
    open_ = [(0, 0)]
    for k in range(1, len(common) + 1):
        depth, left = common[k] if k < len(common) else 0, k - 1
        while open_[-1][0] > depth:
            inner, left = open_.pop()
            yield inner, left, k
        if open_[-1][0] < depth:
            open_.append((depth, left))


def _copies_in(matrix: np.ndarray, ids: list, least: int) -> list[int]:
    """Places of the suffixes, sorted by their words, below whose deep node a smaller document stands."""
    common = np.zeros(len(matrix), np.int64)
    if len(matrix) > 1:
        same = matrix[1:] == matrix[:-1]
        common[1:] = np.where(same.all(axis=1), matrix.shape[1], same.argmin(axis=1))
    out: list[int] = []
    for depth, begin, end in internal_nodes(common.tolist()):
        if depth < least:
            continue
        smallest = min((i for i in ids[begin:end] if i is not None), default=None)
        if smallest is not None:
            out += [k for k in range(begin, end) if ids[k] is None or ids[k] > smallest]
    return out


def _repeated(suffixes: DataFrame, least: int, leaves: int, kind: str, scratch: Scratch) -> DataFrame:
    """(anchor, context, window) of the suffixes that also begin in a smaller document."""
    lengths = [n for n in (2, 6, 18) if n < least] + [least]
    prefix = lambda n: F.xxhash64(F.lit(n), F.substring("words", 1, 8 * n))
    parts, left = [], suffixes
    for n in lengths:
        full = left.groupBy(prefix(n).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaves).select("prefix")
        full = scratch.store(full)
        if full.isEmpty():
            parts.append(left.withColumn("group", prefix(n)))
            left = None
            break
        # a suffix whose prefix has few is done with; only the others meet the next, longer prefixes
        parts.append(left.join(full, prefix(n) == F.col("prefix"), "left_anti").withColumn("group", prefix(n)))
        left = scratch.store(left.join(full, prefix(n) == F.col("prefix"), "left_semi"))
    rows = reduce(DataFrame.unionByName, parts)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            groups = whole["group"].to_numpy()
            # the last subtree may go on in the next batch
            end = len(groups) if last else int(np.searchsorted(groups, groups[-1]))
            ready = whole.slice(0, end)
            held, size = (whole.slice(end).to_batches(), len(groups) - end)
            if end:
                matrix = np.frombuffer(b"".join(ready["words"].to_pylist()), ">u8").reshape(end, least)
                at = pa.array(_copies_in(matrix, ready["doc_id"].to_pylist(), least), pa.int64())
                yield from ready.select(["anchor", "context", "window"]).take(at).to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > TOGETHER:
                yield from done(False)
        if size:
            yield from done(True)

    together = rows.repartition("group").sortWithinPartitions("group", "words")
    found = together.mapInArrow(made, "anchor bigint, context bigint, window int")
    if left is None:
        return found
    first = scratch.store(left.groupBy("words").agg(F.min("doc_id").alias("first")))
    later = left.join(first, "words").where("first is not null and (doc_id is null or doc_id > first)")
    return found.unionByName(later.select("anchor", "context", "window"))


def repeated_places(docs: DataFrame, least: int = LEAST, gram: int = GRAM, leaves: int = LEAVES, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, print, lo, hi, windows): places whose windows, starting at words lo to hi, are all repeated (WHOLE) or those of the bits of ``windows``."""
    if not 0 <= least - gram < 62:
        raise ValueError("a window has at most 62 grams")
    scratch = scratch or Scratch(docs.sparkSession, "words")
    kind = _kind(docs)
    found = anchor_places(docs, least, gram)
    some = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.max(F.col("doc_id").isNull()).alias("none"))
    # stored, so that joins have exchanges of their own, of which Spark can split the partition of a hot key
    shared = scratch.store(some.where("a < z or (none and a is not null)").select("anchor"))
    # an inner join: a semi join would be moved below the filter
    found = scratch.store(_perhaps(found, shared, shared.count()).join(shared, "anchor"))
    doc = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "lo", "hi")
    contexts = scratch.store(found.groupBy("anchor", "context").agg(F.min(place).alias("first"), F.max(doc).alias("last")))
    own = F.struct("first.none", "first.doc_id")
    sizes = scratch.store(contexts.groupBy("anchor").agg(F.min(own).alias("a"), F.max(own).alias("z")).where("a != z").select("anchor"))
    undecided = contexts.join(sizes, "anchor", "left_semi").select("first.doc_id", "first.print", "anchor", "context", "first.lo", "first.hi")
    suffixes = scratch.store(_suffixes(docs, undecided, least))
    bits = _repeated(suffixes, least, leaves, kind, scratch).groupBy("anchor", "context").agg(F.bit_or(F.expr("shiftleft(1L, window)")).alias("bits"))
    told = contexts.join(bits, ["anchor", "context"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    several = ~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id"))
    told = scratch.store(told.where(several | (F.col("bits") != 0)).select("anchor", "context", F.col("first.doc_id").alias("first"), "bits"))
    at_first = F.col("doc_id").eqNullSafe(F.col("first"))
    met = found.join(told, ["anchor", "context"]).withColumn("windows", F.when(at_first, F.col("bits")).otherwise(WHOLE))
    return met.where("windows != 0").select("doc_id", "print", "lo", "hi", "windows")


def _without(text: bytes, lo: np.ndarray, hi: np.ndarray, bits: np.ndarray, least: int) -> tuple[int, int, bytes]:
    """Numbers of words and of removed words, and the rest. In ``lo``, ``hi`` and ``bits`` are the text's places."""
    starts = [(a, b) for a, b, w in zip(lo.tolist(), hi.tolist(), bits.tolist(), strict=True) if w == WHOLE]
    starts += [(a + i, a + i) for a, b, w in zip(lo.tolist(), hi.tolist(), bits.tolist(), strict=True) if w != WHOLE for i in range(b - a + 1) if w >> i & 1]
    runs: list[list[int]] = []
    for a, b in sorted(starts):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b + least, runs[-1][1])
        else:
            runs.append([a, b + least])
    kept: list[bytes] = []
    at = first = gone = 0
    for words in word_lists(text.translate(WORD_BYTES)):
        end, left = at + len(words), at
        while first < len(runs) and runs[first][0] < end:
            a, b = max(runs[first][0], at), min(runs[first][1], end)
            kept += words[left - at : a - at]
            gone, left = gone + b - a, b
            if runs[first][1] > end:
                break
            first += 1
        kept += words[left - at :]
        at = end
    return at, gone, b" ".join(kept)


def without_repeated_words(docs: DataFrame, least: int = LEAST, gram: int = GRAM, leaves: int = LEAVES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by one space) of each row.

    A word is removed if a window of ``least`` words that covers it also starts in a document with a smaller doc_id. Null and
    empty texts have no words; a text of fewer words than ``least`` stays whole. A null doc_id comes after all others, and rows that repeat a doc_id
    are no smaller than each other, so they don't remove each other's words. A very long text is hashed in pieces and blocks; other columns are ignored, whatever their names.
    An empty table gives no rows. The tables between are dropped once the places are known.
    """
    scratch = Scratch(docs.sparkSession, "words")
    found = cut(repeated_places(docs, least, gram, leaves, scratch))
    scratch.drop()
    keys = cut(found.select("doc_id", "print").distinct())
    n = keys.count()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size, first = 0, 0
            ends = batch.column(2).offsets.to_numpy()
            los, his, bits = (batch.column(2).values.field(c).to_numpy() for c in ("lo", "hi", "windows"))
            for k in range(batch.num_rows):
                own = slice(ends[k], ends[k + 1])
                out.append(_without(batch.column(1)[k].as_py() or b"", los[own], his[own], bits[own], least))
                size += len(out[-1][2])
                if size > 1 << 22 or k == batch.num_rows - 1:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k + 1 - first), *columns], ["doc_id", "n_words", "n_removed", "kept"])
                    out, size, first = [], 0, k + 1

    listed = found.withColumn("found", F.struct("lo", "hi", "windows"))
    touched = _with_lists(docs, listed, keys, n).select("doc_id", "text", "found")
    rest = _untouched(docs, keys, n).select("doc_id", "text", F.array().cast(touched.schema["found"].dataType).alias("found"))
    result = touched.unionByName(rest).mapInArrow(remove, f"doc_id {_kind(docs)}, n_words bigint, n_removed bigint, kept binary")
    return result.withColumn("kept", F.col("kept").cast("string"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = without_repeated_words(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT run, min(doc_id) AS first FROM g GROUP BY run),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM g JOIN f USING (run) WHERE doc_id > first),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) t
      WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = t.doc_id AND h.place = t.place) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
