"""Packing tokenised documents into sequences of a fixed length by minimum bin slack.

Which lengths share a sequence depends only on how many pieces of each length there are. So Spark counts the pieces
by length (at most ``capacity`` numbers, whatever the size of the corpus), the driver runs minimum bin slack
over these counts, and Spark gives every piece its place. For each sequence a subset-sum over bitsets
finds the fullest combination that holds the longest piece left; the combination is taken out as often as the
counts allow, so the plan has few distinct combinations. A piece finds its place from its rank among the pieces of
its length; ranks are made in salted groups whose offsets come from their counts, so a length that a third
of all pieces have is not ranked in one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.llm.common import cut, table

CAPACITY = 4096
END_ID = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Pieces of one length that are ranked in one group: a length of more is dealt over as many groups by hash.
GROUP = 50_000
#: Groups whose first ranks are broadcast, of about 24 bytes each; more are joined by a shuffle.
MOST_GROUPS = 1_000_000
#: Words whose ids a task remembers before it starts anew.
REMEMBER = 800_000
PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


#: How the tokenizer cuts a lower-cased text of Latin-1 characters, which composition leaves as they are, into words.
LETTER, NUMBER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\t-\r \u0085 {LETTER}{NUMBER}]+")


#: Characters by which the tokenizer's vocabulary has bytes: printable ones are themselves, the others follow from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memory(dict):
    """What ``make`` gives for a text, remembered for ``most`` texts."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        made = self[text] = self.make(text)
        return made


class _Ids:
    """Token ids of a text as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.chunks = _Memory(self.encode_word, REMEMBER), _Memory(self.encode, REMEMBER // 4)

    def encode(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_word(self, word: str) -> bytes:
        """Ids of a word of WORDS: nothing is left to normalise or to cut, so its bytes go to the merges at once."""
        return _packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LEVEL))])

    def of(self, text: str) -> bytes:
        """Ids of the whole text, by parts that the tokenizer encodes each for itself: its own words, or what stands between white
        space, which it drops and never joins across. A text that holds a special token's string is encoded as it stands."""
        if "<|" in text:
            return self.encode(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32. Null text is empty: its one id is END_ID."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for at, text in enumerate(batch.column(1)):
                data = memoryview(ids.of(text.as_py() or "") + end)
                for piece, begin in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[begin : begin + 4 * capacity]
                    rows.append((at, piece, begin // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut_up, PIECES.format(kind=kind))


@dataclass(frozen=True)
class Combination:
    """``times`` sequences, each with ``many[i]`` pieces of ``lengths[i]``; lengths fall."""

    lengths: tuple[int, ...]
    many: tuple[int, ...]
    times: int


def fullest(available: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """(length, number) of pieces that together fill ``room`` as far as possible.

    Bit s of a bitset tells that the pieces so far can have the sum s. Numbers are added in powers of two. Stops at a full room.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        if length > room:
            continue
        left, unit = min(available[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(unit, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & full
            left, unit = left - take, unit * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """Combinations that use up all pieces: ``counts`` of pieces by length (1 to capacity)."""
    available = {k: n for k, n in counts.items() if n}
    order = sorted(available, reverse=True)
    plan = []
    while order:
        longest = order[0]
        available[longest] -= 1
        used = dict(fullest(available, [k for k in order if available[k]], capacity - longest))
        available[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        lengths = sorted(used, reverse=True)
        times = min(available[k] // used[k] for k in lengths)
        for k in lengths:
            available[k] -= times * used[k]
        plan.append(Combination(tuple(lengths), tuple(used[k] for k in lengths), times))
        order = [k for k in order if available[k]]
    return plan


@dataclass(frozen=True)
class Places:
    """For each length, the ranks from which its pieces go to a combination, and what a rank needs to find its place there."""

    first_rank: dict[int, np.ndarray]
    entry: dict[int, np.ndarray]  # rows of (first sequence, number in a sequence, offset of the first)

    @staticmethod
    def of(plan: list[Combination]) -> Places:
        taken: dict[int, int] = {}
        ranks: dict[int, list] = {}
        entries: dict[int, list] = {}
        sequence = 0
        for c in plan:
            offset = 0
            for length, many in zip(c.lengths, c.many, strict=True):
                ranks.setdefault(length, []).append(taken.get(length, 0))
                entries.setdefault(length, []).append((sequence, many, offset))
                taken[length] = taken.get(length, 0) + many * c.times
                offset += length * many
            sequence += c.times
        return Places({k: np.array(v) for k, v in ranks.items()}, {k: np.array(v) for k, v in entries.items()})

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            length = int(lengths[group[0]])
            at = np.searchsorted(self.first_rank[length], ranks[group], "right") - 1
            begin, many, base = self.entry[length][at].T
            inside = ranks[group] - self.first_rank[length][at]
            sequence[group], offset[group] = begin + inside // many, base + length * (inside % many)
        return sequence, offset


def ranked(cut_up: DataFrame, counts: dict[int, int], group: int = GROUP) -> DataFrame:
    """The pieces with rank, from 0, among those of their length, of which there are ``counts``."""
    dealt = [(length, max(1, -(-n // group))) for length, n in counts.items()]
    salts = cut_up.sparkSession.createDataFrame(dealt, "length long, salts long")  # of a row for each length
    salted = cut_up.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    if sum(n for _, n in dealt) <= MOST_GROUPS:
        begins = F.broadcast(begins)
    return salted.withColumn("own", own).join(begins, ["length", "salt"]).select(*cut_up.columns, (F.col("begin") + F.col("own") - 1).alias("rank"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of ``docs``.

    Every document has at least one piece. Repeated rows and null ids are packed as rows of their own. Empty input: no rows.
    """
    cut_up = cut(pieces(docs, capacity, tokenizer))
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    places = docs.sparkSession.sparkContext.broadcast(Places.of(minimum_bin_slack(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.value.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, found)], [*kept.schema.names, "sequence_id", "offset"])

    schema = T.StructType([*cut_up.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # rank first into a cut table: a rank must not change if a lost task is run again
    return cut(ranked(cut_up, counts)).mapInArrow(place, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
