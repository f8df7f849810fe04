"""Ranked lexical search by best-first branch-and-bound over trees of maxima.

One pass over the texts stores shards: a range of documents with their lengths and the postings of all query terms. Within a
shard each term has a tree over the range: a leaf holds what the term adds to one document's score, a node the largest
value below it. The summed values of an item's terms at a node bound the score of every document below. The search of an item opens
the node of the highest bound first and ends when that bound is below the score of its last place; nodes whose bound equals it are
opened too, since a document below may have that score and a smaller id.

The roots of the shards are a level above: each item is first searched in the shards of the highest root bounds, and the score
that its last place has there is the floor of the search in all others.

Query terms come in blocks of bounded size with a pass of their own, so what tasks hold grows neither with items nor with documents.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import Scratch, cut, table, text_or_empty, word_lists

PLACES = 10
#: Distinct terms of the items that are searched in one pass (an item with more has a pass with no other).
TERMS_AT_ONCE = 20_000
#: A shard ends at so many documents, or after the document that brings so many postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = 1024, 50_000
#: Children of a node.
FAN = 16
#: Shards that give an item its floor.
SEEDS = 2
#: Each byte of UTF-8 as itself if a term may hold it, A-Z lower-cased, any other as a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms) of the items that have terms; rows repeated with one id and text are one item."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({w for words in word_lists(x.translate(TERM_BYTES)) for w in words}) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    text = text_or_empty()
    rows = items.select(F.sha2(F.concat_ws("\0", F.col("item_id").isNull(), F.col("item_id").cast("string"), text), 256).alias("item"), "item_id", text.cast("binary").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return cut(rows.dropDuplicates(["item"]).mapInArrow(made, f"item string, item_id {kind}, terms array<binary>").where("size(terms) > 0"))


def _shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of the documents that have terms: ids, lengths, and postings (term, document's place, count) sorted by term and place."""
    of_id = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[int] = []
        terms: list[int] = []
        places: list[int] = []
        counts: list[int] = []

        def done() -> pa.RecordBatch:
            term, place, count = np.array(terms, np.int32), np.array(places, np.int32), np.array(counts, np.int32)
            order = np.lexsort((place, term))
            seen, holding = np.unique(term, return_counts=True)
            columns = [pa.array([name]), pa.array([ids], pa.list_(kind)), pa.array([np.array(lengths, np.int64).tobytes()]), pa.array([len(ids)]), pa.array([sum(lengths)])]
            columns += [pa.array([x[order].tobytes()], pa.binary()) for x in (term, place, count)]
            columns += [pa.array([seen.tolist()], pa.list_(pa.int32())), pa.array([holding.tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SHARD.format(kind="").split(", ")])

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, Counter()
                for words in word_lists((text.as_py() or b"").translate(TERM_BYTES)):
                    n += len(words)
                    found.update(map(vocabulary.get, words))
                found.pop(None, None)
                if not n:
                    continue
                places += [len(ids)] * len(found)
                terms += found.keys()
                counts += found.values()
                ids.append(doc_id)
                lengths.append(n)
                if len(ids) >= SHARD_DOCUMENTS or len(terms) >= SHARD_POSTINGS:
                    yield done()
                    name += 1
                    for x in (ids, lengths, terms, places, counts):
                        x.clear()
        if ids:
            yield done()

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(made, SHARD.format(kind=of_id))


SHARD = "shard bigint, ids array<{kind}>, lengths binary, n_docs bigint, n_terms bigint, terms binary, places binary, counts binary, seen array<int>, holding array<bigint>"


class Tree:
    """The trees of maxima of all terms of a shard. values are sorted by term and place."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, values: np.ndarray, n: int):
        self.places, self.values = places, values
        self.terms, local = np.unique(terms, return_inverse=True)
        self.width = max(1, -(-n // FAN))
        self.keys = local.astype(np.int64) * self.width + places // FAN
        level = np.zeros(len(self.terms) * self.width, np.int64)
        if len(values):
            first = np.concatenate([[0], np.flatnonzero(np.diff(self.keys)) + 1])
            level[self.keys[first]] = np.maximum.reduceat(values, first)
        self.levels = [level.reshape(-1, self.width)]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            below = np.pad(below, ((0, 0), (0, -below.shape[1] % FAN)))
            self.levels.append(below.reshape(len(below), -1, FAN).max(axis=2))

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """Rows of those terms that the shard holds."""
        at = np.searchsorted(self.terms, terms)
        inside = at < len(self.terms)
        at, terms = at[inside], terms[inside]
        return at[self.terms[at] == terms]

    def bound(self, rows: np.ndarray) -> int:
        return int(self.levels[-1][rows, 0].sum())

    def leaves(self, rows: np.ndarray, node: int) -> np.ndarray:
        """Scores of the documents below a lowest node."""
        low = np.searchsorted(self.keys, rows * self.width + node)
        sizes = np.searchsorted(self.keys, rows * self.width + node, "right") - low
        at = np.repeat(low + sizes - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        scores = np.zeros(FAN, np.int64)
        np.add.at(scores, self.places[at] - node * FAN, self.values[at])
        return scores

    def search(self, rows: np.ndarray, ids: list, most: int, floor: int) -> list[tuple]:
        """(-score, id is null, id, place) of the ``most`` best documents of a score of at least ``floor`` and above 0, best first."""
        top = len(self.levels) - 1
        heap = [(-self.bound(rows), top, 0)]
        best: list[tuple] = []
        while heap:
            bound, level, node = heapq.heappop(heap)
            least = max(1, floor, -best[-1][0] if len(best) == most else 0)
            if -bound < least:
                break
            if level:
                below = self.levels[level - 1][rows, node * FAN : (node + 1) * FAN].sum(axis=0)
                for k in np.flatnonzero(below >= least).tolist():
                    heapq.heappush(heap, (-int(below[k]), level - 1, node * FAN + k))
                continue
            scores = self.leaves(rows, node)
            for k in np.flatnonzero(scores >= least).tolist():
                place = node * FAN + k
                insort(best, (-int(scores[k]), ids[place] is None, 0 if ids[place] is None else ids[place], place))
                del best[most:]
        return best


def _weights(n: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in holding.tolist()], np.int64)


def _searched(shards: DataFrame, queries: list[tuple[int, np.ndarray]], floors: dict[int, int], weights: np.ndarray, n: int, total: int, kind: str, most: int, only_bounds: bool = False) -> DataFrame:
    """(item, doc_id, score) of each shard's best documents, or (item, shard, bound) of its roots. A shard with ``items`` is searched for those alone."""

    def tree_of(row: dict) -> Tree:
        terms, places = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["places"], np.int32)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        m = np.array([10 + 90 * x * n // total for x in np.frombuffer(row["lengths"], np.int64).tolist()], np.int64)
        values = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[places]))
        return Tree(terms, places, values, len(m))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                tree, found = tree_of(row), []
                wanted = row.get("items")
                for item, terms in queries if wanted is None else [queries[i] for i in wanted]:
                    rows = tree.rows(terms)
                    if only_bounds:
                        found += [(item, row["shard"], tree.bound(rows))] if len(rows) else []
                    elif len(rows):
                        found += [(item, row["ids"][x[3]], -x[0]) for x in tree.search(rows, row["ids"], most, floors.get(item, 0))]
                if found:
                    second = pa.int64() if only_bounds else batch.schema.field("ids").type.value_type
                    arrays = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), second, pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["item", "shard", "bound"] if only_bounds else ["item", "doc_id", "score"])

    return shards.mapInArrow(made, "item int, shard bigint, bound bigint" if only_bounds else f"item int, doc_id {kind}, score bigint")


def _first(rows: DataFrame, most: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)


def _block(docs: DataFrame, block: list, most: int, scratch: Scratch) -> DataFrame:
    """(item, rank, doc_id, score) for a block of items, which is small: item is a place in it."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    vocabulary = {w: k for k, w in enumerate(sorted({bytes(w) for r in block for w in r.terms}))}
    queries = [(k, np.array(sorted(vocabulary[bytes(w)] for w in r.terms))) for k, r in enumerate(block)]
    shards = scratch.store(_shards(docs, vocabulary))
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n:
        return spark.createDataFrame([], f"item int, rank int, doc_id {kind}, score bigint")
    holding = np.zeros(len(vocabulary), np.int64)
    # a row for each term of the block at most
    for r in shards.select(F.explode(F.arrays_zip("seen", "holding")).alias("x")).groupBy("x.seen").agg(F.sum("x.holding").alias("n")).collect():
        holding[r.seen] = r.n
    weights = _weights(n, holding)
    shards = shards.drop("seen", "holding", "n_docs", "n_terms")
    bounds = _searched(shards, queries, {}, weights, n, total, kind, most, only_bounds=True)
    seeds = cut(_first(bounds, SEEDS, F.desc("bound"), "shard").groupBy("shard").agg(F.collect_list("item").alias("items")))  # SEEDS rows for each item of the block
    tried = _first(_searched(shards.join(F.broadcast(seeds), "shard"), queries, {}, weights, n, total, kind, most), most, F.desc("score"))
    floors = {r.item: r.score for r in tried.where(F.col("rank") == most).collect()}
    found = _searched(shards, queries, floors, weights, n, total, kind, most)
    return _first(found, most, F.desc("score"), F.col("doc_id").asc_nulls_last()).select("item", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, most: int = PLACES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``most`` documents of the highest scores above 0, equal scores by doc_id, null last.

    Null and empty texts have no terms; such documents are in no count and such items have no rows. Very long texts are read whole, in pieces. Repeated rows
    of documents are documents of their own and may both have a place; items repeated with one id and text are one. Other columns are ignored.
    An empty table on either side gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "search")
    terms = _item_terms(items)
    size = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // TERMS_AT_ONCE))
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    results = []
    for k in range(blocks):
        block = dealt.where(F.col("block") == k).orderBy("item").collect()  # some TERMS_AT_ONCE terms
        if block:
            names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            results.append(cut(_block(docs, block, most, scratch).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    scratch.drop()
    if not results:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    whole = results[0]
    for x in results[1:]:
        whole = whole.unionByName(x)
    return whole


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
a AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // total)))) AS part
      FROM p JOIN f USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN a USING (term) GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
