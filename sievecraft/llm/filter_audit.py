"""What each filter does beside the others, in every order of the filters, by a product of integer matrices.

Each document has a mask of the filters that it fails. A part's histogram of masks, with those of its good and its toxic
documents, are rows of 2^k numbers; fixed matrices of 2^k by k!k say for each order and step which masks are kept, removed, removed
already and failed alone, so one product of a row with a matrix gives the counts of all orders. No document is looked at twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import Scratch, cut, table, text_or_empty

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: With more filters the matrices would have over 720 * 6 columns.
MOST_FILTERS = 6
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def matrices(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) of each column, and for each outcome the 0/1 matrix of masks by columns; bit i of a mask is letters[i].

    ``shapley`` has in each column the number of orders in which the column's filter is the one that removes the mask.
    """
    orders = ["".join(p) for p in permutations(letters)]
    columns = [(order, step) for order in orders for step in range(1, len(letters) + 1)]
    bit = {x: 1 << i for i, x in enumerate(letters)}
    own = np.array([bit[order[step - 1]] for order, step in columns])
    before = np.array([sum(bit[x] for x in order[: step - 1]) for order, step in columns])
    masks = np.arange(1 << len(letters))[:, None]
    fails, gone = (masks & own) != 0, (masks & before) != 0
    removed = fails & ~gone
    found = {"kept": (masks & (own | before)) == 0, "removed": removed, "redundant": fails & gone, "unique_fails": (masks == own) & fails}
    found = {name: m.astype(np.int64) for name, m in found.items()}
    same = (own[:, None] == own[None, :]).astype(np.int64)
    return columns, found | {"shapley": found["removed"] @ same}


def histograms(rows: DataFrame) -> DataFrame:
    """(part, masks): for each part an array of (mask, n, good, toxic), of at most 2^k entries. ``rows``: part, mask, good, toxic (0 or 1)."""
    one = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return one.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


def outcomes(counts: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step, from the parts' histograms. An empty table has no parts."""
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, tables = matrices(letters)
        names = pa.array([order for order, _ in columns]), pa.array([step for _, step in columns], pa.int32())
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.zeros((3, 1 << len(letters)), np.int64)
                for x in masks:
                    rows[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = [rows[0] @ tables[name] for name in OUTCOMES]
                found += [rows[1] @ tables["removed"], rows[2] @ tables["removed"], rows[0] @ tables["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns)), *names, *[pa.array(x) for x in found]], HEAD)

    return counts.mapInArrow(product, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in HEAD[3:]))


HEAD = ["part", "filter_order", "step", *OUTCOMES, "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = None, part: str = "lang") -> DataFrame:
    """Outcomes of ``filters`` (letter: condition on ``text``, true where a document fails) in all orders, for each value of ``part``.

    ``copies`` is the letter of a further filter: it fails texts that are identical to the text of any smaller doc_id, in whatever part.
    Null texts and parts count as empty, an empty text is a text like any other, and very long texts are read whole. A null doc_id is no smaller one
    and has none; repeated rows count each, and none of them is smaller than the other. A document is good or toxic if any row of ``labels``
    says so; without a row it is neither. Other columns are ignored, whatever their names. Empty tables give no rows.
    """
    letters = "".join(filters) + (copies or "")
    scratch = Scratch(docs.sparkSession, "audit")
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    text = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = text.select("doc_id", "part", bits.alias("mask"), *([F.unhex(F.sha2("text", 256)).alias("digest")] if copies else []))
    if copies:
        rows = scratch.store(rows)
        # stored, so that the join has exchanges of its own, of which Spark can split the partition of a hot text
        first = scratch.store(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
        again = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(filters))).otherwise(0)
        rows = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    rows = rows.join(known, "doc_id", "left")
    of = lambda c: F.coalesce(c, F.lit(0))
    counts = cut(histograms(rows.select("part", "mask", of("quality").alias("good"), of("toxic").alias("toxic"))))
    scratch.drop()
    return outcomes(counts, letters)


def text_filters() -> dict[str, Column]:
    """A: under 200 words. B: under half of the words distinct. C: over 3 % capitals. D: a character of code or tables."""
    text = F.col("text")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text_filters(), copies="E")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
             [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c
"""
