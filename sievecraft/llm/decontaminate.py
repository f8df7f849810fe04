r"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

Test items are cut into phrases (windows of WINDOW words; a shorter item is one phrase). One pass over
the texts stores the postings of all test words, as narrow rows of word number, document and position; the number of
words of each document rides along, and word counts are read off the postings. Then the lists are
intersected from the rarest words on: the postings of a phrase's rarest word, less its offset, are the possible
starts; those stay whose second rarest word has a posting at its own offset; of these few the other words
are looked up. Hot words are met map-side, and all later joins are by document and position, so no list is gathered anywhere.

What is broadcast is counted first: test words come in blocks of at most BLOCK_WORDS, and a block has a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import Scratch, cut, keep_rows, split_by_filter, table, text_or_empty, text_print

WINDOW = 10
#: Test words (or phrases) that are broadcast at once; under 200 bytes each.
BLOCK_WORDS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word number of the row that each document has besides its postings; its position is the number of words.
DOCUMENT = -1


def words(column: str = "text") -> Column:
    """Words of the text, A-Z lower-cased: runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Null has none."""
    lowered = F.translate(text_or_empty(column), UPPER, LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct phrases of the items: phrase (array of words) and item_ids (sorted array)."""
    of_item = items.select("item_id", words().alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut_up = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, F.lit(window)))
    return of_item.select("item_id", F.explode(cut_up).alias("phrase")).groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BLOCK_WORDS else rows


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index: number, doc_id, print, position of every word of the ``vocabulary`` (word, number; at most BLOCK_WORDS), and a row DOCUMENT for each row of ``docs``."""
    w = words()
    # the first element stands for the document; an impossible word, so it is no test word
    marked = docs.select("doc_id", text_print().alias("print"), F.concat(F.array(F.lit(" ")), w).alias("w"))
    marked = marked.select("doc_id", "print", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
    met = marked.join(F.broadcast(vocabulary.unionByName(_document(vocabulary))), "word")
    place = F.when(F.col("number") == DOCUMENT, F.col("n") - 1).otherwise(F.col("at") - 1)
    return met.select("number", "doc_id", "print", place.alias("position"))


def _document(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.sparkSession.createDataFrame([(" ", DOCUMENT)], vocabulary.select("word", "number").schema)


class Index:
    """Stored postings of all words of the items' phrases over the documents, the phrases and their words from the rarest on."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        self.scratch = Scratch(docs.sparkSession, "postings")
        found = cut(phrases(items, window).withColumn("id", F.monotonically_increasing_id()))
        numbered = found.select(F.explode("phrase").alias("word")).distinct().withColumn("number", F.monotonically_increasing_id())
        numbered = cut(numbered.select("word", "number"))
        blocks = max(1, -(-numbered.count() // BLOCK_WORDS))
        parts = [self.scratch.store(postings(docs, numbered.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k))) for k in range(blocks)]
        # every pass has the documents; they are taken from the first
        self.documents = parts[0].where(F.col("number") == DOCUMENT).select("doc_id", "print", F.col("position").cast("long").alias("n_words"))
        self.postings = parts[0].where(F.col("number") != DOCUMENT)
        for part in parts[1:]:
            self.postings = self.postings.unionByName(part.where(F.col("number") != DOCUMENT))
        counts = cut(self.postings.groupBy("number").agg(F.count(F.lit(1)).alias("n")))
        places = found.select("id", F.posexplode("phrase").alias("offset", "word")).join(_few(numbered), "word").join(_few(counts), "number", "left")
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "number")))
        ranked = places.groupBy("id").agg(ordered.alias("terms")).where("terms[0].n > 0")  # a word that never occurs ends the search for its phrase
        self.phrases = cut(ranked.join(found.select("id", F.size("phrase").alias("length"), "item_ids"), "id"))

    def anchored(self) -> DataFrame:
        """Possible starts: the postings of each phrase's rarest word less its offset. id, doc_id, print, at (of the posting), start."""
        sought = self.phrases.select("id", F.col("terms")[0]["number"].alias("number"), F.col("terms")[0]["offset"].alias("offset"))
        met = self.postings.join(_few(cut(sought)), "number").where("position >= offset")
        return met.select("id", "doc_id", "print", F.col("position").alias("at"), (F.col("position") - F.col("offset")).alias("start")).distinct()

    def _having(self, rows: DataFrame, held: DataFrame) -> DataFrame:
        """The rows (doc_id, print, number, position) that have a posting in ``held``."""
        same = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in ("print", "position", "number")]
        return rows.alias("r").join(held.alias("p"), [F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")), *same], "left_semi")

    def _of(self, rows: DataFrame) -> DataFrame:
        """Postings of the documents of ``rows``, and a few others where these are many."""
        keys = cut(rows.select(F.col("doc_id").alias("k_id"), F.col("print").alias("k_print")).distinct())
        return split_by_filter(self.postings, keys, keys.count(), F.col("print"))[0]

    def exact_matches(self) -> DataFrame:
        """Distinct occurrences of phrases: id, doc_id, print, start, length, item_ids."""
        key = ["id", "doc_id", "print", "start"]
        size = F.size("terms")
        starts = cut(self.anchored().select(*key))
        second = cut(self.phrases.where(size > 1).select("id", F.col("terms")[1]["number"].alias("number"), F.col("terms")[1]["offset"].alias("offset")))
        two = starts.join(_few(second), "id").withColumn("position", F.col("start") + F.col("offset"))
        held = self.postings.join(_few(cut(second.select("number").distinct())), "number", "left_semi")
        two = cut(self._having(two, held).select(*key))
        others = self.phrases.where(size > 2).select("id", (size - 2).alias("n"), F.slice("terms", F.lit(3), size).alias("others"))
        asked = two.join(_few(cut(others)), "id").select(*key, "n", F.explode("others").alias("t"))
        asked = asked.select(*key, "n", F.col("t.number").alias("number"), (F.col("start") + F.col("t.offset")).alias("position"))
        met = self._having(asked, self._of(two)).groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n")).where("met = n").select(*key)
        of_size = lambda rows, n: rows.join(_few(cut(self.phrases.where(size == n).select("id"))), "id", "left_semi")
        hits = met.unionByName(of_size(two, 2)).unionByName(of_size(starts, 1))
        return hits.join(_few(cut(self.phrases.select("id", "length", "item_ids"))), "id")

    def proximity_matches(self, reach: int) -> DataFrame:
        """Postings of rarest words with every other word of the phrase at most ``reach`` words away, in any order: id, doc_id, print, at, item_ids.

        A word that a phrase has twice must be met twice. Postings are met by document, word and stretch of ``reach`` positions.
        """
        key = ["id", "doc_id", "print", "at"]
        starts = cut(self.anchored_anywhere())
        wanted = F.explode(F.expr("slice(terms, 1, size(terms))"))
        needs = self.phrases.select("id", wanted.alias("t")).groupBy("id", "t.number").agg(F.count(F.lit(1)).alias("times"))
        asked = starts.join(_few(cut(needs)), "id")
        near = F.explode(F.array(*[F.floor(F.col("at") / reach) + k for k in (-1, 0, 1)]))
        asked = asked.select(*key, "number", "times", near.alias("stretch")).alias("r")
        held = self._of(starts).distinct().withColumn("stretch", F.floor(F.col("position") / reach)).alias("p")
        same = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in ("print", "number", "stretch")]
        close = F.abs(F.col("p.position") - F.col("r.at")) <= reach
        met = asked.join(held, [F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")), *same, close]).select(*[f"r.{c}" for c in key], "r.number", "times")
        met = met.groupBy(*key, "number").agg(F.count(F.lit(1)).alias("n"), F.first("times").alias("times")).where("n >= times")
        counts = needs.groupBy("id").agg(F.count(F.lit(1)).alias("kinds"))
        met = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(_few(cut(counts)), "id").where("n = kinds").select(*key)
        return met.join(_few(cut(self.phrases.select("id", "item_ids"))), "id")

    def anchored_anywhere(self) -> DataFrame:
        """Postings of each phrase's rarest word, wherever they stand: id, doc_id, print, at."""
        sought = self.phrases.select("id", F.col("terms")[0]["number"].alias("number"))
        return self.postings.join(_few(cut(sought)), "number").select("id", "doc_id", "print", F.col("position").alias("at")).distinct()

    def drop(self) -> None:
        self.scratch.drop()


def indexed(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0) -> list[tuple[Index, int]]:
    """The index, and the reach of proximity matches: the words of a phrase and ``slack`` more."""
    return [(Index(docs, items, window), window - 1 + slack)]


def exact_matches(index: Index, reach: int) -> DataFrame:
    return index.exact_matches()


def proximity_matches(index: Index, reach: int) -> DataFrame:
    return index.proximity_matches(reach)


def near_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = WINDOW) -> DataFrame:
    """doc_id, item_id: documents in which all words of a phrase of the item stand within ``window + slack`` words of its rarest, in any order."""
    index = Index(docs, items, window)
    found = cut(index.proximity_matches(window + slack).select("doc_id", F.explode("item_ids").alias("item_id")).distinct())
    index.drop()
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns of whatever names, in which no phrase of the items occurs. Null texts stay; of repeated rows all stay or none."""
    index = Index(docs, items, window)
    hits = cut(index.exact_matches().select("doc_id", "print", F.lit(False).alias("kept")).distinct())
    index.drop()
    return keep_rows(docs, hits)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs``: n_words, n_hit (words inside any occurrence of a phrase), n_items, items_sha256
    (of the sorted item ids with occurring phrases), contaminated.

    Null and empty texts have no words and no hits; null or wordless items have no phrases; a null
    item_id is not counted. Repeated rows are returned each; a very long text is many postings, of which no task needs all. Other columns are ignored.
    """
    index = Index(docs, items, window)
    rows, hits = cut(index.documents), cut(index.exact_matches().drop("id").distinct())
    index.drop()
    none = F.sha2(F.lit("").cast("binary"), 256)
    key = ["doc_id", "print"]
    of_words = (
        hits.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
        .distinct()
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    ids = F.array_sort(F.transform(F.collect_set("item"), lambda i: i.cast("string")))
    of_items = hits.select(*key, F.explode("item_ids").alias("item")).distinct().groupBy(*key).agg(ids.alias("ids"))
    a, b = of_words.alias("a"), of_items.alias("b")
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.print") == F.col(f"{y}.print"))
    joined = a.join(b, same("a", "b"), "left").select("a.doc_id", "a.print", "n_hit", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    whole = rows.alias("r").join(joined.alias("h"), same("r", "h"), "left")
    return whole.select(
        "r.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.when(F.col("ids").isNull(), none).otherwise(F.sha2(F.array_join("ids", ",").cast("binary"), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, g.size, item_id FROM g JOIN p USING (phrase, size)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hit) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
