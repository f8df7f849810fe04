"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is
    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so pairwise interactions of all features cost time linear in their number. The model is fitted by
Adagrad on a bounded sample of labelled rows (``MAX_TRAIN`` by default, a parameter of ``fit``),
chosen by a hash of the id and so the same in every run; every row of the input is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import fresh, in_slices, table

#: At most so many labelled rows are used for fitting.
MAX_TRAIN = 12_000
WORD_DIMS = 1 << 14
FACTORS = 8
#: Minibatches that the model is fitted with, whatever the number of rows.
STEPS = 600
BATCH = 128
RATE = 0.08
THRESHOLD = 0.3
#: Words that one lookup of hashed indexes remembers before it starts anew.
REMEMBER = 200_000

SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?!-]")
STATISTICS = (
    "letters", "upper", "digits", "symbols", "bars", "punctuation", "spaces", "mean_word", "long_words",
    "short_words", "distinct_words", "longest_line", "repeats", "lines", "distinct_lines", "mean_line",
    "capital_words", "ended_lines", "log_chars", "log_words",
)


class _Indexes(dict):
    """Hashed index of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        at = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIMS
        return at


def statistics(text: str, words: list[str], n_chars: int | None) -> list[float]:
    """Shape of the text, each number roughly between 0 and 1, in the order of STATISTICS."""
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    upper = sum(map(str.isupper, words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    capitals = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    return [
        letters / n,
        capitals / n,
        len(re.findall(r"\d", text)) / n,
        len(SYMBOLS.findall(text)) / w,
        text.count("|") / w,
        len(re.findall(r"[.,;:?!]", text)) / w,
        len(re.findall(r"\s", text)) / n,
        min(1.0, n / w / 20),
        sum(len(x) > 14 for x in words) / w,
        sum(len(x) < 3 for x in words) / w,
        len(distinct) / w,
        len(max(lines, key=len, default="")) / n,
        repeats / w,
        min(1.0, len(lines) / 100),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, n / max(1, len(lines)) / 1000),
        upper / w,
        sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / max(1, len(lines)),
        math.log1p(n_chars if n_chars is not None else len(text)) / 12,
        math.log1p(len(words)) / 10,
    ]


def features(text: str | None, n_chars: int | None, indexes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Distinct word indexes, their weights (of length one together), statistics. Null is as empty."""
    text = text or ""
    words = text.split()
    at, counts = np.unique(np.fromiter(map(indexes.__getitem__, words), np.int32, len(words)), return_counts=True)
    x = np.log1p(counts)
    return at, (x / max(1e-9, float(np.sqrt(x @ x)))).astype(np.float32), statistics(text, words, n_chars)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray, stats: list[float]) -> float:
        at = np.concatenate([at, np.arange(WORD_DIMS, WORD_DIMS + len(stats))])
        x = np.concatenate([x, (np.asarray(stats) - self.mean) / self.scale])
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0)
        z = self.bias + float(self.linear[at] @ x) + 0.5 * float(total @ total - np.sum(v * v))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, seed: int = 7) -> Model:
    """Adagrad on the logistic loss. Without rows every score is 0.5, with one class alone near its label."""
    rng = np.random.default_rng(seed)
    n_stats = len(STATISTICS)
    dims = WORD_DIMS + n_stats
    model = Model(0.0, np.zeros(dims), rng.normal(0, 0.02, (dims, FACTORS)), np.zeros(n_stats), np.ones(n_stats))
    if not rows:
        model.factors[:] = 0
        return model
    stats = np.array([r[2] for r in rows])
    model.mean, model.scale = stats.mean(axis=0), 3 * stats.std(axis=0) + 0.05
    stats = (stats - model.mean) / model.scale
    tail = np.arange(WORD_DIMS, dims)
    # all words in two long arrays: many small ones would leave the process larger than it need be
    ends = np.cumsum([len(r[0]) for r in rows])
    begins = ends - [len(r[0]) for r in rows]
    words, weights = np.concatenate([r[0] for r in rows]).astype(np.int32), np.concatenate([r[1] for r in rows]).astype(np.float32)
    n_rows = len(rows)
    del rows
    rate = float(np.clip(labels.mean(), 0.01, 0.99))
    model.bias = math.log(rate / (1 - rate))
    g_bias, g_linear, g_factors = 1e-6, np.full(dims, 1e-6), np.full((dims, FACTORS), 1e-6)
    for _ in range(math.ceil(STEPS * BATCH / n_rows)):
        order = rng.permutation(n_rows)
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            ats = [np.concatenate([words[begins[i] : ends[i]], tail]) for i in pick]
            lengths = np.array([len(a) for a in ats])
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            row = np.repeat(np.arange(len(pick)), lengths)
            keys, at = np.unique(np.concatenate(ats), return_inverse=True)
            x = np.concatenate([y for i in pick for y in (weights[begins[i] : ends[i]], stats[i])])
            v = model.factors[keys][at]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, begin, axis=0)
            z = model.bias + np.add.reduceat(model.linear[keys][at] * x, begin)
            z += 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), begin))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            e = error[row] * x
            order_of = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order_of], np.arange(len(keys)))
            d_linear = np.add.reduceat(e[order_of], starts) + 1e-6 * model.linear[keys]
            d_factors = np.add.reduceat((e[:, None] * (total[row] - vx))[order_of], starts, axis=0) + 1e-6 * model.factors[keys]
            d_bias = float(error.sum())
            g_bias += d_bias**2
            g_linear[keys] += d_linear**2
            g_factors[keys] += d_factors**2
            model.bias -= RATE * d_bias / math.sqrt(g_bias)
            model.linear[keys] -= RATE * d_linear / np.sqrt(g_linear[keys])
            model.factors[keys] -= RATE * d_factors / np.sqrt(g_factors[keys])
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    indexes = _Indexes()
    for batch in in_slices(batches):
        made = [features(t, n, indexes) for t, n in zip(batch["text"].to_pylist(), batch["n_chars"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "order": batch["order"],
                "id": batch["id"],
                "quality": batch["quality"],
                "at": pa.array([m[0] for m in made], pa.list_(pa.int32())),
                "x": pa.array([m[1] for m in made], pa.list_(pa.float32())),
                "stats": pa.array([m[2] for m in made], pa.list_(pa.float64())),
            }
        )


def _inputs(docs: DataFrame) -> list[Column]:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("text").cast("string").alias("text"), n_chars.alias("n_chars")]


def held_out(column: str = "doc_id") -> Column:
    """True for the fifth of the ids that is never learned from (null: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Model of ``labels.quality`` from at most ``max_train`` labelled rows outside the held-out fifth.

    Of labels that repeat a doc_id the smallest is learned, of documents that repeat one that with the smallest text. The
    rows are learned from in an order of their own ids, so the model doesn't depend on partitions or lost executors.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "doc_id", "quality")
        .limit(max_train)
        .drop("order")
    )
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(chosen), "doc_id")
    # of documents that share an id one is learned from, so no more than max_train rows reach the driver
    sample = sample.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min(F.struct("text", "n_chars")).alias("one"))
    sample = sample.select(F.xxhash64("doc_id").alias("order"), F.col("doc_id").cast("string").alias("id"), "quality", "one.text", "one.n_chars")
    features_ = sample.mapInArrow(_feature_batches, "order bigint, id string, quality int, at array<int>, x array<float>, stats array<double>")
    # one task learns from the bounded sample, in an order of its own, so the model is the same however the rows are laid out; the driver sees the model only
    learned = features_.repartition(1).sortWithinPartitions("order", "id").mapInArrow(_learn, MODEL).toArrow().to_pylist()
    if not learned:
        return train([], np.zeros(0))
    m = learned[0]
    return Model(m["bias"], np.array(m["linear"]), np.array(m["factors"]).reshape(-1, FACTORS), np.array(m["mean"]), np.array(m["scale"]))


MODEL = "bias double, linear array<double>, factors array<double>, mean array<double>, scale array<double>"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, rows = [], []
    for batch in batches:
        labels += batch["quality"].to_pylist()
        at, x, stats = (_slices(batch[c]) for c in ("at", "x", "stats"))
        rows += [(a, b, c.tolist()) for a, b, c in zip(at, x, stats, strict=True)]
    if rows:
        m = train(rows, np.array(labels, float))
        kind = pa.list_(pa.float64())
        arrays = [pa.array([list(v)], kind) for v in (m.linear, m.factors.ravel(), m.mean, m.scale)]
        yield pa.RecordBatch.from_arrays([pa.array([m.bias], pa.float64()), *arrays], ["bias", "linear", "factors", "mean", "scale"])


def _slices(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as arrays, without a Python object for each number."""
    values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    return np.split(values, ends[:-1]) if len(ends) else []


def quality_scores(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id by default) of every row, and its score between 0 and 1 in the column ``name``.

    Null and empty texts are scored by their statistics; a missing n_chars is counted from the text.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _Indexes()
        for batch in in_slices(batches):
            texts, sizes = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            scores = [shared.value.score(*features(t, n, indexes)) for t, n in zip(texts, sizes, strict=True)]
            kept = batch.select(range(batch.num_columns - 2))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], [*kept.schema.names, name])

    text, n_chars = _inputs(docs)
    rows = docs.select(*keep, text.alias(fresh(keep, "text")), n_chars.alias(fresh(keep, "n_chars")))
    schema = docs.select(*keep).schema.add(name, "double")
    return rows.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= THRESHOLD) of each row of ``docs``.

    Null and empty texts are scored as empty ones; repeated rows are returned each and have one score. Without labels every score is 0.5.
    """
    scored = quality_scores(docs, fit(docs, labels, max_train))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject."""
    name = fresh(docs.columns, "score")
    return quality_scores(docs, fit(docs, labels, max_train), docs.columns, name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
