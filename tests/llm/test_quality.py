import random
import zlib

import numpy as np

from sievecraft.llm.quality import THRESHOLD, _Indexes, classify, drop_low_quality, features, train

DOCS = "doc_id long, text string, lang string, score string, n_chars long"


def made(n, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 60))]
        good = r.random() < 0.7
        text = " ".join(words).capitalize() + "." if good else " ".join(w + r.choice(["%%%", "###"]) for w in words)
        rows.append((i, text, "en", "clash", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_held_out_rows(spark):
    rows, labels = made(600)
    extra = [(1000, None, None, None, None), (1001, "", "en", None, 0), (None, "no id", None, None, None), (1002, "long " * 40000, "en", "x", None), rows[3]]
    docs = spark.createDataFrame(rows + extra, DOCS).repartition(3)
    marks = spark.createDataFrame([*labels, (1000, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = classify(docs, marks).collect()
    assert len(found) == len(rows) + len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in found)
    kept = drop_low_quality(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(d) for d in docs.collect() if next(r for r in found if r.doc_id == d.doc_id).predicted)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame(made(5)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    assert classify(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(5)], none.schema)
    assert all(r.predicted == 1 for r in classify(docs, one).collect())


def test_sum_of_squares_is_the_sum_over_pairs():
    rows, labels = made(60)
    indexes = _Indexes()
    fs = [features(r[1], r[4], indexes) for r in rows]
    model = train(fs, np.array([q for _, q, _ in labels], float))
    at, x, stats = fs[0]
    at = np.concatenate([at, np.arange(len(model.linear) - len(stats), len(model.linear))])
    x = np.concatenate([x, (np.array(stats) - model.mean) / model.scale])
    pairs = sum(float(model.factors[a] @ model.factors[b]) * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    z = model.bias + float(model.linear[at] @ x) + pairs
    assert abs(model.score(*fs[0]) - 1 / (1 + np.exp(-z))) < 1e-6


def test_held_out_accuracy_on_the_driver_tables(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in classify(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    right = [r.predicted == truth[r.doc_id] for r in held]
    pairs = [(a.score, b.score) for a in held for b in held if truth[a.doc_id] > truth[b.doc_id]]
    assert len(held) > 50 and np.mean(right) > 0.95
    assert np.mean([a > b for a, b in pairs]) > 0.98  # area under the curve
