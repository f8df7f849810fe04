"""Prefix joins of word sets, proximity of phrases, and tables that are dropped, against brute force."""

import os
import random

from pyspark.sql import functions as F

from sievecraft.llm import word_sets as ws
from sievecraft.llm.common import shared_dir
from sievecraft.llm.components import components
from sievecraft.llm.decontaminate import contamination, near_phrases
from sievecraft.llm.repeated_spans import without_repeats


def test_prefix_pairs_hold_every_similar_pair(spark):
    r = random.Random(7)
    common = list(range(1000, 1200))
    sets = []
    for base in range(12):
        own = r.sample(range(base * 50, base * 50 + 40), r.randint(3, 30)) + r.sample(common, r.randint(0, 120))
        for _ in range(5):
            s = set(own)
            for x in r.sample(sorted(s), min(len(s) - 1, r.randint(0, 4))):
                s.discard(x)
            sets.append(sorted(s | set(r.sample(range(2000, 2600), r.randint(0, 3)))))
    rows = spark.createDataFrame([(k, k, s) for k, s in enumerate(sets)], "fp long, c long, hashes array<long>").repartition(4)
    got = {(x.u, x.v) for x in ws.prefix_pairs(rows).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) * 10 >= len(set(sets[i]) | set(sets[j])) * 8}
    assert alike and alike <= got and len(got) < len(sets) * (len(sets) - 1) / 4
    one = ws.prefix_pairs(rows.withColumn("c", F.lit(1))).count()
    assert one == 0 and ws.prefix_pairs(rows.limit(0)).count() == 0


def test_prefixes_of_any_order_hold_every_similar_pair(spark):
    r = random.Random(9)
    bases = [r.sample(range(4000), 40) for _ in range(8)]
    sets = [sorted({*r.sample(b, 37), *r.sample(range(5000, 5200), 2), -k - 1}) for k, b in enumerate(bases * 4)]
    rows = spark.createDataFrame([(k, k, s) for k, s in enumerate(sets)], "fp long, c long, hashes array<long>").repartition(4)
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) * 10 >= len(set(sets[i]) | set(sets[j])) * 8}
    for counters in (1, 7, 1 << 20):  # one counter for all shingles, crowded ones, and nearly one each
        first = ws.prefixes(rows, counters)
        assert alike and alike <= {(x.u, x.v) for x in ws.joined_prefixes(first).collect()}
        assert "Join" not in first._jdf.queryExecution().executedPlan().toString()


def test_components_of_few_and_of_many_edges(spark):
    r = random.Random(10)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(50)] + [(-5, 300), (300, 301)]
    edges = [(u, v) for u, v in edges if u != v]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    rows = spark.createDataFrame(edges, "u long, v long").repartition(3)
    for few in (0, 30, 1000):  # all rounds dealt, then some, then none
        got = components(rows, few)
        assert {x.vertex: x.root for x in got.collect()} == {x: m for x, m in least.items() if x != m}
    assert got.rdd.getNumPartitions() == 1 and components(rows.limit(0)).count() == 0


def plain_near(words, phrase, rarest, reach):
    for at, w in enumerate(words):
        if w == rarest and all(words[max(0, at - reach) : at + reach + 1].count(p) >= phrase.count(p) for p in phrase):
            return True
    return False


def test_near_phrases_match_brute_force(spark):
    r = random.Random(8)
    letters = "a b c d e f g".split()
    docs = [(k, " ".join(r.choices(letters, weights=[9, 7, 5, 3, 2, 1, 1], k=r.randint(0, 40)))) for k in range(60)] + [(60, None)]
    items = [(1, "g a b"), (2, "f f c"), (3, "e"), (4, None), (5, "zz a")]
    found = {(x.doc_id, x.item_id) for x in near_phrases(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 10, 0).collect()}
    every = " ".join(t or "" for _, t in docs).split()
    want = set()
    for item, text in items:
        phrase = (text or "").split()
        if phrase and all(every.count(p) for p in phrase):
            rarest = min(phrase, key=lambda p: (every.count(p), phrase.index(p)))
            want |= {(k, item) for k, t in docs if plain_near((t or "").split(), phrase, rarest, 10)}
    assert found == want and want


def test_scratch_tables_are_dropped(spark):
    docs = spark.createDataFrame([(1, "the same long passage " * 30), (2, "x " + "the same long passage " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same long passage")], "item_id long, text string")
    folder = shared_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if not x.startswith("rdd-")}
    assert without_repeats(docs).count() == 2 and contamination(docs, items).where("contaminated").count() == 2
    assert {x for x in os.listdir(folder) if not x.startswith("rdd-")} == before
