import random

import corpus_pipeline as cp
from sievecraft.llm.word_sets import drop_similar

SF = "/root/testdata/sf0.001"


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Indexes of the rows that stay, by all pairs."""
    sets = [plain(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * 10 >= len(a | b) * 8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for i, (g, r) in enumerate(zip(group, rows, strict=True)):
        order = (r.doc_id is None, r.doc_id or 0)
        if g not in first or order < first[g][0]:
            first[g] = (order, i)
    return sorted(i for _, i in first.values())


def test_drop_similar_matches_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=n) for n in (60, 60, 300, 12)]
    texts = [None, "", "a", "a b", "A  b", "a b c d e", "a b c d e f"]
    for b in base:
        texts.append(" ".join(b))
        chain = list(b)
        for _ in range(25):  # copies with a word changed, and a chain that drifts away from its first
            other = list(b)
            other[rng.randrange(len(b))] = "x"
            chain[rng.randrange(len(b))] = rng.choice(words)
            texts += [" ".join(other), " ".join(chain)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = docs.collect()
    assert sorted(map(repr, drop_similar(docs).collect())) == sorted(repr(rows[i]) for i in plain_kept(rows))


def test_pipeline_leaves_no_similar_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        if name in ("exact_dedup", "near_dedup", "word_dedup"):
            before = docs.collect()
            docs = stage(spark, docs, SF)
    rows = docs.collect()
    assert plain_kept(rows) == list(range(len(rows)))
    assert sorted(map(repr, rows)) == sorted(repr(before[i]) for i in plain_kept(before)) and len(rows) < len(before)
