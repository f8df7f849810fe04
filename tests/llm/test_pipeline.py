import re

import corpus_pipeline as cp
from sievecraft.llm.decontaminate import contamination
from sievecraft.llm.quality import classify
from sievecraft.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def plain(text):
    """Five-word shingles."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 4")).unionByName(docs.where("doc_id = 7").selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    rows = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {(r.doc_id) for r in classify(docs, labels).collect() if r.predicted}
    kept = cp.quality(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(repr(r) for r in rows if r.doc_id in good)

    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        order = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        if key not in best or order < best[key][0]:
            best[key] = (order, r)
    once = cp.exact_dedup(spark, docs, SF)
    assert sorted(map(repr, once.collect())) == sorted(repr(r) for _, r in best.values())

    prints = [(fingerprint((r.text or "").encode()), r) for r in rows]
    sets = [plain(r.text) for r in rows]
    group = list(range(len(prints)))
    for i, (a, _) in enumerate(prints):
        for j, (b, _) in enumerate(prints[:i]):
            if bin(a ^ b).count("1") <= 3 or (sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for g, (_, r) in zip(group, prints, strict=True):
        if g not in first or (r.doc_id is None, r.doc_id or 0) < (first[g].doc_id is None, first[g].doc_id or 0):
            first[g] = r
    assert sorted(map(repr, cp.near_dedup(spark, docs, SF).collect())) == sorted(map(repr, first.values()))

    bad = {r.doc_id for r in contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert sorted(map(repr, cp.decontaminate(spark, docs, SF).collect())) == sorted(repr(r) for r in rows if r.doc_id not in bad)


def test_run_and_empty_input(spark):
    packed = cp.run(spark, SF).collect()
    assert packed and {"doc_id", "sequence_id", "offset"} <= set(packed[0].asDict())
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 0
