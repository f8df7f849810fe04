"""Clashing names, layouts of partitions, many decisions, long texts and rolled archives."""

import gzip
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sievecraft.llm import common, word_sets
from sievecraft.llm.decontaminate import drop_contaminated
from sievecraft.llm.exact_dedup import drop_exact_copies
from sievecraft.llm.pii import KINDS, NEAR, find_personal_data
from sievecraft.llm.quality import classify
from sievecraft.llm.simhash import drop_fingerprint_copies
from sievecraft.llm.warc import read_archives, salvage, write_archives
from sievecraft.llm.word_sets import drop_near_copies

NAMES = ("k_id", "k_print", "print", "any", "kept", "of", "bits", "key", "fp", "root", "n", "rid", "digest", "word")


def odd(spark, n=60):
    """Rows with columns that are named like inner ones, repeated rows, null ids and texts."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(r.choices(words, k=30)) for _ in range(n // 3)]
    rows = [(i, texts[i % len(texts)] + (" extra" if i % 5 == 0 else ""), *[f"{i}"] * len(NAMES)) for i in range(n)]
    rows += rows[:4] + [(None, texts[0], *["x"] * len(NAMES)), (None, None, *["x"] * len(NAMES)), (n, None, *["y"] * len(NAMES)), (n + 1, "", *["z"] * len(NAMES))]
    schema = "doc_id long, text string, " + ", ".join(f"{x} string" for x in NAMES)
    return spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame([(1, texts[3]), (2, None), (3, "")], "item_id long, text string")


def test_stages_keep_columns_of_any_name_and_filters_keep_the_result(spark, monkeypatch):
    docs, items = odd(spark)
    stages = [drop_exact_copies, drop_fingerprint_copies, drop_near_copies, lambda d: drop_contaminated(d, items)]
    few = [stage(docs) for stage in stages]
    assert all(d.columns == docs.columns for d in few)
    few = [sorted(map(repr, d.collect())) for d in few]
    assert all(0 < len(x) < docs.count() for x in few)
    monkeypatch.setattr(common, "MAX_BROADCAST_KEYS", 0)
    monkeypatch.setattr(word_sets, "MAX_BROADCAST_KEYS", 0)
    assert [sorted(map(repr, stage(docs).collect())) for stage in stages] == few
    monkeypatch.setattr(common, "MAX_BITMAPS", 1)
    monkeypatch.setattr(common, "BITS_OF_KEY", 1)
    assert [sorted(map(repr, stage(docs).collect())) for stage in stages] == few
    assert all(stage(docs.limit(0)).count() == 0 for stage in stages)


def test_filter_passes_every_key_and_few_others(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    keys = rows.where("doc_id < 3000").select(F.col("doc_id").alias("k_id"), common.text_print().alias("k_print"))
    maybe, rest = common.split_by_filter(rows, keys, 3000)
    assert maybe.where("doc_id < 3000").count() == 3000 and rest.where("doc_id < 3000").count() == 0
    assert maybe.count() + rest.count() == 30_000 and maybe.count() < 3300


def test_scores_do_not_depend_on_the_layout(spark):
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    again = docs.unionByName(docs.where("doc_id % 3 = 0"))  # repeated ids are learned from once
    first = {r.doc_id: r.score for r in classify(docs, labels).collect()}
    second = {r.doc_id: r.score for r in classify(again.repartition(7), labels.unionByName(labels).repartition(3)).collect()}
    assert first == second


def plain_scored(text, kind):
    matches = list(re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text))
    out = []
    for m in matches:
        around = text[max(0, m.start() - NEAR) : m.start()] + " " + text[m.end() : m.end() + NEAR]
        bonus = 0.25 if re.search(rf"(?i)\b(?:{kind.words})", around) else 0
        if not re.match("(000|666|9..)|.*-00-|.*-0000$", m[0]) and kind.score + bonus >= kind.least:
            out.append((m.start(), m.end()))
    return out


def test_context_of_neighbouring_matches_and_time_in_proportion(spark):
    r = random.Random(2)
    parts = ["ssn ", "123-45-6789", " ", ", ", "666-11-1111", "x" * 35, "tax office ", "321-54-9876", "\n", "é" * 20]
    texts = ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kind = next(k for k in KINDS if k.name == "ssn")
    for row in find_personal_data(rows).collect():
        assert [(s.start, s.end) for s in row.spans if s.kind == "ssn"] == plain_scored(texts[row.doc_id], kind)
    find = lambda n: find_personal_data(spark.createDataFrame([(1, "ab@cd.example.org, " * n)], "doc_id long, text string")).select(F.size("spans")).first()[0]
    assert find(10) == 10
    begin = time.time()
    assert find(50_000) == 50_000
    assert time.time() - begin < 60


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_are_rolled_by_bytes_and_lose_only_the_broken_record(spark, tmp_path, compression):
    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" + "é" * 400 * (k % 7)) for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    write_archives(pages, str(tmp_path / "w"), compression, archive=20_000)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) > 3 and all(p.stat().st_size < 60_000 for p in files)
    back = read_archives(spark, str(tmp_path / "w")).collect()
    assert {r.kind for r in back} == {"record"} and sorted(int(r.page_id) for r in back) == list(range(200))
    assert all(bytes(r.payload).decode() == rows[int(r.page_id)][2] for r in back if r.record_type == "response")
    data = files[0].read_bytes()
    if compression == "gzip":
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") > 5
    found = list(salvage(data))
    broken = data[: found[2]["start"] + 30] + b"\0\0\0\0" + data[found[2]["start"] + 34 :]
    left = list(salvage(broken))
    assert [x["page_id"] for x in left if x["kind"] == "record"] == [x["page_id"] for k, x in enumerate(found) if k != 2]
    assert sum(x["end"] - x["start"] for x in left if x["kind"] == "gap") == found[2]["end"] - found[2]["start"]
