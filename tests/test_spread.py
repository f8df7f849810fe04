"""Steps whose tasks hold no more when their input grows."""

import random

from pyspark.sql import functions as F

from sievecraft.operators import graph, relational, search_index, windows
from sievecraft.queries.evidence_windows import p31_lines


def test_windows_are_dealt_by_the_size_of_their_texts(spark, monkeypatch):
    text = "[current turn]\na\n\n---\n\nb\n\n===\n\n[contributed by check arms]\n> c"
    rows = spark.createDataFrame([(f"{k}", text) for k in range(60)] + [("none", None), ("empty", "")], "window_id string, text string")
    want = sorted(map(repr, windows.window_lines(rows).collect()))
    monkeypatch.setattr(windows, "TEXT_OF_TASK", 10 * len(text), raising=False)
    lines = windows.window_lines(rows)
    # AQE is told a number of partitions and doesn't change it
    assert lines.rdd.getNumPartitions() == 6
    assert sorted(map(repr, lines.collect())) == want and len(want) == 60 * text.count("\n") + 60


def test_lines_of_windows_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, 1, "user", "a\nb")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = p31_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_coverage_joins_only_what_a_set_lacks(spark, monkeypatch):
    # a path that all sets hold, one of another set, one of nobody, and rows of null names
    held = [(f"s{k}", 1) for k in range(40)] + [("s1", 2), ("s3", 2), (None, 3), ("s0", None)]
    expected = [(f"s{k}", 1) for k in range(40)] * 2 + [("s0", 2), ("s1", 2), ("s2", 3), ("s4", None), (None, 2), (None, 4)]
    kind = "set string, path long"
    dealt, spread = [], relational.spread
    monkeypatch.setattr(relational, "PAIRS_OF_TASK", 10)
    monkeypatch.setattr(relational, "spread", lambda *a: dealt.append(spread(*a)) or dealt[-1])
    got = {r.set: (r.complete, r.borrows) for r in relational.coverage(spark.createDataFrame(expected, kind), spark.createDataFrame(held, kind)).collect()}
    want = {f"s{k}": (True, "") for k in range(40)} | {"s0": (True, "s1,s3"), "s2": (False, ""), "s4": (False, ""), None: (False, "")}
    assert got == want
    assert dealt[0].rdd.getNumPartitions() == -(-(len(expected) + len(held) - 2) // 10)


def test_rounds_of_connected_pass_over_links_and_not_over_all_rows(spark, monkeypatch):
    # every key lists all members of its class: 2 classes of 10 members, 60 keys each, besides a chain through keys of two members, against the order of their ids
    full = [(10 * c + m, f"{c}/{k}") for c in range(2) for k in range(60) for m in range(10)]
    chain = [(100 - k + d, f"chain/{k}") for k in range(4) for d in (0, 1)]
    rows = spark.createDataFrame(full * 2 + chain + [(7, None), (500, None), (501, "alone")], "member long, key string")
    sizes, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: sizes.append((done := cut(df)).count()) or done)
    got = {r.member: r.group for r in graph.connected(rows).collect()}
    assert got == {m: m // 10 * 10 for m in range(20)} | dict.fromkeys(range(97, 102), 97) | {501: 501}
    assert max(sizes) <= 2 * len(got)


def test_connected_ends_where_members_are_null(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (None, "x"), (None, "nobody")], "member long, key string")
    assert {r.member: r.group for r in graph.connected(rows).collect()} == {1: 1, 2: 1}


def test_postings_are_counted_in_the_row_of_their_file(spark):
    texts = {"a": "One two, one\ntwo ONE 3", "b": None, "c": "", "d": " ,; ", "e": "x", "f": "four 3"}
    files = spark.createDataFrame([(k, "s", None, k, t, 1) for k, t in texts.items()], "path string, set string, person string, sha string, text string, passages int")
    index = search_index.index_files(files)
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    want = {("a", "one", 3), ("a", "two", 2), ("a", "3", 1), ("e", "x", 1), ("f", "four", 1), ("f", "3", 1)}
    assert sorted(map(tuple, index.postings.collect())) == sorted(want)
    new = search_index.updated(index, files.where("path = 'a'").withColumn("text", F.lit("two five")), files.where("path = 'f'"))
    assert {tuple(r) for r in search_index.vocabulary(new.postings).collect()} == {("x", 1), ("two", 1), ("five", 1)}
    # files that changed or went are left out before their words are made
    below = new.postings._jdf.queryExecution().optimizedPlan().toString()
    assert below.index("Generate") < below.index("LeftAnti")


def test_coverage_hands_on_lists_and_no_row_for_each_holder(spark, monkeypatch):
    # 30 paths of 20 holders, which 10 other sets lack
    held = [(f"h{k}", path) for path in range(30) for k in range(20)]
    expected = held + [(f"l{k}", path) for path in range(30) for k in range(10)]
    sizes, cut = [], relational.cut
    monkeypatch.setattr(relational, "cut", lambda df: sizes.append((done := cut(df)).count()) or done)
    kind = "set string, path long"
    rows = relational.coverage(spark.createDataFrame(expected, kind), spark.createDataFrame(held, kind))
    got = {r.set: (r.complete, r.borrows) for r in rows.collect()}
    assert got == {f"h{k}": (True, "") for k in range(20)} | {f"l{k}": (True, ",".join(sorted(f"h{j}" for j in range(20)))) for k in range(10)}
    assert sum(sizes) <= 30


def test_coverage_of_paths_with_several_lists_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(relational, "SETS_OF_LIST", 4, raising=False)
    r = random.Random(5)
    draw = lambda n: [(r.choice([None, *(f"s{k}" for k in range(30))]), r.choice([None, 1, 1, 1, *range(2, 12)])) for _ in range(n)]
    for size in (20, 150, 600):
        expected, held = draw(size), draw(size)
        holders = {}
        for s, path in held:
            if s is not None and path is not None:
                holders.setdefault(path, set()).add(s)
        want = {}
        for s in {s for s, _ in expected}:
            paths = {path for x, path in expected if x == s}
            others = {h for path in paths for h in holders.get(path, ()) if s not in holders[path]}
            want[s] = (all(holders.get(path) for path in paths), ",".join(sorted(others)) if s is not None else "")
        kind = "set string, path long"
        rows = relational.coverage(spark.createDataFrame(expected, kind), spark.createDataFrame(held, kind)).collect()
        assert {x.set: (x.complete, x.borrows) for x in rows} == want and len(rows) == len(want)
