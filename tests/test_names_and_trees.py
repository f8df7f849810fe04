import random

from sievecraft.operators import views as V


def test_callers_and_definers_match_brute_force_in_linear_rows(spark):
    r = random.Random(4)
    parts = [(f"p{r.randrange(40)}", f"fn{r.randrange(8)}") for _ in range(60)]
    calls = [(f"p{r.randrange(60)}", r.randrange(30), f"fn{r.randrange(10)}") for _ in range(200)]
    lines = [(p, n, f"x = {name}(1) + fn0 (2)") for p, n, name in calls]
    got = V.call_sites(spark.createDataFrame(parts, "path string, name string"), spark.createDataFrame(lines, "path string, line int, text string")).collect()
    want = set()
    for path, name in set(parts):
        others = sorted({p for p, _, n in calls if n == name and p != path})
        if others:
            want.add((path, name, "has", None, len(others), others[0]))
    for path, name in {(p, n) for p, _, n in calls}:
        others = sorted({p for p, n in parts if n == name and p != path})
        if others:
            want.add((path, name, "uses", min(k for p, k, n in calls if (p, n) == (path, name)), len(others), others[0]))
    assert {tuple(x) for x in got} == want and len(got) == len(want) and len({x.other for x in got}) > 2
    hot = spark.range(300).selectExpr("concat('h', id) AS path", "'hot' AS name")
    assert V.call_sites(hot, hot.selectExpr("path", "1 AS line", "'hot()' AS text")).count() == 600


def test_named_files(spark):
    names = spark.createDataFrame([("a", "note.md"), ("b", "x.md")], "path string, name string")
    lines = spark.createDataFrame([("c", 3, " see note.md, not xx.md. "), ("c", 2, "in note.md"), ("a", 1, "note.md")], "path string, line int, text string")
    assert {tuple(x) for x in V.named_in(names, lines).collect()} == {("a", "note.md", "has", None, None, 1, "c"), ("c", "note.md", "uses", 2, "in note.md", 1, "a")}


def test_deep_trees_are_walked_to_their_end(spark):
    nodes = [("n0", None)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 70)] + [("x", "y"), ("y", "x"), ("z", "nowhere")]
    faults = V.tree_faults(spark.createDataFrame(nodes, "id string, parent string")).collect()
    assert sorted(tuple(f) for f in faults) == [("x", "not reached"), ("y", "not reached"), ("z", "no such parent"), ("z", "not reached")]


def test_each_caller_meets_each_definer_once_in_any_group(spark, monkeypatch):
    monkeypatch.setattr(V, "DEALT", 3)
    r = random.Random(5)
    parts = [(f"p{r.randrange(40)}", f"fn{r.randrange(8)}") for _ in range(60)]
    calls = [(f"p{r.randrange(60)}", r.randrange(30), f"fn{r.randrange(10)}") for _ in range(200)]
    got = V.caller_pairs(spark.createDataFrame(parts, "path string, name string"), spark.createDataFrame([(p, n, f"x = {name}(1)") for p, n, name in calls], "path string, line int, text string")).collect()
    want = {(path, name, p, min(n for q, n, c in calls if (q, c) == (p, name))) for path, name in set(parts) for p, _, called in calls if called == name and p != path}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_each_namer_meets_each_named_file_once(spark, tmp_path):
    from sievecraft.queries.weighing import j10_named_in

    names = spark.createDataFrame([("a", "note.md"), ("b", "note.md")], "path string, name string")
    lines = spark.createDataFrame([("c", 3, " see note.md, not xx.md. "), ("c", 2, "in note.md"), ("a", 1, "note.md")], "path string, line int, text string")
    assert {tuple(x) for x in V.namer_pairs(names, lines).collect()} == {("a", "note.md", "c", 2, "in note.md"), ("b", "note.md", "c", 2, "in note.md"), ("b", "note.md", "a", 1, "note.md")}
    spark.range(50).selectExpr("id AS conv_id", "0 AS turn").write.parquet(f"{tmp_path}/conversations.parquet")
    assert j10_named_in(spark, str(tmp_path)).columns == ["of", "name", "path", "line", "says"]
