
from pyspark.sql import functions as F

from sievecraft.functions import text as T
from sievecraft.operators import gating as G
from sievecraft.operators import logs as L
from sievecraft.operators import ranking as R
from sievecraft.operators.chunking import chunk_lines, chunks
from sievecraft.operators.graph import connected, folder_units, walk
from sievecraft.plans import batches as B
from sievecraft.queries import records as Q
from sievecraft.sources import records as S
from sievecraft.streaming import state as ST


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_tokens_and_keys(spark):
    assert one(spark, T.tokens(F.col("t")), t="The Bills, pass a class; 42 x's!") == ["the", "bill", "pass", "class", "42"]
    assert one(spark, T.question_key(F.col("t")), t="  What IS\tthis ?! ") == "what is this"
    assert one(spark, T.claim_key(F.col("t")), t="Rate < 50%. ") == "rate < 50%"
    assert one(spark, T.phrase_key(F.col("t")), t="Don't--stop now") == "don t stop now"
    assert one(spark, T.claims(F.col("t")), t="[BOARD: x y z w]\nShort one. This has four words! And so has this.") == ["This has four words!", "And so has this."]


def test_redaction_kinds_and_exemptions(spark):
    key = "xY3" * 11
    text = f"sk-abcdefghijklmno ghp_abcdefghijkl1 Bearer abcdefgh12 {'a1' * 20} {key} /x/{key}/y my-long-identifier-of-short-words-1 authorization: zz"
    got = one(spark, T.redacted(F.col("t")), t=text)
    assert got.text == f"[REDACTED:openai-key] [REDACTED:github-token] [REDACTED:bearer-token] {'a1' * 20} [REDACTED:api-key] /x/{key}/y my-long-identifier-of-short-words-1 [REDACTED:authorization]"
    assert dict(zip(T.REDACTED_KINDS, got.counts, strict=True))["api-key"] == 1


def test_blocked_paths(spark):
    rows = [("/a/.env", True), ("/a/Secrets/x", True), ("/a/ok.md", False), ("/a/tokenizer.py", True), ("/safe/.env", False), (None, False)]
    got = spark.createDataFrame(rows, "p string, want boolean").select("want", T.is_blocked_path(F.col("p"), ("/safe",)).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_prefilter_prefers_utterances_and_avoids_negatives(spark):
    rows = [(f"d{k}", k, f"filler words number {k}", None, None) for k in range(6)]
    rows += [("plain", 6, "merge the branch", None, None), ("said", 7, "x y", ["merge branch"], None), ("not", 8, "merge branch", None, ["merge branch"])]
    catalog = spark.createDataFrame(rows, "id string, pos int, text string, utterances array<string>, negatives array<string>")
    got = [r.id for r in R.prefilter(catalog, "merge branches", 2).collect()]
    assert set(got) == {"said", "plain"}
    assert R.prefilter(catalog, "x", 0).count() == len(rows)


def test_gate_order(spark):
    passes = [
        ("a", 1, True, False, "x", 0.9, 0.9), ("a", 2, True, False, "x", 0.8, None), ("b", 1, True, False, "x", 0.9, 0.9), ("b", 2, True, False, "y", 0.99, 0.99), ("c", 1, True, False, "x", 0.9, 0.5),
        ("d", 1, False, False, None, None, None), ("e", 1, True, True, None, None, None), ("f", 1, True, False, "none", 0.9, 0.9), ("g", 1, True, False, "x", 0.5, 0.5), ("h", 1, True, False, "x", 0.9, 0.9),
        ("i", 1, True, False, "x", 0.9, 0.9), ("i", 2, False, False, None, None, None),
    ]
    records = [(k, "missing" if k in "hj" else None) for k in "abcdefghijk"]
    got = G.outcomes(spark.createDataFrame(records, "id string, evidence_problem string"), spark.createDataFrame(passes, "id string, pass int, answered boolean, malformed boolean, value string, confidence double, peak double"), abstain="none")
    assert {r.id: r.kind for r in got.collect()} == {
        "a": "accepted", "b": "review", "c": "review", "d": "unanswered", "e": "failed_validation", "f": "abstain", "g": "review", "h": "insufficient_evidence", "i": "review", "j": "insufficient_evidence", "k": "unanswered",
    }


def test_next_fit_and_priority(spark):
    assert one(spark, B.next_fit(F.col("s"), 2, 10), s=[4, 5, 3, 11, 8, 1]) == [0, 0, 1, -1, 2, 2]
    assert one(spark, B.fit_by_priority(F.col("s"), 10), s=[6, 5, 4, 1]) == [True, False, True, False]


def test_limiter_and_runs_batch_equals_stream(spark, tmp_path):
    requests = [("k", i, float(at), ok) for i, (at, ok) in enumerate([(0, True), (100, True), (600, True), (1200, False), (1300, True), (1320, True), (1920, True), (2520, True), (3120, True), (3600, True), (3720, True)])]
    batch = L.admissions(spark.createDataFrame(requests, "key string, seq long, at double, ok boolean"), "key")
    want = {r.seq: r.verdict for r in batch.collect()}
    assert [want[i] for i in range(11)] == ["admitted", "cooldown", "admitted", "admitted", "cooldown", "admitted", "admitted", "admitted", "admitted", "cooldown", "admitted"]
    for part, rows in enumerate((requests[:5], requests[5:])):
        spark.createDataFrame(rows, "key string, seq long, at double, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert part < 2
    stream = spark.readStream.schema("key string, seq long, at double, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ST.admissions(stream).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r.seq: r.verdict for r in spark.table("verdicts").collect()} == want

    log = [("q", 1, "lookup", "a", False), ("q", 2, "lookup", "a", True), ("q", 3, "lookup", "a", False), ("q", 4, "miss", None, False), ("q", 5, "lookup", "b", False), ("q", 6, "lookup", "b", False)]
    got = L.current_runs(spark.createDataFrame(log, "key string, seq long, kind string, winner string, partial boolean"), "key", ["seq"]).first()
    assert (got.winner, got.wins) == ("b", 2)


def test_chunks(spark):
    text = "intro line\n\n# A\n" + "one two three\n" * 3 + "### C\nend"
    assert [c[:3] for c in chunk_lines(text, 6)] == [(1, 2, ""), (3, 4, "A"), (5, 6, "A"), (7, 8, "A >  > C")]
    got = chunks(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id long, text string"), 6).collect()
    assert [(r.doc_id, r.idx) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3)]


def test_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {r.id: r.depth for r in walk(spark.createDataFrame([("a",)], "root string"), links, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    members = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (9, "z")], "member long, key string")
    assert {r.member: r.group for r in connected(members).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}
    files = spark.createDataFrame([(f"t/a/{k}", "t") for k in range(5)] + [("t/a/b/x", "t"), ("t/c/y", "t")], "path string, top string")
    assert {r.path: r.unit for r in folder_units(files).collect()}["t/a/b/x"] == "t/a"


def test_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1", "text": "a"}\n\n{"text": "b", "meta": {"k": 1}}\n')
    assert [(r.id, r.text) for r in S.read_records(spark, str(tmp_path / "r.jsonl")).collect()] == [("1", "a"), (None, "b")]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n')
    try:
        S.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
        raise AssertionError("a record without text was taken")
    except Exception as e:
        assert "has no text" in str(e)
    (tmp_path / "c.jsonl").write_text('{"text": "x"}\n{"id": "n", "text": "y", "utterances": ["u"]}\n')
    assert [(r.id, r.utterances) for r in S.read_catalog(spark, str(tmp_path / "c.jsonl")).orderBy("pos").collect()] == [("record_0", None), ("n", ["u"])]
    (tmp_path / "d.tsv").write_text("c1\tv\ttrue\nc2\tv\tfalse\nc1\tw\tfalse\n")
    assert {r.case_id: (r.verdict, r.decision) for r in S.read_decisions(spark, str(tmp_path / "d.tsv")).collect()} == {"c1": ("w", "false"), "c2": ("v", "false")}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.md").write_text("hello")
    (tmp_path / "f" / "b.md").write_bytes(b"\xff\xfe")
    assert {r.path[-4:]: r.disposition for r in S.read_files(spark, str(tmp_path / "f")).collect()} == {"a.md": "admitted", "b.md": "not UTF-8"}
    S.write_run({"plan": spark.range(3)}, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "plan")).count() == 3



def test_folder_units_climb_deep_trees(spark):
    deep = "t/" + "/".join("abcdefghijklmnopqr")
    files = spark.createDataFrame([(f"t/{k}", "t") for k in range(5)] + [(f"{deep}/x", "t"), (f"{deep}/y", "t")], "path string, top string")
    assert {r.unit for r in folder_units(files).collect()} == {"t"}


def test_connected_settles_on_long_chains(spark):
    n = 300  # members in a shuffled order, each sharing a key with the next
    names = [k * 127 % n for k in range(n)]
    rows = [(m, f"k{i}") for i, m in enumerate(names)] + [(m, f"k{i + 1}") for i, m in enumerate(names)] + [(1000, "z"), (1001, "z")]
    rows += [(m, f"q{i}") for i, m in enumerate(range(2000, 2300))] + [(m, f"q{i + 1}") for i, m in enumerate(range(2000, 2300))]
    got = {r.member: r.group for r in connected(spark.createDataFrame(rows, "member long, key string")).collect()}
    assert got == {m: 0 for m in names} | {1000: 1000, 1001: 1000} | {m: 2000 for m in range(2000, 2300)}


def test_connected_whole_reads_all_of_lineitem(spark):
    sf = "/root/testdata/sf0.001"
    group = {}
    of_key = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        group.setdefault(r.l_suppkey, r.l_suppkey)
        of_key.setdefault(r.l_partkey, set()).add(r.l_suppkey)
    for members in of_key.values():
        old = {group[m] for m in members}
        group = {m: min(old) if g in old else g for m, g in group.items()}
    assert {r.member: r.group for r in Q.d7_connected(spark, sf).collect()} == group


def test_phrase_hits_carry_no_texts(spark, monkeypatch):
    import random

    from sievecraft.operators import relational as J

    r = random.Random(8)
    texts = [(k, " ".join(r.choice(["ab", "cde", "f", "ghij"]) for _ in range(30))) for k in range(20)]
    phrases = [(k, " ".join(r.choice(["ab", "cde", "f", "ghij"]) for _ in range(r.randint(1, 5)))) for k in range(40)]
    want = {(t, p, phrase) for t, text in texts for p, phrase in phrases if f" {phrase} " in f" {text} "}
    a, b = spark.createDataFrame(texts, "request_id int, text string"), spark.createDataFrame(phrases, "id int, phrase string")
    for few in (2_000, 0):
        monkeypatch.setattr(J, "FEW_PHRASES", few)
        hits = J.phrase_hits(a, b)
        assert {tuple(x) for x in hits.collect()} == want and "posexplode(w" not in hits._jdf.queryExecution().analyzed().toString()
