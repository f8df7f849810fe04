"""The queries that keep every input row, against their SQL; the small tables hold all their cases."""

import duckdb
import pytest

import __spark_entry__
from sievecraft.operators import relational as J
from sievecraft.sources import records as S

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations", "orders", "lineitem", "events", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    assert rows and rows == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["j18_coverage", "j20_neighbours", "j14_without_views", "j1_mapping", "j4_manifest", "j17_snapshot_changes", "p6_outcomes", "a14_trace_counts"])
def test_whole_inputs(spark, name):
    same_as_sql(spark, name)


@pytest.mark.parametrize("name", ["j13_duplicate_utterances", "j12_negative_collisions", "p28_leaking_identities"])
def test_all_lines(spark, name):
    same_as_sql(spark, name)


def test_hot_phrases_cost_a_row_each(spark):
    rows = [(i, ["one", "two", "Hot  line"], ["hot line"]) for i in range(60)] + [(60, ["only", "twice", "x"], ["only"]), (61, ["a", "b", "c", "x"], ["lone"])]
    members = J.phrase_members(spark.createDataFrame(rows, "id long, utterances array<string>, negatives array<string>"))
    hits = J.colliding_members(members).collect()
    assert sorted((r.phrase, r.id, r.role) for r in hits) == sorted(("hot line", i, role) for i in range(60) for role in ("utterance", "negative"))
    assert {(r.owners, r.first_owner, r.deniers, r.first_denier) for r in hits} == {(60, 0, 60, 0)}
    shared = J.shared_utterances(members).collect()
    assert len(shared) == 182 and {r.id for r in shared if r.phrase == "x"} == {60, 61}


def test_beam_grows_from_the_front(spark):
    same_as_sql(spark, "r9_beam")
    plan = __spark_entry__.queries()["r9_beam"](spark, SF)._jdf.queryExecution().toString()
    assert "Cross" not in plan and "Cartesian" not in plan


def test_answers_with_a_value_above_one_fail_by_their_total(spark, tmp_path):
    from sievecraft.queries.evaluation import p3_answer_problems

    spark.createDataFrame([(14896, "x"), (17381, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.kind, r.problem) for r in p3_answer_problems(spark, str(tmp_path)).collect()} == {(14896, "choice", "total"), (17381, "score", "total")}


def test_arrow_batches_are_bounded_by_their_bytes(spark, tmp_path):
    from sievecraft.queries.documents import BATCH_BYTES, table

    spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 5000) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    counts = [r.n for r in table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long").collect()]
    assert sum(counts) == 3000 and max(counts) * 5000 < 2 * BATCH_BYTES


def odd_documents_as_sql(spark, folder, name, documents):
    """The query over documents (text, lang), each with many ids, equals its SQL."""
    rows = [(k * len(documents) + i, text, lang, "src1", 0) for k in range(20) for i, (text, lang) in enumerate(documents)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(folder)).select(*[c[0] for c in want.description])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_documents_without_text_are_records_too(spark, tmp_path):
    odd_documents_as_sql(spark, tmp_path, "s1_read_records", [(None, "en"), ("", "en"), ("  ", "de"), ("a\r\nb\0", None), (None, None)])


def test_long_texts_are_records_too(spark, tmp_path):
    text = "x" * 20_000_001
    S.write_run({"records": spark.createDataFrame([("1", text)], "id string, text string")}, str(tmp_path / "run"))
    assert [len(r.text) for r in S.read_records(spark, str(tmp_path / "run/records")).collect()] == [len(text)]
    assert [len(r.text) for r in S.read_catalog(spark, str(tmp_path / "run/records")).collect()] == [len(text)]


def test_records_that_are_no_objects_fail(spark, tmp_path):
    for k, line in enumerate(['[{"text": "a"}]', '"text"', '{"text": 5}', '{"text": "a"', '{"text": "a", "id": {"b": 1}}']):
        (tmp_path / f"{k}.jsonl").write_text('{"text": "good"}\n' + line)
        for need_text in (True, False):
            with pytest.raises(Exception, match="a record is not valid JSON or has no text|the id of a record is not a string"):
                S.read_records(spark, str(tmp_path / f"{k}.jsonl"), need_text).count()


@pytest.mark.parametrize("name", ["f15_parts", "f16_pages"])
def test_documents_that_happen_to_be_python_go_by_lines(spark, tmp_path, name):
    texts = ["Word### more%%% of\n# Head it\ny = 2", "def f():\n    pass\n# Two words", '"""Doc."""\n# Head it', "Word\nwords)\nOther", "\t", None, " \n # a\nb　\n## c"]
    odd_documents_as_sql(spark, tmp_path, name, [(text, "en") for text in texts])
