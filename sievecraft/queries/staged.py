"""Queries over searches in stages, catalogs from files, and test output."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.operators import cascade as C
from sievecraft.queries.documents import table
from sievecraft.queries.evaluation import d, digit
from sievecraft.queries.holding import SQL_PATHS, _paths


def _zoom(spark, sf_dir):
    """Two questions over the folders of pages: scores of folders, word scores of files, and the best files as hits."""
    q = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("q")
    rows = _paths(spark, sf_dir).select(q, F.split("path", "/")[0].alias("folder"), F.concat("path", F.lit("-"), F.col("id").cast("string")).alias("path"))
    key = F.concat("q", "path")
    words = rows.withColumn("score", digit("w", key, 500) / F.lit(10.0)).where("score > 20")
    folders = rows.select("q", "folder").distinct().withColumn("score", digit("f", F.concat("q", "folder"), 100) / F.lit(100.0))
    hits = words.where("score >= 49").withColumn("rank", digit("r", key, 1000))
    return rows, words, folders, hits


def r10_zoom_folders(spark, sf_dir):
    _, words, folders, hits = _zoom(spark, sf_dir)
    return C.zoom_folders(folders, words, hits, 5)


def r10_zoom_pool(spark, sf_dir):
    """The pool: hits, then a file of each kept folder in turn."""
    rows, words, folders, hits = _zoom(spark, sf_dir)
    nth = rows.withColumn("nth", digit("n", F.concat("q", "path"), 30))
    return C.zoom_pool(C.zoom_folders(folders, words, hits, 5), nth, hits.select("q", "path", "rank"), 25)


SQL_ZOOM = f"""
    p AS ({SQL_PATHS}), x AS (SELECT q, string_split(path, '/')[1] AS folder, path || '-' || id AS path FROM p, (VALUES ('a'), ('b')) v(q)),
    w AS (SELECT *, {d('w', '(q || path)', 500)} / 10.0 AS score FROM x WHERE {d('w', '(q || path)', 500)} > 200), h AS (SELECT *, {d('r', '(q || path)', 1000)} AS rank FROM w WHERE score >= 49),
    b AS (SELECT q, folder, max(score / best) AS word FROM w JOIN (SELECT q, max(score) AS best FROM w GROUP BY q) USING (q) GROUP BY q, folder),
    f AS (SELECT q, folder, round(0.5 * {d('f', '(q || folder)', 100)} / 100.0 + 0.5 * coalesce(word, 0), 9) AS fused FROM (SELECT DISTINCT q, folder FROM x) LEFT JOIN b USING (q, folder)),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, folder) AS place FROM f), k AS (SELECT * FROM r WHERE place <= 5 OR (q, folder) IN (SELECT (q, folder) FROM h))"""


def r12_retrieval(spark, sf_dir):
    """Every source's name as a request over all sources and turns of conversations as chunks, with made-up scores, states and judgements."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("request")).distinct()
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("idx"))
    # each source of the table is asked for by one request at least, and by the requests whose digits meet its own
    own = turns.select("source").distinct().withColumn("home", digit("home", F.col("source"), 20)).select("source", F.explode(F.array_distinct(F.array("home", digit("more", F.col("source"), 20)))).alias("slot"))
    slots = names.select("request", F.regexp_extract("request", "([0-9]+)$", 1).cast("long").alias("slot"))
    pairs = slots.join(own, "slot").select("request", "source")
    key = F.concat_ws("/", "request", F.col("source").cast("string"))
    described = pairs.select("request", "source", (digit("s", key, 4) / F.lit(4.0)).alias("score"), (digit("c", key, 90) / F.lit(100.0)).alias("confidence"), (digit("ok", F.col("request"), 11) > 0).alias("complete"))
    chunk = F.concat_ws("/", "request", F.col("source").cast("string"), F.col("idx").cast("string"))
    chunks = pairs.join(turns, "source").select("request", "source", "idx", (digit("bm", chunk, 900) / F.lit(10.0)).alias("score"))
    states = turns.select("source", "idx", F.when(digit("st", F.concat_ws("/", "source", "idx"), 40) == 0, "stale").otherwise("ok").alias("state"))
    stage = F.explode(F.array(F.lit("narrow"), F.lit("wide"), F.lit("neighbours"))).alias("stage")
    judged = F.concat_ws("/", "request", F.col("source").cast("string"), "stage")
    answers = pairs.select("request", "source", stage).select("request", "stage", "source", F.when(digit("fit", judged, 30) == 0, 1.0).otherwise(0.5).alias("fit"), ((digit("jc", judged, 60) + 40) / F.lit(100.0)).alias("confidence"), (digit("jk", F.concat("request", "stage"), 9) > 0).alias("complete"))
    return C.retrieval(described, chunks, states, answers)


SQL_TOP = lambda rows: f"(SELECT request, source, idx FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, source, idx) AS k FROM {rows} WHERE score > 0) WHERE k <= 4)"


def _retrieval_sql() -> str:
    stages = (("narrow", "n"), ("wide", "w"), ("neighbours", "a"))
    gates = ", ".join(
        f"g{s} AS (SELECT request, max(struct_pack(c := confidence, m := -source)) FILTER (fit = 1 AND confidence >= 0.6) AS best FROM j WHERE stage = '{name}' GROUP BY request), e{s} AS (SELECT request, bool_or(st <> 'ok') AS pending FROM {s} JOIN s USING (source, idx) GROUP BY request)" for name, s in stages
    )
    cases = " ".join(
        f"WHEN coalesce(e{s}.pending, false) THEN 'preparation-required/{name}' WHEN {d('jk', f'''(b.request || '{name}')''', 9)} = 0 THEN 'refused/{name}' WHEN g{s}.best IS NOT NULL THEN 'ready/{name}'" for name, s in stages
    )
    taken = " ".join(f"WHEN 'ready/{name}' THEN -(g{s}.best).m" for name, s in stages)
    return f"""
    WITH q AS (SELECT DISTINCT source AS request FROM documents),
    i AS (SELECT DISTINCT conv_id AS source FROM conversations), o AS (SELECT source, {d('home', 'source', 20)} AS slot FROM i UNION SELECT source, {d('more', 'source', 20)} FROM i),
    p AS (SELECT request, source FROM q JOIN o ON slot = CAST(regexp_extract(request, '([0-9]+)$', 1) AS BIGINT)),
    e AS (SELECT *, request || '/' || source AS k FROM p), b AS (SELECT request, {d('ok', 'request', 11)} > 0 AS complete FROM q),
    l AS (SELECT request, source FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {d('s', 'k', 4)} DESC, {d('c', 'k', 90)} DESC, source) AS n FROM e) WHERE n <= 3),
    c AS (SELECT request, source, turn AS idx, {d('bm', "(request || '/' || source || '/' || turn)", 900)} / 10.0 AS score FROM p JOIN conversations ON conv_id = source),
    s AS (SELECT conv_id AS source, turn AS idx, CASE WHEN {d('st', "(conv_id || '/' || turn)", 40)} = 0 THEN 'stale' ELSE 'ok' END AS st FROM conversations),
    n AS {SQL_TOP('(SELECT c.* FROM c JOIN l USING (request, source))')}, w AS {SQL_TOP('c')},
    a AS (SELECT DISTINCT c.request, c.source, c.idx FROM c JOIN w ON w.request = c.request AND w.source = c.source AND abs(w.idx - c.idx) <= 1),
    j AS (SELECT request, source, stage, CASE WHEN {d('fit', "(request || '/' || source || '/' || stage)", 30)} = 0 THEN 1 ELSE 0 END AS fit, ({d('jc', "(request || '/' || source || '/' || stage)", 60)} + 40) / 100.0 AS confidence FROM p, (VALUES ('narrow'), ('wide'), ('neighbours')) v(stage)),
    {gates},
    t AS (SELECT b.request, CASE WHEN NOT complete THEN 'refused/descriptions' WHEN b.request NOT IN (SELECT request FROM n) THEN 'no-match/narrow' {cases} ELSE 'no-match/end' END AS t, gn.best AS bn, gw.best AS bw, ga.best AS ba
          FROM b LEFT JOIN gn USING (request) LEFT JOIN gw USING (request) LEFT JOIN ga USING (request) LEFT JOIN en USING (request) LEFT JOIN ew USING (request) LEFT JOIN ea USING (request))
    SELECT request, string_split(t, '/')[1] AS status, string_split(t, '/')[2] AS stage, CAST(CASE t {taken.replace('(gn.best)', 'bn').replace('(gw.best)', 'bw').replace('(ga.best)', 'ba')} END AS BIGINT) AS source FROM t"""


FILES = (
    "---\nname: x\ndescription: Merge branches, safely.\n---\nTriggers: \"Merge it\", `land it` or /merge-now and /merge-now.\n",
    "---\ndescription: |\n  Reads the\n  logs; all of them\nother: y\n---\n**Use when**: \"why did it fail?\" \"WHY did it fail?\"\nUse when:\n",
    "no front matter\nTrigger: /go \"go on.\"\n",
    "---\ndescription: 'Quoted: text'\n---\n",
)


def s4_catalog_records(spark, sf_dir):
    """Made-up skill files of four shapes, one for each part."""
    key = F.col("p_partkey")
    text = F.element_at(F.array(*map(F.lit, FILES)), digit("file", key, 4) + 1)
    rows = C.catalog_records(table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), key.cast("string")).alias("folder"), text.alias("text")))
    return rows.select("id", "text", F.array_join("utterances", "|").alias("utterances"))


def f20_test_counts(spark, sf_dir):
    """What made-up outputs of test runs tell."""
    outputs = ("x\n== 3 failed, 12 passed in 2s ==\n", "collected 9 items\n9 passed", "ok  pkg 1.2s", "Ran 4 tests in 1s\nOK", "ℹ tests 7\nℹ pass 6\nℹ fail 1", "nothing ran", "5 passed\n6 passed")
    text = F.element_at(F.array(*map(F.lit, outputs)), digit("out", F.col("o_orderkey"), 7) + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.test_counts(text).alias("c")).select("o_orderkey", "c.*")


def r19_first_holder(spark, sf_dir):
    """Documents, pages and items as stores of numbered texts: the first that has a number holds it."""
    store = lambda name, key, value: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(name).alias("store"), F.md5(value).alias("md5"))
    return C.first_holder([store("benchmark", "item_id", "text"), store("pages", "page_id", "html"), store("documents", "doc_id", "text")], "id")


def s12_page(spark, sf_dir):
    """The third page of documents by source and id."""
    return C.page_of(table(spark, sf_dir, "documents").select("source", "doc_id"), [F.col("source"), F.col("doc_id")], 100, 50)


def t5_growth(spark, sf_dir):
    """Events of each user by day as scans, with what each found beyond the one before."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return C.growth(rows, "user_id", "day")


QUERIES = {"r10_zoom_folders": r10_zoom_folders, "r10_zoom_pool": r10_zoom_pool, "r12_retrieval": r12_retrieval, "s4_catalog_records": s4_catalog_records, "f20_test_counts": f20_test_counts, "r19_first_holder": r19_first_holder, "s12_page": s12_page, "t5_growth": t5_growth}
SQL = {
    "r10_zoom_folders": f"WITH {SQL_ZOOM} SELECT q, folder, fused, CAST(place AS INT) AS place FROM k",
    "r10_zoom_pool": f"""WITH {SQL_ZOOM}, t AS (SELECT q, path, 0 AS late, rank AS a, 0 AS b FROM h UNION ALL SELECT x.q, path, 1, {d('n', '(x.q || path)', 30)}, place FROM x JOIN k ON k.q = x.q AND k.folder = x.folder),
        e AS (SELECT q, path, min(struct_pack(late := late, a := a, b := b)) AS at_ FROM t GROUP BY q, path), o AS (SELECT q, path, row_number() OVER (PARTITION BY q ORDER BY at_, path) AS rank FROM e) SELECT q, path, CAST(rank AS INT) AS rank FROM o WHERE rank <= 25""",
    "r12_retrieval": _retrieval_sql(),
    "s4_catalog_records": f"""
        WITH x AS (SELECT 'part-' || p_partkey AS id, {d('file', 'p_partkey', 4)} AS f FROM part)
        SELECT id, (['Merge branches, safely.', 'Reads the logs; all of them', '', 'Quoted: text'])[f + 1] AS text,
               CASE f WHEN 0 THEN 'Merge it|land it|/merge-now|/' || id || '|merge branches safely|Merge branches' WHEN 1 THEN 'why did it fail?|/' || id || '|reads the logs all of them|Reads the logs' WHEN 2 THEN 'go on|/go|/' || id ELSE '/' || id || '|quoted text|Quoted: text' END AS utterances FROM x""",
    "f20_test_counts": f"""
        WITH x AS (SELECT o_orderkey, {d('out', 'o_orderkey', 7)} + 1 AS k FROM orders)
        SELECT o_orderkey, ([15, 9, NULL, NULL, 7, NULL, 6])[k] AS collected, ([12, 9, NULL, NULL, 6, NULL, 6])[k] AS passed, ([3, NULL, NULL, NULL, 1, NULL, NULL])[k] AS failed FROM x""",
    "r19_first_holder": """
        WITH a AS (SELECT item_id AS id, 'benchmark' AS store, md5(text) AS md5 FROM benchmark), b AS (SELECT page_id AS id, 'pages' AS store, md5(html) AS md5 FROM pages), c AS (SELECT doc_id AS id, 'documents' AS store, md5(text) AS md5 FROM documents)
        SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT * FROM c WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b)""",
    "s12_page": "SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 50 OFFSET 100",
    "t5_growth": """
        WITH x AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL)
        SELECT user_id, day, n, n - coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY day), 0) AS added FROM x""",
}
