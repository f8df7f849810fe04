"""Queries over organising, costs, packs and rank checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.operators import gating as G
from sievecraft.operators import ranking as R
from sievecraft.plans import batches as B
from sievecraft.queries.documents import table
from sievecraft.queries.evaluation import d, digit


def a7_organised(spark, sf_dir):
    key = F.col("doc_id")
    category = F.when(digit("cat", key, 9) == 0, "other").otherwise(F.col("lang"))
    return G.organised(table(spark, sf_dir, "documents").select(category.alias("category"), key.alias("id"), ((digit("c", key, 50) + 51) / F.lit(100.0)).alias("confidence")))


def a3_costs(spark, sf_dir):
    key = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(
        "event_type", F.when(digit("i", key, 9) > 0, digit("i", key, 900)).alias("input_tokens"), digit("o", key, 90).alias("output_tokens"), digit("r", key, 3).alias("retries"), (digit("e", key, 5000) == 0).alias("estimated")
    )
    return G.costs(calls, "event_type")


def b7_pack_groups(spark, sf_dir):
    """Packs over the documents of each source, which is a folder here."""
    return B.pack_groups(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 4, 900)


def p26_file_scores(spark, sf_dir):
    key = F.col("doc_id")
    best, none = digit("b", key, 100) / F.lit(100.0), digit("n", key, 30) / F.lit(100.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(R.file_score(best, none, digit("p", key, 4)), 6).alias("score"))


def w7_tightest(spark, sf_dir):
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("source", key.alias("id"), (digit("s", key, 100) / F.lit(100.0)).alias("score"), F.size(F.split("text", "\n")).alias("span"))
    return R.tightest_near_top(rows, ["source"])


def r15_gold_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), "o_totalprice")
    ranked = R.ranked(rows, ["q"], [F.desc("o_totalprice"), F.col("id")])
    gold = rows.where("id % 7 = 0").select("q", "id").unionByName(rows.where("id % 11 = 0").select("q", (-F.col("id")).alias("id")))
    return R.gold_ranks(ranked.where("rank <= 5").select("q", "id", "rank"), gold, "q")


QUERIES = {"a7_organised": a7_organised, "a3_costs": a3_costs, "b7_pack_groups": b7_pack_groups, "p26_file_scores": p26_file_scores, "w7_tightest": w7_tightest, "r15_gold_ranks": r15_gold_ranks}
SQL = {
    "a7_organised": f"""
        WITH x AS (SELECT doc_id AS id, CASE WHEN {d('cat', 'doc_id', 9)} = 0 THEN 'other' ELSE lang END AS category, ({d('c', 'doc_id', 50)} + 51) / 100.0 AS confidence FROM documents)
        SELECT CASE WHEN confidence < 0.75 OR category = 'other' THEN 'review' ELSE category END AS bucket, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM x GROUP BY 1""",
    "a3_costs": f"""
        SELECT event_type, count(*) AS calls, CAST(sum(CASE WHEN {d('i', 'event_id', 9)} > 0 THEN {d('i', 'event_id', 900)} ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum({d('o', 'event_id', 90)}) AS BIGINT) AS output_tokens,
               CAST(sum({d('r', 'event_id', 3)}) AS BIGINT) AS retries, bool_or({d('e', 'event_id', 5000)} = 0) AS estimated FROM events GROUP BY event_type""",
    "b7_pack_groups": """
        WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE length(text) <= 900),
        f(conv_id, turn, k, size, call, n, used) AS (
          SELECT conv_id, turn, k, size, 0, 1, size FROM r WHERE k = 1
          UNION ALL SELECT r.conv_id, r.turn, r.k, r.size, CASE WHEN n >= 4 OR used + r.size > 900 THEN call + 1 ELSE call END, CASE WHEN n >= 4 OR used + r.size > 900 THEN 1 ELSE n + 1 END,
                           CASE WHEN n >= 4 OR used + r.size > 900 THEN r.size ELSE used + r.size END FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
        SELECT conv_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, min(turn) AS first, max(turn) AS last FROM f GROUP BY conv_id, call HAVING count(*) > 1""",
    "p26_file_scores": f"""
        WITH x AS (SELECT doc_id, {d('b', 'doc_id', 100)} / 100.0 AS b, {d('n', 'doc_id', 30)} / 100.0 AS n, {d('p', 'doc_id', 4)} AS p FROM documents), y AS (SELECT *, b + 0.5 * (1 - n - b) AS s FROM x)
        SELECT doc_id, round(CASE WHEN p < 2 OR b < 0.6 THEN b WHEN b >= 0.85 THEN greatest(b, s) ELSE least(greatest(b, s), 0.84) END, 6) AS score FROM y""",
    "w7_tightest": f"""
        WITH x AS (SELECT source, doc_id AS id, {d('s', 'doc_id', 100)} / 100.0 AS score, len(string_split(text, chr(10))) AS span FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY span, score DESC, id) AS k FROM (SELECT *, max(score) OVER (PARTITION BY source) AS best FROM x) WHERE round(best - score, 9) <= 0.02)
        SELECT source, id, CAST(span AS INT) AS span FROM r WHERE k = 1""",
    "r15_gold_ranks": """
        WITH r AS (SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
        g AS (SELECT q, id FROM r WHERE id % 7 = 0 UNION ALL SELECT q, -id FROM r WHERE id % 11 = 0)
        SELECT g.q, CAST(min(rank) AS INT) AS rank FROM g LEFT JOIN (SELECT * FROM r WHERE rank <= 5) t ON t.q = g.q AND t.id = g.id GROUP BY g.q""",
}
