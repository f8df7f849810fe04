"""Queries over checks, drafts and scripted answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.operators import checks as K
from sievecraft.operators import graph
from sievecraft.operators.weighing import plural_forms
from sievecraft.queries.documents import table
from sievecraft.queries.evaluation import d, digit


def d6_draft_clauses(spark, sf_dir):
    """Clauses of turns that are joined with and, colons and repeats of themselves."""
    draft = F.concat_ws(" and ", "text", F.concat(F.lit("I did: this; That"), F.lit(" and "), F.lit("THIS")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", K.draft_clauses(F.translate(draft, "\n", " ")).alias("c"))
    return rows.select("conv_id", "turn", F.size("c").alias("n"), F.md5(F.array_join("c", "|")).alias("clauses_md5"))


def p24_chunk_faults(spark, sf_dir):
    """Turns as chunks with offsets, digests and texts of which some are bad."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    first = F.when(digit("dup", key, 12) == 0, 1).otherwise(F.col("turn") * 2 + 3).cast("long")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), first.alias("first_line"), (first + F.when(digit("off", key, 9) == 0, -1).otherwise(1)).alias("last_line"), F.when(digit("sha", key, 10) == 0, "x").otherwise(F.sha2("text", 256)).alias("sha"), F.when(digit("txt", key, 11) > 0, F.col("text")).alias("text"))
    return K.chunk_faults(rows)


def p24_unasked(spark, sf_dir):
    """Labels as selections of documents, of which some were read amiss."""
    amiss = F.when(digit("amiss", F.col("doc_id"), 9) == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return K.unasked(table(spark, sf_dir, "labels").select(amiss.alias("doc_id")), table(spark, sf_dir, "documents"), ["doc_id"])


def p22_organizer_faults(spark, sf_dir):
    """Documents, which are too many and some of one id, in made-up categories of which one has a bad name."""
    records = table(spark, sf_dir, "documents").select(F.when(digit("id", F.col("doc_id"), 50) > 0, F.col("doc_id").cast("string")).otherwise("same").alias("id"), "text")
    return K.organizer_faults(records, spark.createDataFrame([("complaint", "x"), ("Bad name", "y")], "name string, description string"))


def p27_edited_held(spark, sf_dir):
    """Pages as files of up to three sets."""
    key = F.concat_ws("/", F.col("page_id").cast("string"), F.col("set_rank").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("set_rank"))
    of = lambda salt, n: digit(salt, key, n) == 0
    files = rows.select(F.col("page_id").alias("path"), "set_rank", F.when(digit("gone", F.col("page_id"), 9) > 0, "now").alias("sha"), F.when(of("same", 5), "now").otherwise("then").alias("reviewed_sha"), of("read", 7).alias("readable"), of("sec", 4).alias("secret"), of("stuck", 3).alias("stuck"))
    return K.edited_held(files)


def a24_mismatch_facts(spark, sf_dir):
    """Documents as rows of their source's table, of made-up verdicts."""
    key = F.col("doc_id")
    word = lambda salt, n: F.element_at(F.array(*map(F.lit, ("allow", "ask", "block", "maybe"))), digit(salt, key, n) + 1)
    rows = table(spark, sf_dir, "documents").select("source", word("e", 3).alias("expected"), F.when(digit("m", key, 90) == 0, "maybe").otherwise(word("a", 3)).alias("actual"))
    return K.mismatch_facts(rows.where("expected <> actual"), "source")


def u8_scripted_answers(spark, sf_dir):
    """Labels as a script for all documents."""
    asked = table(spark, sf_dir, "documents").select(F.concat(F.lit("k"), "doc_id").alias("key"), F.col("doc_id").alias("id"))
    script = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("choice"), (digit("c", F.col("doc_id"), 90) / F.lit(100.0)).alias("confidence"))
    rows = K.scripted_answers(asked, script, ["0", "1", "none"])
    return rows.select("key", "choice", "confidence", *[F.round(F.col("probabilities")[o], 6).alias(f"p_{o}") for o in ("0", "1", "none")])


def g1_revisits(spark, sf_dir):
    """Walks over orders, customers and suppliers' nations that lead back: each nation links its region, and each region the nation of its smallest key."""
    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nation = table(spark, sf_dir, "nation")
    links = nation.select(c("n", "n_nationkey").alias("src"), c("r", "n_regionkey").alias("dst")).unionByName(nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")).select(c("r", "n_regionkey").alias("src"), c("n", "k").alias("dst")))
    roots = nation.select(c("n", "n_nationkey").alias("root"))
    return K.revisits(graph.walk(roots, links, 3), links)


def f5_plural_forms(spark, sf_dir):
    """Plain forms of the first word of each part's name."""
    word = F.lower(F.split("p_name", "[^A-Za-z]")[0])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(plural_forms(word), "|").alias("forms"))


QUERIES = {
    "d6_draft_clauses": d6_draft_clauses, "p24_chunk_faults": p24_chunk_faults, "p24_unasked": p24_unasked, "p22_organizer_faults": p22_organizer_faults, "p27_edited_held": p27_edited_held, "a24_mismatch_facts": a24_mismatch_facts,
    "u8_scripted_answers": u8_scripted_answers, "g1_revisits": g1_revisits, "f5_plural_forms": f5_plural_forms,
}
K2 = "(conv_id || '/' || turn)"
K3 = "(page_id || '/' || s)"
SQL = {
    "d6_draft_clauses": rf"""
        WITH t AS (SELECT conv_id, turn, trim(replace(text || ' and I did: this; That and THIS', chr(10), ' ')) AS t FROM conversations),
        u AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), ';\s*|:\s+|\s+and\s+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS u FROM t),
        f AS (SELECT conv_id, turn, list_transform(list_filter(list_zip(u, range(1, len(u) + 1)), lambda z: list_position(list_transform(u, lambda y: lower(y)), lower(z[1])) = z[2]), lambda z: z[1])[1:25] AS c FROM u)
        SELECT conv_id, turn, CAST(len(c) AS INT) AS n, md5(array_to_string(c, '|')) AS clauses_md5 FROM f""",
    "p24_chunk_faults": f"""
        WITH x AS (SELECT conv_id AS source, CASE WHEN {d('dup', K2, 12)} = 0 THEN 1 ELSE turn * 2 + 3 END AS a, {d('off', K2, 9)} = 0 AS o, {d('sha', K2, 10)} = 0 AS s, {d('txt', K2, 11)} = 0 AS t FROM conversations),
        y AS (SELECT *, a + CASE WHEN o THEN -1 ELSE 1 END AS b FROM x), z AS (SELECT *, CASE WHEN o THEN 'offsets' WHEN s THEN 'digest' WHEN t THEN 'text' WHEN count(*) OVER (PARTITION BY source, a, b) > 1 THEN 'repeated' END AS fault FROM y)
        SELECT source, a AS first_line, b AS last_line, fault FROM z WHERE fault IS NOT NULL""",
    "p24_unasked": f"SELECT -doc_id - 1 AS doc_id FROM labels WHERE {d('amiss', 'doc_id', 9)} = 0",
    "p22_organizer_faults": "SELECT unnest(['number of records', 'repeated id', 'no other', 'category']) AS fault",
    "p27_edited_held": f"""
        WITH x AS (SELECT page_id, s, {d('same', K3, 5)} = 0 OR {d('read', K3, 7)} = 0 AS ok, CASE WHEN {d('sec', K3, 4)} = 0 THEN 'secret' WHEN {d('stuck', K3, 3)} = 0 THEN 'stuck' ELSE 'refresh' END AS why FROM pages, range(0, 3) r(s) WHERE {d('gone', 'page_id', 9)} > 0)
        SELECT page_id AS path, min_by(why, s) AS why FROM x GROUP BY page_id HAVING NOT bool_or(ok)""",
    "a24_mismatch_facts": f"""
        WITH x AS (SELECT source, {d('e', 'doc_id', 3)} AS e, CASE WHEN {d('m', 'doc_id', 90)} = 0 THEN 3 ELSE {d('a', 'doc_id', 3)} END AS a FROM documents), y AS (SELECT * FROM x WHERE e <> a),
        w AS (SELECT source, count(*) AS of, bool_and(a < 3) AS known, count(*) FILTER (a < 3 AND a > e) AS up, count(*) FILTER (a < e) AS down FROM y GROUP BY source)
        SELECT source, (['allow', 'ask', 'block', 'maybe'])[a + 1] AS actual, count(*) AS n, of, CASE WHEN known THEN up END AS stricter, CASE WHEN known THEN down END AS looser FROM y JOIN w USING (source) GROUP BY ALL""",
    "u8_scripted_answers": f"""
        WITH x AS (SELECT doc_id, CAST(quality AS VARCHAR) AS choice, {d('c', 'doc_id', 90)} / 100.0 AS confidence FROM labels JOIN documents USING (doc_id)), y AS (SELECT *, greatest(confidence, 1.0::DOUBLE / 3) AS l FROM x)
        SELECT 'k' || doc_id AS key, choice, confidence, {', '.join(f"round(CASE WHEN choice = '{o}' THEN l ELSE (1 - l) / 2 END, 6) AS p_{o}" for o in ('0', '1', 'none'))} FROM y""",
    "g1_revisits": """
        WITH RECURSIVE l AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey),
        w(root, id, depth) AS (SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0 FROM nation UNION SELECT w.root, dst, depth + 1 FROM w JOIN l ON src = id WHERE depth < 3), v AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY root, id)
        SELECT DISTINCT a.root, l.src, l.dst FROM v a JOIN l ON l.src = a.id JOIN v b ON b.root = a.root AND b.id = l.dst WHERE b.depth <= a.depth""",
    "f5_plural_forms": r"""
        WITH x AS (SELECT p_partkey, lower(regexp_extract(p_name, '^[A-Za-z]*')) AS w FROM part), y AS (SELECT p_partkey, [w, w || 's', w || 'es', CASE WHEN ends_with(w, 's') THEN w[:-2] ELSE w END, CASE WHEN ends_with(w, 'es') THEN w[:-3] ELSE w END] AS l FROM x)
        SELECT p_partkey, array_to_string(list_transform(list_filter(list_zip(l, range(1, 6)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), '|') AS forms FROM y""",
}
