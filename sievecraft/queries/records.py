"""Queries over joins, set operations, deduplication, walks and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.functions.text import phrase_key
from sievecraft.operators import graph as G
from sievecraft.operators import relational as J
from sievecraft.queries.documents import SQL_SQUEEZED, table
from sievecraft.queries.evaluation import d, digit


def p1_assigned_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 4 == 0, "  ").when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" id-"), F.col("doc_id") % 40)).otherwise(F.col("doc_id").cast("string")).alias("id"))
    return J.assign_ids(rows)


def p2_safe_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.regexp_extract("url", "//([^/]*)", 1).alias("id"))
    return J.safe_keys(rows)


def _lines(spark, sf_dir):
    """A catalog of all lines of documents, the last of them as negatives too."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), lines.alias("utterances"), F.array(F.element_at(lines, -1)).alias("negatives"))


def j13_duplicate_utterances(spark, sf_dir):
    return J.shared_utterances(J.phrase_members(_lines(spark, sf_dir))).select(F.md5("phrase").alias("phrase_md5"), "id", "owners", "first_owner")


def j12_negative_collisions(spark, sf_dir):
    return J.colliding_members(J.phrase_members(_lines(spark, sf_dir))).select(F.md5("phrase").alias("phrase_md5"), "id", "role", "owners", "first_owner", "deniers", "first_denier")


def j11_trigger_hits(spark, sf_dir):
    """The first four words of each benchmark item as its trigger, and its last four as its negative, looked for in all documents."""
    words = F.split("text", " ")
    phrase = lambda at: F.array(F.array_join(F.slice(words, at, 4), " "))
    catalog = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", phrase(2).alias("utterances"), phrase(-4).alias("negatives"))
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    negatives = catalog.where(F.size(words) > 3).select("id", F.lit("negative").alias("kind"), phrase_key(F.element_at("negatives", 1)).alias("phrase"))
    both = J.triggers(catalog).select("id", F.lit("trigger").alias("kind"), "phrase").unionByName(negatives)
    hits = J.phrase_hits(requests, both.select(F.struct("id", "kind").alias("id"), "phrase"))  # one pass for both
    return hits.select("request_id", "id.id", "id.kind").distinct()


def j17_snapshot_changes(spark, sf_dir):
    """Every page in both snapshots: some are renamed in the second, so both paths are on one side only."""
    key = F.col("url")
    before = table(spark, sf_dir, "pages").groupBy(key.alias("path")).agg(F.min_by(F.md5("html"), "page_id").alias("sha"))
    path = F.col("path")
    now = before.select(F.when(digit("m", path, 9) == 0, F.concat(path, F.lit("#moved"))).otherwise(path).alias("path"), F.when(digit("h", path, 5) == 0, F.md5("sha")).otherwise(F.col("sha")).alias("sha"))
    return J.snapshot_changes(before, now)


def j18_coverage(spark, sf_dir):
    """All parts of all suppliers; a part is held by the suppliers of which a line of it was not returned."""
    line = [F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("set"), F.col("l_partkey").alias("path")]
    rows = table(spark, sf_dir, "lineitem")
    return J.coverage(rows.select(*line), rows.where("l_returnflag <> 'R'").select(*line))


def j20_neighbours(spark, sf_dir):
    """The user's turns and what stands around them."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("idx"), "role")
    return J.with_neighbours(chunks.where("role = 'user'"), chunks)


def j8_called_by(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    parts = rows.where("l_linenumber = 1").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("m.name"), F.col("l_partkey").cast("string")).alias("name"))
    calls = rows.where("l_linenumber > 1").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("name"), F.col("l_partkey").cast("string")).alias("name"))
    return J.called_by(parts, calls)


def j14_without_views(spark, sf_dir):
    return J.without_views(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 2)).alias("upstream")))


def p28_leaking_identities(spark, sf_dir):
    """Texts and all their lines that documents of both splits have."""
    split = F.when(digit("split", F.col("doc_id"), 10) < 3, "holdout").otherwise("retrospective")
    rows = table(spark, sf_dir, "documents").select(split.alias("split"), "text")
    lines = rows.select("split", F.lit("line").alias("kind"), F.explode(F.split("text", "\n")).alias("x"))
    return J.leaking_identities(rows.select("split", F.lit("text").alias("kind"), F.col("text").alias("x")).unionByName(lines).select("split", "kind", F.md5("x").alias("value")))


def d1_duplicate_sources(spark, sf_dir):
    return J.duplicate_sources(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("description")))


def d2_first_by_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    parts = [rows.where(F.col("o_orderstatus") == s) for s in "FOP"]
    return J.first_by_priority(parts, ["key"], [F.col("id")])


def d4_only_in_either(spark, sf_dir):
    """Documents without labels, and labels read amiss, which no document has."""
    amiss = F.when(digit("amiss", F.col("doc_id"), 9) == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return J.only_in_either(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select(amiss.alias("doc_id")), "doc_id")


def d7_connected(spark, sf_dir):
    """Suppliers that share a part, directly or not, over all of lineitem. Its SQL goes over pairs of suppliers, of which the small tables have few."""
    return G.connected(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("key")))


def _links(spark, sf_dir):
    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return (
        table(spark, sf_dir, "orders").select(c("o", "o_orderkey").alias("src"), c("c", "o_custkey").alias("dst"))
        .unionByName(table(spark, sf_dir, "customer").select(c("c", "c_custkey").alias("src"), c("n", "c_nationkey").alias("dst")))
        .unionByName(table(spark, sf_dir, "nation").select(c("n", "n_nationkey").alias("src"), c("r", "n_regionkey").alias("dst")))
    )


def g1_walk(spark, sf_dir):
    roots = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    links = _links(spark, sf_dir)
    visits = G.walk(roots, links, 2)
    docs = links.select(F.col("src").alias("id")).where("not (id like 'n%' and length(id) = 2)")
    return G.walk_report(visits, links, docs, 2)


SQL_LINKS = """SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


def r9_beam(spark, sf_dir):
    """For each supplier the three best paths over region and nation by made-up probabilities; a region whose none is likelier than its nations is pruned."""
    requests = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    regions = table(spark, sf_dir, "region").select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"))
    tree = regions.unionByName(nations)
    p = (digit("p", F.concat_ws("/", "request", "child"), 97) + 1) / F.lit(100.0)
    none = (digit("none", F.concat_ws("/", "request", "node"), 97) + 1) / F.lit(100.0)
    return G.beam(requests, F.broadcast(tree), 2, 3, p, none).select("request", "node", "rank", F.round("score", 6).alias("score"))


def a11_folder_units(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[^/]*//", ""), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    files = rows.select(F.concat(F.lit("top/"), F.regexp_replace("path", r"^(?:[^/.]*\.)*([^/.]*\.[^/.]*)/", "$1/")).alias("path")).distinct()
    return G.folder_units(files.withColumn("top", F.lit("top"))).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "p1_assigned_ids": p1_assigned_ids, "p2_safe_keys": p2_safe_keys, "j13_duplicate_utterances": j13_duplicate_utterances, "j12_negative_collisions": j12_negative_collisions,
    "j11_trigger_hits": j11_trigger_hits, "j17_snapshot_changes": j17_snapshot_changes, "j18_coverage": j18_coverage, "j20_neighbours": j20_neighbours, "j8_called_by": j8_called_by,
    "j14_without_views": j14_without_views, "p28_leaking_identities": p28_leaking_identities, "d1_duplicate_sources": d1_duplicate_sources, "d2_first_by_priority": d2_first_by_priority,
    "d4_only_in_either": d4_only_in_either, "d7_connected": d7_connected, "g1_walk": g1_walk, "r9_beam": r9_beam, "a11_folder_units": a11_folder_units,
}
KEY = SQL_SQUEEZED.format
SQL_MEMBERS = f"""
        WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS u FROM documents),
        m AS (SELECT DISTINCT id, role, {KEY('x')} AS phrase FROM (SELECT id, 'utterance' AS role, unnest(u) AS x FROM l UNION ALL SELECT id, 'negative', u[-1] FROM l)),
        u AS (SELECT phrase, count(*) AS owners, min(id) AS first_owner FROM m WHERE role = 'utterance' GROUP BY phrase), n AS (SELECT phrase, count(*) AS deniers, min(id) AS first_denier FROM m WHERE role = 'negative' GROUP BY phrase)"""
SQL = {
    "j13_duplicate_utterances": f"{SQL_MEMBERS} SELECT md5(phrase) AS phrase_md5, id, owners, first_owner FROM m JOIN u USING (phrase) WHERE role = 'utterance' AND owners > 1 AND phrase <> ''",
    "j12_negative_collisions": f"""{SQL_MEMBERS} SELECT md5(phrase) AS phrase_md5, id, role, owners, first_owner, deniers, first_denier FROM m JOIN u USING (phrase) JOIN n USING (phrase)
        WHERE phrase <> '' AND EXISTS (SELECT 1 FROM m o WHERE o.phrase = m.phrase AND o.role <> m.role AND o.id <> m.id)""",
    "p28_leaking_identities": f"""
        WITH x AS (SELECT CASE WHEN {d('split', 'doc_id', 10)} < 3 THEN 'holdout' ELSE 'retrospective' END AS split, text FROM documents),
        i AS (SELECT split, 'text' AS kind, md5(text) AS value FROM x UNION ALL SELECT split, 'line', md5(v) FROM (SELECT split, unnest(string_split(text, chr(10))) AS v FROM x))
        SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM i GROUP BY kind, value HAVING count(DISTINCT split) > 1""",
    "p1_assigned_ids": """
        WITH x AS (SELECT doc_id AS pos, coalesce(nullif(trim(CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' id-' || (doc_id % 40) ELSE CAST(doc_id AS VARCHAR) END), ''), 'records/' || doc_id) AS id FROM documents)
        SELECT id, pos, count(*) OVER (PARTITION BY id) > 1 AS repeated FROM x""",
    "p2_safe_keys": """
        WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY page_id) AS k, page_id AS pos, regexp_extract(url, '//([^/]*)', 1) AS id FROM pages),
        p AS (SELECT *, regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') AS raw FROM x),
        s AS (SELECT k, pos, id, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9_]{0,63}$') AND raw NOT IN ('constructor', 'prototype', '__proto__', 'toString', 'hasOwnProperty') THEN raw ELSE substr('r_' || raw, 1, 64) END AS base FROM p),
        f(k, used, key) AS (SELECT 0::BIGINT, []::VARCHAR[], '' UNION ALL
          SELECT s.k, list_append(used, n.key), n.key FROM f JOIN s ON s.k = f.k + 1, LATERAL (SELECT coalesce(CASE WHEN NOT list_contains(used, base) THEN base END, base || '_' || list_filter(range(2, 2000), lambda i: NOT list_contains(used, base || '_' || i))[1]) AS key) n)
        SELECT pos, id, key FROM f JOIN s USING (k)""",
    "j11_trigger_hits": r"""
        WITH w AS (SELECT item_id AS id, string_split(text, ' ') AS w FROM benchmark),
        t AS (SELECT id, trim(regexp_replace(regexp_replace(lower(array_to_string(w[2:5], ' ')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM w),
        n AS (SELECT id, trim(regexp_replace(regexp_replace(lower(array_to_string(w[-4:], ' ')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM w WHERE len(w) > 3),
        o AS (SELECT min(id) AS id, phrase FROM t WHERE contains(phrase, ' ') GROUP BY phrase HAVING count(DISTINCT id) = 1),
        r AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS words FROM documents)
        SELECT doc_id AS request_id, id, 'trigger' AS kind FROM r JOIN o ON contains(words, ' ' || phrase || ' ')
        UNION ALL SELECT DISTINCT doc_id, id, 'negative' FROM r JOIN n ON phrase <> '' AND contains(words, ' ' || phrase || ' ')""",
    "j17_snapshot_changes": f"""
        WITH a AS (SELECT url AS path, min_by(md5(html), page_id) AS sha FROM pages GROUP BY url),
        b AS (SELECT CASE WHEN {d('m', 'path', 9)} = 0 THEN path || '#moved' ELSE path END AS path, CASE WHEN {d('h', 'path', 5)} = 0 THEN md5(sha) ELSE sha END AS sha FROM a)
        SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' WHEN a.sha = b.sha THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path)""",
    "j18_coverage": """
        WITH e AS (SELECT DISTINCT 's' || l_suppkey AS set, l_partkey AS path FROM lineitem), h AS (SELECT DISTINCT l_partkey AS path, 's' || l_suppkey AS holder FROM lineitem WHERE l_returnflag <> 'R'),
        p AS (SELECT e.set, e.path, coalesce(bool_or(e.set = holder), false) AS own, count(holder) AS n FROM e LEFT JOIN h USING (path) GROUP BY e.set, e.path),
        b AS (SELECT p.set, string_agg(DISTINCT holder, ',' ORDER BY holder) AS borrows FROM p JOIN h USING (path) WHERE NOT own GROUP BY p.set)
        SELECT p.set, bool_and(n > 0) AS complete, coalesce(any_value(borrows), '') AS borrows FROM p LEFT JOIN b USING (set) GROUP BY p.set""",
    "j20_neighbours": """
        WITH c AS (SELECT conv_id AS source, turn AS idx, role FROM conversations), s AS (SELECT * FROM c WHERE role = 'user')
        SELECT c.source, c.idx, bool_or(c.idx = s.idx) AS base FROM c JOIN s ON c.source = s.source AND abs(c.idx - s.idx) <= 1 GROUP BY c.source, c.idx""",
    "j14_without_views": """
        WITH x AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 2) AS BIGINT) END AS upstream FROM orders)
        SELECT * FROM x WHERE upstream IS NULL OR upstream NOT IN (SELECT path FROM x)""",
    "j8_called_by": """
        WITH p AS (SELECT DISTINCT l_orderkey AS path, 'name' || l_partkey AS name FROM lineitem WHERE l_linenumber = 1), c AS (SELECT DISTINCT l_orderkey AS caller, 'name' || l_partkey AS name FROM lineitem WHERE l_linenumber > 1),
        r AS (SELECT name FROM p GROUP BY name HAVING count(*) <= 3)
        SELECT path, name, caller FROM p JOIN r USING (name) JOIN c USING (name) WHERE path <> caller""",
    "d1_duplicate_sources": "SELECT min(doc_id) AS canonical_id, count(*) AS n, sha256(text) AS text_sha FROM documents GROUP BY text, lang HAVING count(*) > 1",
    "d2_first_by_priority": """
        WITH r AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS rn
                   FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))
        SELECT key, id, o_orderstatus FROM r WHERE rn = 1""",
    "d4_only_in_either": f"""
        WITH l AS (SELECT CASE WHEN {d('amiss', 'doc_id', 9)} = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM labels)
        SELECT doc_id, 'a' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, 'b' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "d7_connected": """
        WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS key FROM lineitem),
        e AS (SELECT DISTINCT a.member AS a, b.member AS b FROM m a JOIN m b USING (key)),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS member, min(b) AS "group" FROM r GROUP BY a""",
    "g1_walk": f"""
        WITH RECURSIVE l AS ({SQL_LINKS}), k AS (SELECT DISTINCT src AS id FROM l WHERE NOT (src LIKE 'n%' AND length(src) = 2)),
        w(root, id, depth) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders UNION SELECT w.root, l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.id WHERE w.depth < 2),
        v AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY root, id)
        SELECT root, count(*) AS visited, count(*) FILTER (k.id IS NULL) AS dangling, max(depth) FILTER (k.id IS NOT NULL) AS depth,
               bool_or(depth = 2 AND k.id IS NOT NULL AND v.id IN (SELECT src FROM l)) AS truncated
        FROM v LEFT JOIN k USING (id) GROUP BY root""",
    "r9_beam": f"""
        WITH t AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
        e AS (SELECT s_suppkey AS request, parent, child, ({d('p', "(s_suppkey || '/' || child)", 97)} + 1) / 100.0 AS p FROM supplier, t),
        a AS (SELECT request, child AS node, 'root/' || child AS path, ln(p) AS log, row_number() OVER (PARTITION BY request ORDER BY round(p, 9) DESC, 'root/' || child) AS rank, max(p) OVER (PARTITION BY request) AS best FROM e WHERE parent = 'root'
              QUALIFY max(p) OVER (PARTITION BY request) >= ({d('none', "(request || '/root')", 97)} + 1) / 100.0),
        o AS (SELECT a.request, a.node FROM a JOIN e ON e.request = a.request AND e.parent = a.node GROUP BY a.request, a.node HAVING max(e.p) >= ({d('none', "(a.request || '/' || a.node)", 97)} + 1) / 100.0),
        b AS (SELECT a.request, e.child AS node, a.path || '/' || e.child AS path, exp((a.log + ln(e.p)) / 2) AS score FROM a JOIN o ON o.request = a.request AND o.node = a.node JOIN e ON e.request = a.request AND e.parent = a.node WHERE a.rank <= 3),
        c AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(score, 9) DESC, path) AS rank FROM b)
        SELECT request, node, rank, round(score, 6) AS score FROM c WHERE rank <= 3""",
}
