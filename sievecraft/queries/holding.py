"""Queries over a word index of documents and over what is held of files: paths are those of pages' urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.operators import holdings as H
from sievecraft.operators import search_index as X
from sievecraft.operators.graph import folder_rows
from sievecraft.functions import text as T
from sievecraft.queries.documents import SQL_SQUEEZED, _cuts_sql, table
from sievecraft.queries.evaluation import d, digit

SQL_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"
TERMS = ("tionand", "theron", "eronth")


def _files(spark, sf_dir):
    """Documents as files: their sources are sets, every fifth belongs to one of three people."""
    key = F.col("doc_id")
    person = F.when(digit("who", key, 5) == 0, F.concat(F.lit("p"), digit("p", key, 3).cast("string")))
    path = F.concat(F.lit("f"), F.lpad(key.cast("string"), 12, "0"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("source").alias("set"), person.alias("person"), F.md5("text").alias("sha"), "text", (F.length("text") / 3500 + 1).cast("int").alias("passages"), "doc_id")


SQL_FILES = f"""SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, source AS set, CASE WHEN {d('who', 'doc_id', 5)} = 0 THEN 'p' || {d('p', 'doc_id', 3)} ELSE '' END AS person, md5(text) AS sha,
                CAST(floor(length(text) / 3500 + 1) AS INT) AS passages, text, {SQL_WORDS} AS w, doc_id FROM documents"""


def _index(spark, sf_dir):
    return X.index_files(_files(spark, sf_dir))


def k5_updated_index(spark, sf_dir):
    """The vocabulary after some documents changed (their first line went) and some went, by an update of their rows alone."""
    files = _files(spark, sf_dir)
    key = F.col("doc_id")
    changed = files.where(digit("ch", key, 6) == 0).withColumn("text", F.regexp_replace("text", "^[^\n]*", ""))
    return X.vocabulary(X.updated(_index(spark, sf_dir), changed, files.where(digit("ch", key, 6) == 1)).postings)


def a9_index_stats(spark, sf_dir):
    return X.stats(_index(spark, sf_dir).files)


def a10_bigrams(spark, sf_dir):
    """How many words of the vocabulary have each pair of characters."""
    words = X.vocabulary(_index(spark, sf_dir).postings)
    return X.bigrams(words).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def r17_variants(spark, sf_dir):
    """Words of the vocabulary that count as one of three terms; closeness of spelling is not for SQL."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    synonyms = spark.createDataFrame([("theron", "the"), ("theron", "no such word at all")], "term string, word string")
    return X.variants(terms, X.vocabulary(_index(spark, sf_dir).postings), synonyms)


def r5_shortlist(spark, sf_dir):
    """The best forty files of half of the sets, for terms of two words each: a shortlist is a top k."""
    query = spark.createDataFrame([("a", "tionand"), ("a", "the"), ("b", "ofer"), ("b", "thering")], "term string, word string")
    return X.shortlist(_index(spark, sf_dir), query, _sets(spark, sf_dir), ["p0", "p1"], 40)


def _sets(spark, sf_dir) -> list[str]:
    """Every second source by name: the stated scope of the search."""
    names = [r[0] for r in table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").collect()]  # a few names
    return names[::2]


def j7_with_rows(spark, sf_dir):
    """Documents with the labels and items that were made of just their bytes; some were made of others."""
    files = _files(spark, sf_dir).select("path", "sha", "doc_id")
    of = lambda salt: files.select("path", F.when(digit(salt, F.col("doc_id"), 4) == 0, F.md5("sha")).otherwise(F.col("sha")).alias("sha"), F.concat(F.lit(salt), "doc_id").alias("value"))
    return X.with_rows(files.select("path", "sha"), of("label"), of("item"))


def r4_picked_chunks(spark, sf_dir):
    """Passages of all documents to read within 8000 characters of each."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(T.passages("text")).alias("number", "p")).select("path", "number", F.col("p.passage").alias("text"))
    return X.picked_chunks(chunks, ["tionand", "theron", "que"], 8000)


def _paths(spark, sf_dir):
    """Paths under three roots, with names that stand for other files among them."""
    key = F.col("page_id")
    names = ("note.md", "README.md", "_TEMPLATE-x.md", "profile.md", "index.html", "tests/fixtures/a.md", "pr-history/pr-1.md", "_staging/b.md", "docs/evidence/run/sources/c.md", ".env", "a.b.c", "testdata/z.txt")
    path = F.concat(F.regexp_replace("url", "^[^/]*//([^/?#]*/[^/?#]*).*$", "$1"), F.lit("/"), F.element_at(F.array(*map(F.lit, names)), digit("name", key, len(names)) + 1))
    return table(spark, sf_dir, "pages").select(key.alias("id"), path.alias("path"), "url")


SQL_NAMES = ("note.md", "README.md", "_TEMPLATE-x.md", "profile.md", "index.html", "tests/fixtures/a.md", "pr-history/pr-1.md", "_staging/b.md", "docs/evidence/run/sources/c.md", ".env", "a.b.c", "testdata/z.txt")
SQL_PATHS = f"SELECT page_id AS id, url, regexp_replace(url, '^[^/]*//([^/?#]*/[^/?#]*).*$', '\\1') || '/' || ({list(SQL_NAMES)!r})[{d('name', 'page_id', 12)} + 1] AS path FROM pages"


def p18_copy_kinds(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("id", H.stem(path).alias("stem"), H.copy_kind(path).alias("kind"), H.is_hub(path).alias("hub"))


def p17_path_tests(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("id", H.is_fixture(path).alias("fixture"), H.is_fixture(path, F.col("id") % 2 == 0).alias("fixture_if_named"), H.excluded(path, ("www.example.com/en", "example.net")).alias("excluded"))


def p19_candidate_files(spark, sf_dir):
    key = F.col("id")
    entries = _paths(spark, sf_dir).select(F.concat(F.lit("s"), digit("set", key, 4).cast("string")).alias("set"), digit("set", key, 4).alias("order"), "path", (digit("ok", key, 5) > 0).alias("pass"))
    return H.candidate_files(entries, ("www.example.com/en",))


def d3_one_per_file(spark, sf_dir):
    """Pages of one path are one file under several names."""
    return H.one_per_file(_paths(spark, sf_dir).select(F.col("path").alias("real"), F.col("url").alias("path"), digit("root", F.col("id"), 3).alias("root")))


KINDS, STATUSES = ("note", "plan", "report"), ("open", "done")


def _labels(spark, sf_dir):
    key = F.col("doc_id")
    one = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), digit(salt, key, len(values)) + 1)
    month, day = digit("mo", key, 14).cast("string"), digit("da", key, 33).cast("string")
    as_of = F.when(digit("as", key, 5) == 0, "last week").otherwise(F.concat_ws("-", F.lit("2024"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    return table(spark, sf_dir, "documents").select(key.alias("id"), one("ki", (*KINDS, "poem")).alias("kind"), one("st", (*STATUSES, "lost")).alias("status"), as_of.alias("as_of"), F.when(digit("su", key, 4) > 0, F.concat(F.lit(" "), "source")).otherwise("  ").alias("subject"))


SQL_DRAFTS = f"""SELECT doc_id AS id, (['note', 'plan', 'report', 'unknown'])[{d('ki', 'doc_id', 4)} + 1] AS kind, (['open', 'done', 'unknown'])[{d('st', 'doc_id', 3)} + 1] AS status,
    CASE WHEN {d('as', 'doc_id', 5)} = 0 THEN 'unknown' ELSE '2024-' || lpad(CAST({d('mo', 'doc_id', 14)} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d('da', 'doc_id', 33)} AS VARCHAR), 2, '0') END AS as_of,
    CASE WHEN {d('su', 'doc_id', 4)} > 0 THEN source ELSE 'unknown' END AS subject FROM documents"""


def p16_checked_labels(spark, sf_dir):
    return H.checked_labels(_labels(spark, sf_dir), KINDS, STATUSES)


def p15_label_matches(spark, sf_dir):
    return H.label_matches(H.checked_labels(_labels(spark, sf_dir), KINDS, STATUSES), F.lit("2024-07-01").cast("date"), status="open", kind="note", subject="O", days=90)


def s7_skip_lines(spark, sf_dir):
    """Reasons and labels of skipped files: top-level domains and first folders."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("reason"), F.regexp_extract("url", "//([^/]*)/", 1).alias("label"))
    return H.skip_lines(rows)


def a15_folded_states(spark, sf_dir):
    key = F.col("doc_id")
    state = F.element_at(F.array(*map(F.lit, H.STATES)), F.when(digit("bad", key, 40) == 0, digit("which", key, 4)).otherwise(digit("ok", key, 2)) + 1)
    return H.folded_states(table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("set"), state.alias("state"), F.when(digit("n", key, 3) > 0, digit("n", key, 90)).alias("notes")))


def _sees(spark, sf_dir, salt, modulus):
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return rows.where(digit(salt, F.col("doc_id"), modulus) == 0).select(F.concat_ws("/", "source", "lang").alias("set"), F.concat(F.lit("p"), digit("pr", F.col("doc_id"), 7).cast("string")).alias("principal"))


def j15_visibility_faults(spark, sf_dir):
    return H.visibility_faults(_sees(spark, sf_dir, "see", 3), _sees(spark, sf_dir, "hold", 2))


def p29_watched_refusals(spark, sf_dir):
    """Each page's set is its language folder, its folders are watched by sets of hosts; principals are few."""
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//[^/]*/([^/?]*)", 1).alias("set"), F.regexp_extract("url", "//([^?#]*)", 1).alias("path"))
    host = F.split("path", "/")[0]
    watched = files.select(F.concat(F.lit("w"), digit("w", host, 6).cast("string")).alias("set"), F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("folder")).where(digit("f", host, 3) == 0).distinct()
    names = files.select("set").unionByName(watched.select("set")).distinct()
    principals = F.filter(F.array(*[F.when(digit(f"m{k}", F.col("set"), 2) == 0, f"p{k}") for k in range(3)]), lambda p: p.isNotNull())
    return H.watched_refusals(names.select("set", principals.alias("principals")), files, watched)


def p29_visible(spark, sf_dir):
    """Sources that serve a principal."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("set")).distinct()
    principals = F.array_compact(F.array(*[F.when(digit(f"m{k}", F.col("set"), 2) == 0, f"p{k}") for k in range(3)]))
    return H.visible(names.select("set", principals.alias("principals")), "p1").select("set")


def j21_nearest_home(spark, sf_dir):
    """Owners of pages by the deepest folder: hosts and some of their folders are homes."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^?#]*)", 1).alias("path")).distinct()
    host, deeper = F.split("path", "/")[0], F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    homes = paths.select(host.alias("folder")).where(digit("h", F.col("folder"), 2) == 0).unionByName(paths.select(deeper.alias("folder")).where(digit("h", F.col("folder"), 3) == 0)).distinct()
    return H.nearest_home(paths, homes.select("folder", F.concat(F.lit("p"), digit("own", F.col("folder"), 9).cast("string")).alias("person")))


def j22_folder_coverage(spark, sf_dir):
    rows = _paths(spark, sf_dir).select(F.split("path", "/")[0].alias("folder"), F.col("id").alias("real"), F.col("path").endswith(".md").alias("supported"))
    return H.folder_coverage(rows, rows.where(digit("reg", F.col("real"), 3) > 0).select("real"))


def p25_usable(spark, sf_dir):
    """Turns as chunks; preparations are missing, unreviewed or of other bytes for some."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("idx"), F.md5("text").alias("sha"), key.alias("key"))
    made = chunks.where(digit("made", F.col("key"), 7) > 0).select("source", "idx", F.when(digit("old", F.col("key"), 5) == 0, F.md5("sha")).otherwise(F.col("sha")).alias("sha"), (digit("rev", F.col("key"), 6) > 0).alias("reviewed"))
    return H.usable(chunks.select("source", "idx", "sha"), made)


def a18_bar_states(spark, sf_dir):
    key = F.col("doc_id")
    c = F.col
    kind = F.when(digit("kind", key, 2) == 0, "count").otherwise("rate")
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), (digit("bar", key, 100) + 1).alias("bar"), digit("hits", key, 30).alias("hits"), (digit("hits", key, 30) + digit("n", key, 20)).alias("n"), digit("left", key, 8).alias("left"), digit("stop", key, 3).alias("stop"))
    stop = F.element_at(F.array(F.lit("complete"), F.lit("bar-unreachable: x"), F.lit("killed")), c("stop") + 1)
    state = H.bar_state(c("kind"), c("bar"), c("hits"), c("n"), c("left"))
    return rows.select("doc_id", state.alias("state"), H.needed_hits(c("bar"), c("n") + c("left")).alias("need"), H.verdict(F.coalesce(state, F.lit(False)), stop).alias("verdict"))


def a19_gate_reasons(spark, sf_dir):
    key = F.col("doc_id")
    checks = {r: digit(s, key, 4) == 0 for r, s in (("target did not move", "a"), ("control lost", "b"), ("no held-out evidence", "c"))}
    decision, reasons = H.gate_reasons(checks)
    return table(spark, sf_dir, "documents").select("doc_id", decision.alias("decision"), F.array_join(reasons, "; ").alias("reasons"))


def _arms(spark, sf_dir):
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.concat(F.lit("arm"), digit("arm", key, 6).cast("string")).alias("arm"), F.when(digit("v", key, 3) == 0, "OVERCLAIMS").when(digit("v", key, 3) == 1, "UNSURE").alias("verdict"), (digit("b", key, 30) == 0).alias("blocks"))
    return rows, spark.createDataFrame([(f"arm{k}", "judge" if k < 4 else "rule") for k in range(5)], "arm string, kind string")


def a28_only_judge_blocks(spark, sf_dir):
    rows, kinds = _arms(spark, sf_dir)
    return H.only_judge_blocks(rows, kinds).join(H.only_judge_blocks(rows, kinds, ("UNSURE",)).withColumnRenamed("only_judge", "only_weak"), "run")


def a17_drift_baseline(spark, sf_dir):
    key = F.col("doc_id")
    decision = lambda s: F.when(digit(s, key, 3) == 0, "false").when(digit(s, key, 3) == 1, "true").otherwise("unsure")
    a, b = (table(spark, sf_dir, "documents").select(key.alias("case_id"), decision(s).alias("decision")) for s in ("ra", "rb"))
    changed = a.join(b.withColumnRenamed("decision", "other"), "case_id").where("decision <> other")
    return H.drift_baseline(a, b, changed)


def a26_frozen_scores(spark, sf_dir):
    """Documents as told rows, labelled ones as expected: unknown and worse rows are counted."""
    key = F.col("doc_id")
    told = table(spark, sf_dir, "documents").select(key.alias("id"), digit("be", key, 5).alias("before"), (digit("be", key, 5) + digit("af", key, 9) - 1).alias("after"))
    return H.frozen_scores(table(spark, sf_dir, "labels").select(key.alias("id")), told)


def k8_merged_saved(spark, sf_dir):
    """Turns of assistants as harvested questions, of users as current ones."""
    rows = table(spark, sf_dir, "conversations").select(F.substring("text", 1, 3).alias("question"), F.md5("text").alias("gold"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "role")
    return H.merged_saved(rows.where("role <> 'user'").drop("role"), rows.where("role = 'user'").drop("role"), T.question_key)


def t6_retry_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), digit("k", F.col("event_id"), 3).alias("kind"), (digit("ok", F.col("event_id"), 9) == 0).alias("ok"))
    return H.retry_queue(rows.where("kind = 0").select("key", "at"), rows.where("kind > 0").select("key", "at", "ok"))


def a11_folder_rows(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[^/]*//", ""), "[?#].*$", "")
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("top/"), F.regexp_replace(path, r"^(?:[^/.]*\.)*([^/.]*\.[^/.]*)/", "$1/")).alias("path")).distinct()
    return folder_rows(files.withColumn("top", F.lit("top")), 7).select("unit", "n", F.md5("names").alias("names_md5"))


QUERIES = {
    "k5_updated_index": k5_updated_index, "a9_index_stats": a9_index_stats, "a10_bigrams": a10_bigrams, "r17_variants": r17_variants, "r5_shortlist": r5_shortlist, "j7_with_rows": j7_with_rows, "r4_picked_chunks": r4_picked_chunks,
    "p18_copy_kinds": p18_copy_kinds, "p17_path_tests": p17_path_tests, "p19_candidate_files": p19_candidate_files, "d3_one_per_file": d3_one_per_file, "p16_checked_labels": p16_checked_labels, "p15_label_matches": p15_label_matches,
    "s7_skip_lines": s7_skip_lines, "a15_folded_states": a15_folded_states, "j15_visibility_faults": j15_visibility_faults, "p29_watched_refusals": p29_watched_refusals, "p29_visible": p29_visible, "j21_nearest_home": j21_nearest_home,
    "j22_folder_coverage": j22_folder_coverage, "p25_usable": p25_usable, "a18_bar_states": a18_bar_states, "a19_gate_reasons": a19_gate_reasons, "a28_only_judge_blocks": a28_only_judge_blocks, "a17_drift_baseline": a17_drift_baseline,
    "a26_frozen_scores": a26_frozen_scores, "k8_merged_saved": k8_merged_saved, "t6_retry_queue": t6_retry_queue, "a11_folder_rows": a11_folder_rows,
}
FIXTURE = H.FIXTURES.removeprefix("(?i)")
HUBS = "('" + "', '".join(H.HUBS) + "')"
SQL_STEM = r"lower(regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1'))"
SQL_FOLDERS = "list_transform(string_split(path, '/')[:-2], lambda z: lower(z))"


def _units_sql() -> str:
    """Files and their folders as single rounds of climbing, of which the urls need few: unrolled, since a round counts what the one before moved."""
    steps = ["u0 AS MATERIALIZED (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS unit FROM f)"]
    for k in range(8):
        steps.append(
            f"u{k + 1} AS MATERIALIZED (SELECT path, CASE WHEN n < 5 AND unit <> 'top' AND length(unit) > 3 THEN regexp_replace(unit, '/?[^/]*$', '') ELSE unit END AS unit FROM u{k} JOIN (SELECT unit, count(*) AS n FROM u{k} GROUP BY unit) USING (unit))"
        )
    return ", ".join(steps)


SQL_TOP = r"WITH f AS (SELECT DISTINCT 'top/' || regexp_replace(regexp_replace(regexp_replace(url, '^[^/]*//', ''), '[?#].*$', ''), '^(?:[^/.]*\.)*([^/.]*\.[^/.]*)/', '\1/') AS path FROM pages)"
SQL_SEES = lambda salt, n: f"SELECT DISTINCT source || '/' || lang AS set, 'p' || {d('pr', 'doc_id', 7)} AS principal FROM documents WHERE {d(salt, 'doc_id', n)} = 0"
SQL_MEMBERS3 = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {d(f'm{k}', c, 2)} = 0 THEN 'p{k}' END" for k in range(3)) + "], lambda z: z IS NOT NULL)"
SQL = {
    "k5_updated_index": f"""
        WITH x AS (SELECT CASE WHEN {d('ch', 'doc_id', 6)} = 0 THEN regexp_replace(text, '^[^\n]*', '') ELSE text END AS text FROM documents WHERE {d('ch', 'doc_id', 6)} <> 1)
        SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct({SQL_WORDS})) AS word FROM x) GROUP BY word""",
    "a9_index_stats": f"WITH f AS ({SQL_FILES}) SELECT set, person, count(*) AS n, CAST(sum(passages) AS BIGINT) AS passages, CAST(sum(len(w)) AS BIGINT) AS size FROM f GROUP BY set, person",
    "a10_bigrams": f"""
        WITH v AS (SELECT DISTINCT unnest({SQL_WORDS}) AS word FROM documents)
        SELECT gram, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(range(1, length(word)), lambda i: word[i:i + 1]))) AS gram FROM v) GROUP BY gram""",
    "r5_shortlist": f"""
        WITH s AS (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents)) WHERE k % 2 = 1),
        f AS (SELECT * FROM ({SQL_FILES}) WHERE set IN (SELECT source FROM s) AND person IN ('', 'p0', 'p1')),
        t AS (SELECT path, len(w) AS size, q, len(list_filter(w, lambda z: list_contains(v, z))) AS tf FROM f, (VALUES ('a', ['tionand', 'the']), ('b', ['ofer', 'thering'])) k(q, v)),
        st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM f), df AS (SELECT q, count(*) AS df FROM t WHERE tf > 0 GROUP BY q)
        SELECT path, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))) * 1000 + 0.5) / 1000 AS score FROM t JOIN df USING (q), st WHERE tf > 0 GROUP BY path ORDER BY score DESC, path LIMIT 40""",
    "j7_with_rows": f"""
        WITH f AS (SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, md5(text) AS sha, doc_id FROM documents)
        SELECT path, sha, CASE WHEN {d('label', 'doc_id', 4)} <> 0 THEN 'label' || doc_id END AS label, CASE WHEN {d('item', 'doc_id', 4)} <> 0 THEN 'item' || doc_id END AS item FROM f""",
    "p18_copy_kinds": f"""
        WITH p AS ({SQL_PATHS}), s AS (SELECT id, {SQL_STEM} AS stem, {SQL_FOLDERS} AS f FROM p)
        SELECT id, stem, CASE WHEN stem IN {HUBS} OR stem = 'profile' THEN 'hub' WHEN contains(stem, 'template') OR len(list_filter(f, lambda z: z = '_staging' OR contains(z, 'template'))) > 0 THEN 'copy' WHEN list_has_any(f, ['pr-history']) THEN 'writeup' END AS kind,
               stem IN {HUBS} OR contains(stem, 'template') AS hub FROM s""",
    "p17_path_tests": f"""
        WITH p AS ({SQL_PATHS}), q AS (SELECT *, CASE WHEN id % 2 = 0 THEN regexp_replace(path, '[^/]*$', '') ELSE path END AS named FROM p)
        SELECT id, regexp_matches(path, '(?i){FIXTURE}') AS fixture, regexp_matches(named, '(?i){FIXTURE}') AS fixture_if_named, path IN ('www.example.com/en', 'example.net') OR starts_with(path, 'www.example.com/en/') OR starts_with(path, 'example.net/') AS excluded FROM q""",
    "p19_candidate_files": f"""
        WITH p AS ({SQL_PATHS}) SELECT path, 's' || min({d('set', 'id', 4)}) AS set FROM p WHERE {d('ok', 'id', 5)} > 0 AND NOT regexp_matches(path, '(?i){FIXTURE}') AND NOT starts_with(path, 'www.example.com/en/') GROUP BY path""",
    "d3_one_per_file": f"""
        WITH p AS ({SQL_PATHS}), r AS (SELECT path AS real, url, {d('root', 'id', 3)} AS root, row_number() OVER (PARTITION BY path ORDER BY {d('root', 'id', 3)}, url) AS k, count(*) OVER (PARTITION BY path) AS names FROM p)
        SELECT real, url AS path, root, names FROM r WHERE k = 1""",
    "p16_checked_labels": f"""WITH l AS ({SQL_DRAFTS}) SELECT *, 'This file is a ' || kind || ' about ' || subject || '. Its status is ' || status || CASE WHEN as_of <> 'unknown' THEN ' as of ' || as_of ELSE '' END || '.' AS sentence FROM l""",
    "p15_label_matches": f"""
        WITH l AS ({SQL_DRAFTS}), x AS (SELECT id, status = 'open' AND kind = 'note' AND contains(lower(subject), 'o') AS ok, TRY_CAST(as_of AS DATE) AS day FROM l)
        SELECT id, coalesce(ok AND date_diff('day', day, DATE '2024-07-01') <= 90, false) AS match, ok AND day IS NULL AS undated FROM x""",
    "s7_skip_lines": r"""
        WITH x AS (SELECT regexp_extract(url, '\.([a-z]+)/', 1) AS reason, regexp_extract(url, '//([^/]*)/', 1) AS label FROM pages), c AS (SELECT reason, label, count(*) AS n FROM x GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY n DESC, label) AS k FROM c)
        SELECT reason, CAST(sum(n) AS BIGINT) AS n, string_agg(label || ' ' || n, ', ' ORDER BY k) FILTER (k <= 5) AS top, greatest(count(*) - 5, 0) AS more FROM r GROUP BY reason""",
    "a15_folded_states": f"""
        WITH x AS (SELECT source || '/' || lang AS set, CASE WHEN {d('bad', 'doc_id', 40)} = 0 THEN {d('which', 'doc_id', 4)} ELSE {d('ok', 'doc_id', 2)} END AS s, CASE WHEN {d('n', 'doc_id', 3)} > 0 THEN {d('n', 'doc_id', 90)} ELSE 0 END AS notes FROM documents)
        SELECT set, (['ready', 'stale', 'refreshing', 'failed'])[max(s) + 1] AS state, CAST(sum(notes) AS BIGINT) AS notes FROM x GROUP BY set""",
    "j15_visibility_faults": f"""
        WITH a AS ({SQL_SEES('see', 3)}), b AS ({SQL_SEES('hold', 2)})
        SELECT set, principal, 'unconnected' AS fault FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT set, principal, 'unseen' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "p29_watched_refusals": f"""
        WITH f AS (SELECT regexp_extract(url, '//[^/]*/([^/?]*)', 1) AS set, regexp_extract(url, '//([^?#]*)', 1) AS path FROM pages),
        w AS (SELECT DISTINCT 'w' || {d('w', "string_split(path, '/')[1]", 6)} AS watcher, array_to_string(string_split(path, '/')[1:2], '/') AS folder FROM f WHERE {d('f', "string_split(path, '/')[1]", 3)} = 0),
        m AS (SELECT DISTINCT set, watcher, path FROM f JOIN w ON path = folder OR starts_with(path, folder || '/') WHERE set <> watcher),
        c AS (SELECT set, watcher, count(*) AS n FROM m GROUP BY ALL)
        SELECT set, watcher, n FROM c WHERE NOT list_has_all({SQL_MEMBERS3('watcher')}, {SQL_MEMBERS3('set')})""",
    "p29_visible": f"SELECT DISTINCT source AS set FROM documents WHERE {d('m1', 'source', 2)} = 0",
    "j21_nearest_home": f"""
        WITH p AS (SELECT DISTINCT regexp_extract(url, '//([^?#]*)', 1) AS path FROM pages), a AS (SELECT path, string_split(path, '/')[1] AS h, array_to_string(string_split(path, '/')[1:2], '/') AS e FROM p),
        o AS (SELECT h AS folder FROM a WHERE {d('h', 'h', 2)} = 0 UNION SELECT e FROM a WHERE {d('h', 'e', 3)} = 0),
        m AS (SELECT path, max_by('p' || {d('own', 'folder', 9)}, length(folder)) AS person FROM p JOIN o ON path = folder OR starts_with(path, folder || '/') GROUP BY path)
        SELECT path, person FROM p LEFT JOIN m USING (path)""",
    "j22_folder_coverage": f"""
        WITH p AS ({SQL_PATHS}), x AS (SELECT string_split(path, '/')[1] AS folder, ends_with(path, '.md') AS ok, {d('reg', 'id', 3)} > 0 AS held FROM p)
        SELECT folder, count(*) FILTER (ok) AS connectable, count(*) FILTER (ok AND held) AS connected, count(*) FILTER (NOT ok) AS unsupported FROM x GROUP BY folder""",
    "p25_usable": f"""
        WITH x AS (SELECT conv_id AS source, turn AS idx, conv_id || '/' || turn AS k FROM conversations)
        SELECT source, idx, CASE WHEN {d('made', 'k', 7)} = 0 THEN 'unknown' WHEN {d('rev', 'k', 6)} = 0 THEN 'unreviewed' WHEN {d('old', 'k', 5)} = 0 THEN 'stale' ELSE 'ok' END AS state FROM x""",
    "a18_bar_states": f"""
        WITH x AS (SELECT doc_id, {d('kind', 'doc_id', 2)} = 0 AS cnt, {d('bar', 'doc_id', 100)} + 1 AS bar, {d('hits', 'doc_id', 30)} AS hits, {d('hits', 'doc_id', 30)} + {d('n', 'doc_id', 20)} AS n, {d('left', 'doc_id', 8)} AS rest, {d('stop', 'doc_id', 3)} AS stop FROM documents),
        y AS (SELECT *, (bar * (n + rest) + 99) // 100 AS need FROM x),
        z AS (SELECT *, CASE WHEN n + rest = 0 THEN false WHEN cnt THEN CASE WHEN hits > bar THEN false WHEN rest = 0 THEN true END WHEN hits >= need THEN true WHEN hits + rest < need THEN false END AS state FROM y)
        SELECT doc_id, state, CAST(need AS BIGINT) AS need, CASE WHEN stop = 2 THEN 'incomplete' WHEN coalesce(state, false) AND stop = 0 THEN 'supported' ELSE 'not supported' END AS verdict FROM z""",
    "a19_gate_reasons": f"""
        WITH x AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {d(s, 'doc_id', 4)} = 0 THEN '{r}' END" for r, s in (('target did not move', 'a'), ('control lost', 'b'), ('no held-out evidence', 'c')))}], lambda z: z IS NOT NULL) AS r FROM documents)
        SELECT doc_id, CASE WHEN len(r) > 0 THEN 'REJECT' ELSE 'ACCEPT' END AS decision, array_to_string(r, '; ') AS reasons FROM x""",
    "a28_only_judge_blocks": f"""
        WITH x AS (SELECT user_id AS run, {d('arm', 'event_id', 6)} < 4 AS judge, {d('v', 'event_id', 3)} = 1 AS weak, {d('b', 'event_id', 30)} = 0 AS blocks FROM events)
        SELECT run, coalesce(bool_and(judge) FILTER (blocks), false) AS only_judge, coalesce(bool_and(judge AND weak) FILTER (blocks), false) AS only_weak FROM x GROUP BY run""",
    "a17_drift_baseline": f"""
        WITH x AS (SELECT {d('ra', 'doc_id', 3)} AS a, {d('rb', 'doc_id', 3)} AS b FROM documents), y AS (SELECT 'a' AS run, a AS v FROM x WHERE a <> b UNION ALL SELECT 'b', b FROM x WHERE a <> b)
        SELECT run, count(*) FILTER (v = 0) AS truths_blocked, count(*) FILTER (v = 1) AS lies_allowed FROM y GROUP BY run""",
    "a26_frozen_scores": f"""
        SELECT CAST(0 AS BIGINT) + (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS unknown,
               (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM documents WHERE {d('af', 'doc_id', 9)} = 0) AS worse, false AS ok""",
    "k8_merged_saved": f"""
        WITH x AS (SELECT substr(text, 1, 3) AS question, md5(text) AS gold, conv_id * 1000 + turn AS seen, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS own FROM conversations),
        k AS (SELECT *, regexp_replace({SQL_SQUEEZED.format('question')}, '[ .,;:!?]+$', '') AS key FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY own DESC, seen DESC, question DESC, gold DESC) AS n FROM k)
        SELECT key, question, gold, CAST(own AS INT) AS own FROM r WHERE n = 1""",
    "t6_retry_queue": f"""
        WITH x AS (SELECT user_id AS key, event_id AS seen, {d('k', 'event_id', 3)} AS kind, {d('ok', 'event_id', 9)} = 0 AS ok FROM events), m AS (SELECT key, max(seen) AS missed FROM x WHERE kind = 0 GROUP BY key),
        s AS (SELECT m.key, count(x.key) AS n, coalesce(bool_or(ok), false) AS done FROM m LEFT JOIN x ON x.key = m.key AND x.kind > 0 AND x.seen > missed GROUP BY m.key)
        SELECT key, n AS tries, CASE WHEN done THEN 'done' WHEN n >= 5 THEN 'dropped' ELSE 'retry' END AS state FROM s""",
    "a11_folder_units": f"{SQL_TOP}, {_units_sql()} SELECT unit, count(*) AS n FROM u8 GROUP BY unit",
    "a11_folder_rows": f"""{SQL_TOP}, {_units_sql()},
        x AS (SELECT unit, substr(path, length(unit) + 2) AS name FROM u8), r AS (SELECT unit, name, row_number() OVER (PARTITION BY unit ORDER BY name) AS k FROM x)
        SELECT unit, count(*) AS n, md5(string_agg(name, '|' ORDER BY k) FILTER (k <= 7)) AS names_md5 FROM r GROUP BY unit""",
}
