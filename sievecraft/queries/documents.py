"""Queries over documents, pages and conversations: text functions, ranking, passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions import text as T
from sievecraft.operators import ranking as R
from sievecraft.operators.chunking import chunks
from sievecraft.operators.word_search import question_terms, word_search
from sievecraft.plans import batches as B

REQUEST = "tionand the ofthe eronth anation with thering blens"
CONTEXT = ["the ention ofer", "whing thand"]


#: Bytes of an Arrow batch, where the session doesn't say otherwise: both sides of a Python function hold whole batches.
BATCH_BYTES, BATCH_SETTING, SPARKS_OWN = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Bounds the session's Arrow batches by BATCH_BYTES unless it has a bound of its own."""
    if spark.conf.get(BATCH_SETTING) == SPARKS_OWN:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# DuckDB forms of the shared expressions.
SQL_TOKENS = (
    "list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) >= 2), "
    "lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END)"
)
SQL_SQUEEZED = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


def tokens(text: str) -> str:
    return SQL_TOKENS.format(text)


def f1_tokenize(spark, sf_dir):
    words = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


def f4_word_pairs(spark, sf_dir):
    """Adjacent pairs of four-letter stems of content words, with the number of conversations' turns that hold them."""
    stems = F.transform(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) > 2), lambda w: F.substring(w, 1, 4))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", stems.alias("s")).where(F.size("s") > 1)
    pairs = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return rows.select(F.explode(F.array_distinct(pairs)).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def f7_normalised_keys(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(T.catalog_key(text)).alias("catalog"), F.md5(T.phrase_key(text)).alias("phrase"), F.md5(T.question_key(text)).alias("question"), F.md5(T.claim_key(text)).alias("claim")
    )


def f8_redact(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("r"))
    names = [F.col("r.counts")[i].alias("n_" + k.replace("-", "_")) for i, k in enumerate(T.REDACTED_KINDS)]
    return rows.select("doc_id", *names, F.md5("r.text").alias("redacted_md5"))


def _redact_sql() -> str:
    b = {k: p for k, p, _ in T.SECRETS}
    step, columns, last = "SELECT doc_id, text AS t0 FROM documents", [], 0
    for k, (kind, pattern) in enumerate(b.items()):
        columns.append(f"n{k}")
        step = (
            f"SELECT doc_id, {''.join(f'n{i}, ' for i in range(k))} len(regexp_extract_all(t{k}, '{pattern}')) AS n{k}, "
            f"regexp_replace(t{k}, '{pattern}', '[REDACTED:{kind}]', 'g') AS t{k + 1} FROM ({step})"
        )
        last = k + 1
    api = T.API_KEY
    secret = (
        "NOT regexp_full_match(m, '[0-9a-fA-F]{1,64}') AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') "
        "AND NOT (len(string_split_regex(m, '[-_]')) >= 2 AND len(list_filter(string_split_regex(m, '[-_]'), lambda p: length(p) > 12 OR (regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[0-9]')))) = 0)"
    )
    names = ", ".join(f"CAST(n{k} AS INT) AS n_{kind.replace('-', '_')}" for k, (kind, _, _) in enumerate(T.SECRETS))
    return f"""
    WITH a AS ({step}),
    g AS (SELECT *, string_split_regex(t{last}, '{api}') AS gaps, regexp_extract_all(t{last}, '{api}') AS found FROM a),
    s AS (SELECT *, list_transform(found, lambda m: {secret}) AS is_secret FROM g),
    r AS (SELECT *, list_transform(range(1, len(found) + 1), lambda i: is_secret[i] AND NOT (ends_with(gaps[i], '/') AND (gaps[i + 1][1:1] = '/' OR gaps[i + 1] = ''))) AS hit FROM s)
    SELECT doc_id, {names}, CAST(len(list_filter(hit, lambda h: h)) AS INT) AS n_api_key,
           md5(array_to_string(list_transform(range(1, len(found) + 1), lambda i: gaps[i] || CASE WHEN hit[i] THEN '[REDACTED:api-key]' ELSE found[i] END), '') || gaps[len(gaps)]) AS redacted_md5
    FROM r"""


def f14_passages(spark, sf_dir):
    """All passages of all documents; sha_led is of the passage as it is read, led by its subject."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.passages(F.col("text")).alias("p"))
    rows = rows.select("doc_id", F.get("p.passage", F.lit(0)).alias("first"), F.posexplode("p").alias("number", "p"))
    led = T.with_subject(F.col("first"), F.col("p.passage"), F.col("number"))
    return rows.select("doc_id", "p.start", F.sha2("p.passage", 256).alias("sha"), F.sha2(led, 256).alias("sha_led"))


def f13_chunks(spark, sf_dir):
    """Chunks by headings and lines; their state over lines is not for SQL."""
    return chunks(table(spark, sf_dir, "documents")).select("doc_id", "idx", "first_line", "last_line", "heading", F.sha2("text", 256).alias("sha"))


def f17_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.claims(F.col("text"))).alias("pos", "claim"))
    return rows.select("conv_id", "turn", "pos", F.md5("claim").alias("claim_md5"))


def f25_set_digest(spark, sf_dir):
    return T.set_digests(table(spark, sf_dir, "documents"), ["source"], F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)))


def b1_estimates(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(text).alias("tokens"), T.estimated_judge_tokens(text).alias("judge_tokens"))


def p10_blocked_paths(spark, sf_dir):
    """Made-up paths under the last segments of urls: every kind of blocked name occurs."""
    kind = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("page_id") % len(NAMES) + 1).cast("int"))
    path = F.concat(F.lit("/home/u/"), F.regexp_replace("url", "^[^/]*//[^/]*/", ""), F.lit("/"), kind)
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", T.is_blocked_path(F.col("path"), ("/home/u/en/1",)).alias("blocked"))


NAMES = ("notes.md", "logins.md", "a-secret.md", ".env", ".env.local", "profile/x", "Documents/y", "cookies.sqlite", "k.pem", "k.key", "id_rsa", "token.json", "credentials", "src/main.py")


def a8_document_frequency(spark, sf_dir):
    return R.document_frequencies(table(spark, sf_dir, "documents"), T.tokens(F.col("text")))


def _catalog(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text", F.array(F.element_at(lines, 1)).alias("utterances"), F.array(F.element_at(lines, -1)).alias("negatives")
    )


def r1_prefilter(spark, sf_dir):
    """The eight documents that match a request best: the top k is what the operator is for."""
    return R.prefilter(_catalog(spark, sf_dir), REQUEST, 8, CONTEXT).select("id", "score")


def r2_top_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.slices(F.col("text"), 600)).alias("p"))
    chunks = rows.select(F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("p.start").cast("string"), 9, "0")).alias("id"), F.col("p.passage").alias("text"))
    return R.top_chunks(chunks, REQUEST, 12).select("id", "score")


def r3_word_search(spark, sf_dir):
    """The twelve best files for a question; the head of a document is its source, language and first 60 characters."""
    head = F.concat_ws(" ", "source", "lang", F.substring("text", 1, 60))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), head.alias("head"), "text")
    return word_search(files, REQUEST, 12)


def b3_next_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return B.plan_calls(rows, "conv_id", "turn", T.estimated_tokens(F.col("text")) + 12, 3, 160)


def b3_call_totals(spark, sf_dir):
    return B.call_totals(b3_next_fit(spark, sf_dir), "conv_id")


def b4_records_per_call(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("questions"))
    return rows.select("conv_id", B.records_per_call(F.lit(45), F.col("questions")).alias("records"))


def b10_fit_window(spark, sf_dir):
    """Turns kept in 400 characters, the newest first, of each conversation."""
    return B.fit_window(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 400)


def _bm25_sql(corpus: str, parts: list[tuple[str, str, float]], k: int, tie: str) -> str:
    """``corpus``: SQL of id, w (words), neg (words). ``parts``: (words column, query text, weight)."""
    scores, joins = [], []
    for i, (column, query, weight) in enumerate(parts):
        joins.append(
            f"LEFT JOIN (SELECT id, sum(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS s "
            f"FROM (SELECT id, len({column}) AS len, q, len(list_filter({column}, lambda x: x = q)) AS tf FROM c, (SELECT unnest(list_distinct({query})) AS q)) "
            f"LEFT JOIN df ON df.term = q, st WHERE tf > 0 GROUP BY id) s{i} USING (id)"
        )
        scores.append(f"{weight} * coalesce(s{i}.s, 0)")
    return f"""
    WITH c AS ({corpus}),
    st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS av FROM c),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM c) GROUP BY term),
    z AS (SELECT c.id, {' + '.join(scores)} AS score FROM c {' '.join(joins)})
    SELECT id, floor(score * 1000 + 0.5) / 1000 AS score FROM z ORDER BY z.score DESC, {tie} LIMIT {k}"""


SQL_CATALOG = (
    f"SELECT doc_id AS id, list_concat(list_concat({tokens('text')}, u), u) AS w, neg "
    f"FROM (SELECT doc_id, text, {tokens('string_split(text, chr(10))[1]')} AS u, {tokens('string_split(text, chr(10))[-1]')} AS neg FROM documents)"
)
ASK, TURNS = tokens(f"'{REQUEST}'"), tokens(f"'{' '.join(CONTEXT)}'")
SQL_CHUNKS = (
    "SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || lpad(CAST(s AS VARCHAR), 9, '0') AS id, "
    f"{tokens('substring(text, CAST(s + 1 AS BIGINT), 600)')} AS w, [] AS neg FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 600)) AS s FROM documents)"
)
SQL_NEXT_FIT = """
WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) + 12 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f(conv_id, turn, size, k, call, open, n, used) AS (
  SELECT conv_id, turn, size, k, CASE WHEN size > 160 THEN -1 ELSE 0 END, 0, CASE WHEN size > 160 THEN 0 ELSE 1 END, CASE WHEN size > 160 THEN 0 ELSE size END FROM r WHERE k = 1
  UNION ALL
  SELECT r.conv_id, r.turn, r.size, r.k,
    CASE WHEN r.size > 160 THEN -1 WHEN n > 0 AND (n >= 3 OR used + r.size > 160) THEN open + 1 ELSE open END,
    CASE WHEN r.size <= 160 AND n > 0 AND (n >= 3 OR used + r.size > 160) THEN open + 1 ELSE open END,
    CASE WHEN r.size > 160 THEN n WHEN n > 0 AND (n >= 3 OR used + r.size > 160) THEN 1 ELSE n + 1 END,
    CASE WHEN r.size > 160 THEN used WHEN n > 0 AND (n >= 3 OR used + r.size > 160) THEN r.size ELSE used + r.size END
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
"""

def _cuts_sql(of: str = "SELECT doc_id, text FROM documents", key: str = "doc_id") -> str:
    """CTEs d and cuts(key, pos): the starts of passages, each cut at the nearest line end."""
    behind, before = "strpos(substring(text, pos + 3501, 1750), chr(10))", "strpos(reverse(substring(text, pos + 1751, 1750)), chr(10))"
    step = f"CASE WHEN {before} > 0 AND ({behind} = 0 OR {before} - 1 <= {behind}) THEN 3501 - {before} WHEN {behind} > 0 THEN 3500 + {behind} ELSE 3500 END"
    return f"""WITH RECURSIVE d AS ({of}), cuts({key}, pos) AS (
        SELECT {key}, CAST(0 AS BIGINT) FROM d UNION ALL SELECT cuts.{key}, pos + {step} FROM cuts JOIN d USING ({key}) WHERE length(text) - pos > 3500)"""


def _word_search_sql() -> str:
    terms, pairs = question_terms(REQUEST)
    w = lambda t: f"list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')"
    stems = "list_transform(list_filter(w, lambda x: length(x) > 2), lambda x: x[1:4])"
    return f"""
    {_cuts_sql("SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, source, lang, text FROM documents", "path")},
    f AS (SELECT path, {w("source || ' ' || lang || ' ' || substring(text, 1, 60)")} AS h, text FROM d),
    p AS (SELECT path, h, {w("substring(text, s + 1, e - s)")} AS w, s FROM (SELECT path, h, text, pos AS s, coalesce(lead(pos) OVER (PARTITION BY path ORDER BY pos), length(text)) AS e FROM f JOIN cuts USING (path))),
    z AS (SELECT path, s, w, h, len(w) + 3 * len(h) AS size FROM p),
    t AS (SELECT unnest({terms!r}) AS term),
    c AS (SELECT path, s, size, term, len(list_filter(w, lambda x: x = term)) + 3 * len(list_filter(h, lambda x: x = term)) AS tf FROM z, t),
    st AS (SELECT count(DISTINCT path) AS n, sum(size) / count(*) AS av FROM z),
    df AS (SELECT term, count(DISTINCT path) FILTER (tf > 0) AS df FROM c GROUP BY term),
    i AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st),
    tot AS (SELECT sum(idf) AS total FROM i WHERE df > 0),
    cov AS (SELECT path, sum(idf) AS covered FROM (SELECT DISTINCT path, term FROM c WHERE tf > 0) JOIN i USING (term) GROUP BY path),
    b AS (SELECT path, s, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))) AS base FROM c JOIN i USING (term), st GROUP BY path, s),
    q AS (SELECT unnest({[a for a, _ in pairs]!r}) AS a, unnest({[b for _, b in pairs]!r}) AS b),
    ph AS (SELECT path, s, sum(0.7 * (x.idf + y.idf) / 2) AS bonus FROM (SELECT path, s, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]) AS beside FROM (SELECT path, s, {stems} AS k FROM z)) zz JOIN q ON list_contains(beside, a[1:4] || ' ' || b[1:4])
           JOIN i x ON x.term = a JOIN i y ON y.term = b GROUP BY path, s),
    r AS (SELECT path, floor(max(base + coalesce(bonus, 0)) * 1000 + 0.5) / 1000 AS score FROM b LEFT JOIN ph USING (path, s) JOIN cov USING (path), tot WHERE covered / total >= 0.5 - 1e-9 GROUP BY path)
    SELECT path, score FROM r WHERE score >= (SELECT max(score) FROM r) * 0.55 ORDER BY score DESC, path LIMIT 12"""


QUERIES = {
    "f1_tokenize": f1_tokenize, "f4_word_pairs": f4_word_pairs, "f7_normalised_keys": f7_normalised_keys, "f8_redact": f8_redact, "f14_passages": f14_passages,
    "f13_chunks": f13_chunks, "f17_claims": f17_claims, "f25_set_digest": f25_set_digest, "b1_estimates": b1_estimates, "p10_blocked_paths": p10_blocked_paths, "a8_document_frequency": a8_document_frequency,
    "r1_prefilter": r1_prefilter, "r2_top_chunks": r2_top_chunks, "r3_word_search": r3_word_search, "b3_next_fit": b3_next_fit, "b3_call_totals": b3_call_totals, "b4_records_per_call": b4_records_per_call, "b10_fit_window": b10_fit_window,
}
SQL = {
    "f1_tokenize": f"SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, CAST(len(list_distinct(w)) AS INT) AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
    "f4_word_pairs": f"""WITH s AS (SELECT list_transform(list_filter({tokens('text')}, lambda w: length(w) > 2), lambda w: w[1:4]) AS s FROM conversations)
        SELECT pair, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]))) AS pair FROM s) GROUP BY pair""",
    "f7_normalised_keys": rf"""SELECT conv_id, turn, md5({SQL_SQUEEZED.format('text')}) AS catalog,
        md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS phrase,
        md5(regexp_replace({SQL_SQUEEZED.format('text')}, '[ .,;:!?]+$', '')) AS question, md5(regexp_replace({SQL_SQUEEZED.format('text')}, '[.!?]+$', '')) AS claim FROM conversations""",
    "f8_redact": _redact_sql(),
    "f14_passages": f"""{_cuts_sql()},
        p AS (SELECT doc_id, pos, text, substring(text, pos + 1, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text)) - pos) AS passage FROM cuts JOIN d USING (doc_id)),
        t AS (SELECT *, substring(coalesce(list_filter(list_transform(string_split(first_value(passage) OVER (PARTITION BY doc_id ORDER BY pos), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], ''), 1, 100) AS title FROM p)
        SELECT doc_id, CAST(pos AS INT) AS start, sha256(passage) AS sha, sha256(CASE WHEN pos = 0 OR title = '' THEN passage ELSE title || chr(10) || '...' || chr(10) || passage END) AS sha_led FROM t""",
    "f17_claims": r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_full_match(x, '\[[A-Z][A-Z0-9 _-]*:.*\]')) AS l FROM conversations),
        s AS (SELECT conv_id, turn, list_filter(flatten(list_transform(l, lambda x: list_transform(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)))),
              lambda y: len(list_filter(string_split_regex(y, '\s+'), lambda w: w <> '')) >= 4) AS s FROM l)
        SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, md5(s[i]) AS claim_md5 FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "f25_set_digest": f"""WITH x AS (SELECT source, sha256(doc_id || ':' || sha256(text)) AS h FROM documents),
        s AS (SELECT source, count(*) AS n, {', '.join(f"CAST(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) AS VARCHAR) AS s{k}" for k in range(8))} FROM x GROUP BY source)
        SELECT source, n, sha256(concat_ws(':', CAST(n AS VARCHAR), {', '.join(f's{k}' for k in range(8))})) AS digest FROM s""",
    "b1_estimates": "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(ceil(strlen(text) / 2) AS BIGINT) AS judge_tokens FROM documents",
    "p10_blocked_paths": f"""WITH p AS (SELECT page_id, '/home/u/' || regexp_replace(url, '^[^/]*//[^/]*/', '') || '/' || (['{"', '".join(NAMES)}'])[page_id % {len(NAMES)} + 1] AS path FROM pages)
        SELECT page_id, path, NOT (path = '/home/u/en/1' OR starts_with(path, '/home/u/en/1/')) AND regexp_matches(path, '(?i){"|".join(T.BLOCKED_PATHS)}') AS blocked FROM p""",
    "a8_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens('text')})) AS term FROM documents) GROUP BY term",
    "r1_prefilter": _bm25_sql(SQL_CATALOG, [("w", ASK, 1.0), ("w", TURNS, 0.35), ("neg", f"list_concat({ASK}, {TURNS})", -1.0)], 8, "id"),
    "r2_top_chunks": _bm25_sql(SQL_CHUNKS, [("w", ASK, 1.0)], 12, "id"),
    "r3_word_search": _word_search_sql(),
    "b3_next_fit": SQL_NEXT_FIT + "SELECT conv_id, turn, size, call FROM f",
    "b3_call_totals": SQL_NEXT_FIT + "SELECT conv_id, call, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM f GROUP BY conv_id, call",
    "b4_records_per_call": "SELECT conv_id, CAST(least(45, floor(255 / count(*))) AS INT) AS records FROM conversations GROUP BY conv_id",
    "b10_fit_window": """
        WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations),
        f(conv_id, turn, k, kept, used) AS (
          SELECT conv_id, turn, k, n <= 400, CASE WHEN n <= 400 THEN n ELSE 0 END FROM r WHERE k = 1
          UNION ALL SELECT r.conv_id, r.turn, r.k, used + n <= 400, CASE WHEN used + n <= 400 THEN used + n ELSE used END FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
        SELECT conv_id, turn, kept FROM f""",
}
