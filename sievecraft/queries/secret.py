"""Queries of the secret scan over whole documents, and the SQL that derives the same rows from lines, windows and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.operators import secrets as S


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, in which lines of one or two words are headings, with a note by a digit of the id's MD5 (a key, a table of logins, a password)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("md5", F.md5(F.col("doc_id").cast("string")))
    headed = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?dm)^([^ \n]+ ?[^ \n]*)$", "## $1")
    digit = F.substring("md5", 1, 1)
    table = F.concat(F.lit("\n## logins\n| user | password |\n| --- | --- |\n| "), "source", F.lit(" | "), F.substring("md5", 1, 8), F.lit(" |"))
    note = F.when(digit == "0", F.concat(F.lit("\n## keys\napi_key = "), "md5")).when(digit == "1", table).when(digit == "2", F.concat(F.lit("\npassword: "), "source")).otherwise("")
    return docs.select("doc_id", "lang", "source", "md5", note.alias("note"), F.concat(headed, note).alias("text"))


DOCUMENTS = r"""
docs AS (SELECT doc_id, lang, source, md5(CAST(doc_id AS VARCHAR)) AS m, coalesce(text, '') AS raw FROM documents),
noted AS (SELECT doc_id, lang, source, m, raw, CASE substr(m, 1, 1)
            WHEN '0' THEN chr(10) || '## keys' || chr(10) || 'api_key = ' || m
            WHEN '1' THEN chr(10) || '## logins' || chr(10) || '| user | password |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || source || ' | ' || substr(m, 1, 8) || ' |'
            WHEN '2' THEN chr(10) || 'password: ' || source ELSE '' END AS note FROM docs),
d AS (SELECT doc_id, lang, source, m, note, regexp_replace(raw, '(?m)^([^ \n]+ ?[^ \n]*)$', '## \1', 'g') || note AS text FROM noted)"""
PRIVATE = "".join(chr(0xE000 + k) for k in range(36))
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"


def _luhn(d: str) -> str:
    v = f"CAST(({d})[p] AS INTEGER)"
    return f"list_sum([CASE WHEN (length({d}) - p) % 2 = 1 THEN 2 * {v} - CASE WHEN {v} > 4 THEN 9 ELSE 0 END ELSE {v} END for p in range(1, length({d}) + 1)]) % 10 = 0"


def _window(sizes: tuple[int, ...]) -> str:
    shape = " AND ".join(f"length(g[i + {k}]) = {size}" for k, size in enumerate(sizes))
    d = " || ".join(f"g[i + {k}]" for k in range(len(sizes)))
    tests = ", ".join(map(_quoted, S.TEST_CARDS))
    n = len(sizes)
    near = f"i <= 5 AND len(g) - i + 1 - {n} <= 4 AND len([x for x in g[1:i - 1] if length(x) >= 4]) <= 2 AND len([x for x in g[i + {n}:] if length(x) >= 4]) <= 2"
    led = f"(i = 1 OR (regexp_matches({d}, {_quoted(S.NETWORK)}) AND {near}))" if sum(sizes) == 16 else f"regexp_matches({d}, '^3[47]')"
    return f"({shape} AND (NOT sure OR ({_luhn(d)} AND ({d}) NOT IN ({tests}) AND {led})))"


def kinds_sql(name: str, source: str) -> str:
    """CTEs, the last of which is ``name`` (key, kinds joined by commas), for the texts of ``source`` (key, text)."""
    q = _quoted
    scrubbed = "t"
    for pattern in S.SCRUBBED:
        scrubbed = f"regexp_replace({scrubbed}, {q(pattern)}, ' ', 'g')"
    windows = " OR ".join(map(_window, ((16,), (15,), (4, 4, 4, 4), (4, 6, 5))))
    random = f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND list_aggregate(string_split(v, ''), 'entropy') >= {S.RANDOM_BITS} - 1e-9"
    words = "string_split(trim(x), ' ')"
    hits = {
        "card": f"len([g for g in [string_split_regex(r, '[ -]') for r in regexp_extract_all({scrubbed}, {q(S.DIGIT_RUN)})] if len([i for i in range(1, len(g) + 1) if {windows}]) > 0]) > 0",
        "ssn": f"len([r for r in regexp_extract_all(t, {q(S.DASHED_RUN)}) if regexp_matches(r, {q(S.SSN)}) AND NOT regexp_matches(r, {q(S.NO_SSN)})]) > 0 OR regexp_matches(t, {q(S.SSN_LABEL)})",
        "token": f"regexp_matches(t, {q(S.TOKEN)})",
        "assignment": f"len([v for v in regexp_extract_all(t, {q(S.ASSIGNMENT)}, 1) if {random}]) > 0",
        "password": f"len([v for v in regexp_extract_all(t, {q(S.PASSWORD)}, 1) if NOT regexp_matches(v, {q(S.NO_VALUE)})]) > 0 OR len([v for v in regexp_extract_all(t, {q(S.PASSWORD_IS)}, 1) if NOT regexp_matches(v, {q(S.NO_VALUE)}) AND regexp_matches(v, '[0-9!@#$%^&*?]')]) > 0",
        "table": f"key IN (SELECT key FROM {name}_t)",
        "seed": f"len([x for x in string_split(t, chr(10)) if regexp_matches(x, {q(S.SEED)}) AND len(list_distinct({words})) >= len({words}) - 1]) > 0",
        "key-block": f"regexp_matches(t, {q(S.KEY_BLOCK)})",
    }
    listed = ", ".join(f"CASE WHEN {hits[k]} THEN '{k}' END" for k in S.KINDS)
    cells = "[regexp_replace(c, '^[ *_`]+|[ *_`]+$', '', 'g') for c in string_split(regexp_replace(trim(line), '^[|]+|[|]+$', '', 'g'), '|')]"
    return f"""
{name}_v AS (SELECT key, text, translate(translate(text, {q(S.ZERO_WIDTH)}, ''), {q(S.FULL_WIDTH)}, {q(S.ASCII)}) AS seen FROM {source}),
{name}_f AS (SELECT key, NOT regexp_matches(regexp_replace(text, '[0-9]', '', 'g'), '\\p{{Nd}}') AS sure,
  regexp_replace(regexp_replace(translate(lower(seen), '{LETTERS}', '{PRIVATE}'), '[\\p{{L}}\\p{{M}}]', 'x', 'g'), '\\p{{Nd}}', '0', 'g') AS f FROM {name}_v),
{name}_s AS (SELECT key, sure, translate(regexp_replace(f, '[^\\x0A\\x20-\\x7E\\x{{E000}}-\\x{{E023}}]', ' ', 'g'), '{PRIVATE}', '{LETTERS}') AS t FROM {name}_f),
{name}_l AS (SELECT key, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM {name}_s WHERE contains(t, '|')),
{name}_g AS (SELECT key, line, pos, ltrim(line, ' ') LIKE '|%' AS piped, sum(CASE WHEN ltrim(line, ' ') LIKE '|%' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos) AS grp FROM {name}_l),
{name}_c AS (SELECT key, line, {cells} AS cells, first_value({cells}) OVER w AS head, row_number() OVER w AS nth FROM {name}_g WHERE piped WINDOW w AS (PARTITION BY key, grp ORDER BY pos)),
{name}_t AS (SELECT DISTINCT key FROM {name}_c WHERE nth > 1 AND NOT regexp_matches(line, '^[ |:-]+$')
  AND len([i for i in range(1, len(head) + 1) if regexp_matches(head[i], {q(S.COLUMN_LABEL)}) AND cells[i] <> '' AND NOT regexp_matches(cells[i], {q(S.NO_VALUE)})]) > 0),
{name} AS (SELECT key, concat_ws(',', {listed}) AS kinds FROM {name}_s)"""


def f10_secret_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.array_join(S.secret_kinds(F.col("text")), ",").alias("kinds"))


F10 = f"WITH {DOCUMENTS}, s AS (SELECT doc_id AS key, text FROM d), {kinds_sql('k', 's')} SELECT key AS doc_id, kinds FROM k"


def f11_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be shown of each document: sections with secrets are withheld, texts that are secret for the most part are held whole."""
    shown = S.without_secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    return shown.select("doc_id", F.sha2("shown", 256).alias("shown_sha256"), "n_lines", "n_held", "n_bad", F.array_join("kinds", ",").alias("kinds"))


F11 = f"""WITH {DOCUMENTS}, s AS (SELECT doc_id AS key, text FROM d), {kinds_sql("k", "s")},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text <> ''),
fenced AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[ \\t]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS inside FROM l),
parts AS (SELECT doc_id, line, pos, sum(CASE WHEN inside = 0 AND regexp_matches(line, '^#{{1,6}}[ \\t]+.*[^ \\t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM fenced),
whole AS (SELECT doc_id || ':' || part AS key, doc_id, part, string_agg(line, chr(10) ORDER BY pos) AS text FROM parts GROUP BY doc_id, part),
ws AS (SELECT key, text FROM whole), {kinds_sql("pk", "ws")},
flagged AS (SELECT p.doc_id, line, pos, CASE WHEN pk.kinds <> '' THEN 1 ELSE 0 END AS bad FROM parts p JOIN pk ON pk.key = p.doc_id || ':' || part),
near AS (SELECT *, max(bad) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {S.MARGIN} PRECEDING AND {S.MARGIN} FOLLOWING) AS held FROM flagged),
marked AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM near),
clean AS (SELECT doc_id AS key, string_agg(CASE WHEN held = 0 THEN line WHEN before = 0 THEN '{S.WITHHELD}' ELSE '' END, chr(10) ORDER BY pos) AS text, count(*) AS n_lines, sum(held) AS n_held FROM marked GROUP BY doc_id),
cs AS (SELECT key, text FROM clean), {kinds_sql("ck", "cs")},
bad AS (SELECT doc_id AS key, count(*) AS n FROM whole JOIN pk USING (key) WHERE kinds <> '' GROUP BY doc_id),
told AS (SELECT k.key, k.kinds, coalesce(n_lines, 0) AS n_lines, coalesce(n_held, 0) AS n_held, coalesce(bad.n, 0) AS n_bad,
                CASE WHEN k.kinds = '' THEN s.text WHEN bad.n > 0 AND n_held <= {S.MOST_HELD} * n_lines AND ck.kinds = '' THEN clean.text END AS shown
         FROM k JOIN s USING (key) LEFT JOIN clean USING (key) LEFT JOIN ck USING (key) LEFT JOIN bad USING (key))
SELECT key AS doc_id, sha256(shown) AS shown_sha256, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(CASE WHEN shown IS NULL THEN n_lines WHEN kinds = '' THEN 0 ELSE n_held END AS BIGINT) AS n_held, CAST(n_bad AS BIGINT) AS n_bad, kinds FROM told"""


def _path() -> Column:
    digit, word = F.substring("md5", 1, 1), F.substring("md5", 1, 6)
    name = F.when(digit == "3", F.concat(F.lit("Password-"), word, F.lit("1-notes.md"))).when(digit == "4", "tokenizer.py").when(digit == "5", F.concat(F.lit("api_key_7"), word, F.lit("/x")))
    return F.concat("source", F.lit("/"), name.otherwise(F.col("doc_id").cast("string")))


def f26_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of whole documents: kinds in the strings of the payload, and paths with a keyword joined to a value. The note under ``id`` isn't read."""
    docs = _documents(spark, sf_dir).withColumn("path", _path())
    notes = F.struct("lang", F.array("source", "note").alias("notes"))
    payload = F.to_json(F.struct(F.col("note").alias("id"), "text", notes.alias("more")))
    return docs.select("doc_id", F.array_join(S.payload_kinds(payload), ",").alias("kinds"), S.path_has_secret(F.col("path")).alias("secret_path"), S.redacted_path(F.col("path")).alias("path"))


F26 = f"""WITH {DOCUMENTS}, s AS (SELECT doc_id || ':t' AS key, text FROM d UNION ALL SELECT doc_id || ':n', note FROM d), {kinds_sql("k", "s")},
p AS (SELECT doc_id, source || '/' || CASE substr(m, 1, 1) WHEN '3' THEN 'Password-' || substr(m, 1, 6) || '1-notes.md' WHEN '4' THEN 'tokenizer.py'
        WHEN '5' THEN 'api_key_7' || substr(m, 1, 6) || '/x' ELSE CAST(doc_id AS VARCHAR) END AS path, a.kinds || ',' || b.kinds AS kinds
      FROM d JOIN k a ON a.key = doc_id || ':t' JOIN k b ON b.key = doc_id || ':n')
SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN list_contains(string_split(kinds, ','), '{k}') THEN '{k}' END" for k in S.KINDS)}) AS kinds,
       regexp_matches(path, '(Password-|api_key_)[a-z]*[0-9]') AS secret_path,
       regexp_replace(regexp_replace(path, 'Password-[a-z0-9]*[0-9][a-z0-9]*-notes', 'password-[REDACTED]'), 'api_key_[a-z]*[0-9][a-z0-9]*', 'api_key-[REDACTED]') AS path FROM p"""

QUERIES = {"f10_secret_kinds": f10_secret_kinds, "f11_withheld": f11_withheld, "f26_payloads": f26_payloads}
SQL = {"f10_secret_kinds": F10, "f11_withheld": F11, "f26_payloads": F26}
