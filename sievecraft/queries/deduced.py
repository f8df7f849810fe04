"""Queries of facts over windows and of contradicted claims: each row of conversations with notes by digits of its key, and the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.operators import window_facts as W
from sievecraft.operators.views import STRICTNESS

#: Lines put behind the text of a row, by the first digit of its key's MD5: N is a number of the conversation, M another.
NOTES = {
    "0123": ["\n[session receipts]\nREMOVED: cfg::a", "N", ", cfg::b\n===\n[current turn]\ncfg::card", "M", " 12 34\ncfg::cardx 5\nbus-1 (cfg::dose  ~ every 152t) cfg::dose"],
    "4567": ["\nMERGED PR #", "N", "\n3 of 7 cases passed\n('x', 'allow', 'block'), ('y', 'block', 'allow')\n('z', 'allow', 'ask')"],
    "89ab": ["\n[current turn]\ngh pr merge ", "N", "\n002/9 rows\nuntagged -> role-d (cfg::dose ~ every 1t)\ncfg::card", "M", " 1,200 7"],
    "cd": ["\n[previous turn -1]\nDELETED cfg::card", "M", "\n(#", "N", ") \"mergedAt\": \"x\"\n('x', 'allow', 'other')"],
    "ef": [],
}
#: What the draft says before the text, by the second digit.
DRAFTS = {
    "0123": ["I deleted card", "M", " and kept the rest. It rides every turn with dose."],
    "4567": ["All cases passed: PR #", "N", " merged, PR #99 is merged; 5 PRs merged."],
    "89ab": ["Each of the rows is fine. Three pull requests were merged, or so. Not merged: PR #", "N", "."],
    "cdef": ["Every item is merged now. cfg::card", "M", " is gone, every 152 turns cfg::dose, all allow."],
}


def _composed(parts: dict[str, Column], templates: dict[str, list[str]], digit: Column) -> Column:
    out = F.lit("")
    for digits, template in templates.items():
        out = F.when(digit.isin(*digits), F.concat(F.lit(""), *[parts.get(x, F.lit(x)) for x in template])).otherwise(out)
    return out


def _quoted(x: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


def _composed_sql(templates: dict[str, list[str]], place: int) -> str:
    cases = " ".join(f"WHEN substr(md5(key), {place}, 1) IN ({', '.join(map(repr, digits))}) THEN {' || '.join(['' + chr(39) * 2, *[x if x in ('N', 'M') else _quoted(x) for x in t]])}" for digits, t in templates.items())
    return f"CASE {cases} END"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return rows.select("key", "conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"), (F.col("conv_id") % 50).cast("string").alias("N"), (F.col("conv_id") % 7).cast("string").alias("M"), F.md5("key").alias("md5"))


def g6_window_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    parts = {"N": F.col("N"), "M": F.col("M")}
    text = F.concat("t", _composed(parts, NOTES, F.substring("md5", 1, 1)))
    draft = F.concat(_composed(parts, DRAFTS, F.substring("md5", 2, 1)), F.lit(" "), "t")
    return W.window_facts(rows.select(F.col("key").alias("window_id"), text.alias("text"), draft.alias("draft")))


_ROWS = f"""src AS (SELECT conv_id || '-' || turn AS key, conv_id, turn, coalesce(text, '') AS t, CAST(conv_id % 50 AS VARCHAR) AS N, CAST(conv_id % 7 AS VARCHAR) AS M FROM conversations),
win AS (SELECT key, conv_id, t || {_composed_sql(NOTES, 1)} AS text, {_composed_sql(DRAFTS, 2)} || ' ' || t AS draft FROM src)"""
_IDS = r"""([x for x in [regexp_replace({0}, '[.,;:!?)''"]+$', '') for {0} in regexp_extract_all({1}, '\b([A-Za-z][A-Za-z0-9_.\-]*(?:::[A-Za-z0-9_.\-]+)+)', 1)] if x <> ''])"""
_TAIL = r"list_last(string_split({0}, '::'))"
_MENTION = r"(contains({1}, {0}) OR (length(list_last(string_split({0}, '::'))) >= 4 AND regexp_matches({1}, '(^|[^A-Za-z0-9_.:\-])' || regexp_escape(list_last(string_split({0}, '::'))) || '([^A-Za-z0-9_.\-]|$)')))"
_PRS = ", ".join(f"nullif(regexp_extract(raw, '{p}', 1), '')" for p in (r"\bgh\s+pr\s+merge\s+(\d+)", r"\bgh\s+pr\s+(?:view|checks)\s+(\d+)", r"\(#(\d+)\)", r"#(\d+)\b", r'"number"\s*:\s*(\d+)'))
_STRICT = "CASE lower(trim({0})) " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in STRICTNESS) + " END"
_CLAIMS = " UNION ALL ".join(f"SELECT key, unnest(regexp_extract_all(draft, '{p}', 0)) AS m, unnest(regexp_extract_all(draft, '{p}', 1)) AS n FROM win" for p in W.DRAFT_MERGES)
_TOTALS = " UNION ALL ".join(f"SELECT key, unnest(regexp_extract_all(draft, '{p}', 1)) AS word FROM win" for p in W.MERGE_TOTALS)
_WORDS = "CASE lower(word) " + " ".join(f"WHEN '{w}' THEN {k + 1}" for k, w in enumerate(W.WORD_NUMBERS)) + " ELSE TRY_CAST(word AS BIGINT) END"
G6 = rf"""WITH {_ROWS},
l0 AS (SELECT key, regexp_replace(unnest(string_split(text, chr(10))), '\s+$', '') AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM win),
l1 AS (SELECT key, line, raw, coalesce(last_value(CASE WHEN regexp_matches(trim(raw), '{W.HEADER}') THEN trim(raw) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY line ROWS UNBOUNDED PRECEDING), 'the evidence window') AS label FROM l0),
lines AS (SELECT * FROM l1 WHERE trim(raw) <> '' AND NOT regexp_matches(trim(raw), '{W.HEADER}') AND NOT regexp_matches(raw, '{W.RULE}')),
removals AS (SELECT key, line, label, unnest({_IDS.format("y", f"regexp_extract(raw, '{W.REMOVED}', 2)")}) AS ident, unnest(range(len({_IDS.format("y", f"regexp_extract(raw, '{W.REMOVED}', 2)")}))) AS pos FROM lines WHERE regexp_matches(raw, '{W.REMOVED}')),
removed AS (SELECT key, ident, min(line * 1000 + pos) AS o, arg_min(label, line * 1000 + pos) AS label FROM removals GROUP BY ALL),
idents AS (SELECT key, line, label, raw, unnest({_IDS.format("y", "raw")}) AS ident, unnest(range(len({_IDS.format("y", "raw")}))) AS pos FROM lines),
known AS (SELECT key, ident, min(line * 1000 + pos) AS o FROM idents GROUP BY ALL),
cl0 AS (SELECT key, trim(unnest(string_split(regexp_replace(regexp_replace(trim(draft), '([.!?])\s+', '\1' || chr(1), 'g'), ';\s*|:\s+|\s+and\s+', chr(1), 'g'), chr(1)))) AS u FROM win),
cl AS (SELECT key, u FROM cl0 WHERE u <> '' AND regexp_matches(u, '{W.DRAFT_REMOVAL}')),
claimed AS (SELECT DISTINCT k.key, k.ident, k.o FROM known k JOIN cl USING (key) WHERE (k.key, k.ident) NOT IN (SELECT (key, ident) FROM removed) AND {_MENTION.format("k.ident", "cl.u")}),
still AS (SELECT c.key, c.ident, c.o, arg_min(l.label, l.line) AS label FROM claimed c JOIN lines l USING (key)
          WHERE contains(l.raw, c.ident) AND NOT regexp_matches(l.raw, '{W.REMOVED}') AND len(regexp_extract_all(substr(l.raw, strpos(l.raw, c.ident) + length(c.ident)), '\b[0-9,]+\b')) >= 2 GROUP BY ALL),
cad0 AS (SELECT i.*, regexp_replace(regexp_extract(i.raw, '{W.CADENCE}'), '\s+', ' ', 'g') AS said, draft FROM idents i JOIN win USING (key) WHERE regexp_matches(draft, '{W.DRAFT_CADENCE}')),
cad AS (SELECT key, ident, min(line * 1000 + pos) AS o, arg_min(label, line * 1000 + pos) AS label, arg_min(said, line * 1000 + pos) AS said FROM cad0 WHERE said <> '' AND {_MENTION.format("ident", "draft")} GROUP BY ALL),
cadn AS (SELECT *, TRY_CAST(nullif(replace(regexp_extract(said, '{W.EVERY}', 1), ',', ''), '') AS BIGINT) AS n FROM cad),
nm AS (SELECT key, line, unnest(regexp_extract_all(raw, '{W.N_OF_M}', 1)) AS a, unnest(regexp_extract_all(raw, '{W.N_OF_M}', 2)) AS b, lower(regexp_replace(unnest(regexp_extract_all(raw, '{W.N_OF_M}', 3)), '\s+', ' ', 'g')) AS label,
              unnest(range(len(regexp_extract_all(raw, '{W.N_OF_M}', 1)))) AS pos FROM lines),
tr AS (SELECT key, unnest(regexp_extract_all(raw, $${W.TUPLE_ROW}$$, 2)) AS e, unnest(regexp_extract_all(raw, $${W.TUPLE_ROW}$$, 3)) AS a FROM lines),
words AS (SELECT key, unnest(string_split_regex(x, '[ _-]+')) AS word FROM (SELECT key, label AS x FROM nm UNION ALL SELECT key, lower(e) FROM tr UNION ALL SELECT key, lower(a) FROM tr)),
asked AS (SELECT DISTINCT key FROM words JOIN win USING (key) WHERE length(word) >= 4 AND regexp_matches(draft, '{W.UNIVERSAL}') AND contains(lower(draft), word)),
tot AS (SELECT key, count(*) AS n, count(*) FILTER ({_STRICT.format("e")} IS NULL OR {_STRICT.format("a")} IS NULL) AS unknown, count(*) FILTER ({_STRICT.format("a")} > {_STRICT.format("e")}) AS s, count(*) FILTER ({_STRICT.format("a")} < {_STRICT.format("e")}) AS p FROM tr JOIN asked USING (key) GROUP BY key),
act AS (SELECT tr.key, a, count(*) AS k, any_value(n) AS n FROM tr JOIN tot USING (key) GROUP BY ALL),
rec AS (SELECT key, TRY_CAST(coalesce({_PRS}) AS BIGINT) AS number, line, label FROM lines WHERE regexp_matches(raw, '{W.MERGE_RECEIPT}')),
found AS (SELECT key, number, arg_min(label, line) AS label FROM rec WHERE number IS NOT NULL GROUP BY key, number),
said AS ({_CLAIMS}),
merged AS (SELECT DISTINCT key, CAST(n AS BIGINT) AS number FROM said WHERE NOT regexp_matches(substr(m, 1, strpos(m, n) - 1) || ' ' || substr(m, strpos(m, n) + length(n)), '{W.MERGE_BREAK}')),
anyline AS (SELECT DISTINCT key FROM lines),
totals AS (SELECT win.key, regexp_matches(draft, '{W.MERGE_UNIVERSAL}') AS every, (SELECT max({_WORDS}) FROM ({_TOTALS.replace("FROM win", "FROM win w2 WHERE w2.key = win.key")}) x) AS total FROM win),
counts AS (SELECT t.key, every, total, coalesce(c.n, 0) AS n FROM totals t JOIN anyline USING (key) LEFT JOIN (SELECT key, count(*) AS n FROM found GROUP BY key) c USING (key)),
facts AS (
  SELECT key, 0 AS step, o, 'delete-claim' AS family, ident || ' removed per ' || label || '.' AS sentence FROM removed
  UNION ALL SELECT key, 1, o, 'delete-claim', ident || ' still present in ' || label || ' after the claimed removal.' FROM still
  UNION ALL SELECT key, 10, o, 'cadence', ident || ' cadence in ' || label || ': "' || said || '"' || CASE WHEN n > 1 THEN ' — that is every ' || n || ' turns, not every turn.' WHEN n = 1 THEN ' — that is every turn.' ELSE '.' END FROM cadn
  UNION ALL SELECT key, 20, line * 1000 + pos, 'result-table', 'table shows ' || CAST(a AS BIGINT) || ' of ' || CAST(b AS BIGINT) || ' ' || label || '.' FROM nm JOIN asked USING (key)
  UNION ALL SELECT key, 21, row_number() OVER (PARTITION BY key ORDER BY k DESC, a), 'result-table', 'table shows ' || k || ' of ' || n || ' mismatch rows with actual ' || a || '.' FROM act
  UNION ALL SELECT key, 22, 0, 'result-table', 'table shows ' || s || ' of ' || n || ' mismatch rows stricter than expected, ' || p || ' more permissive.' FROM tot WHERE unknown = 0
  UNION ALL SELECT key, 30, number, 'merge-claim', 'merge receipt found for PR #' || number || ' in ' || label || '.' FROM found
  UNION ALL SELECT key, 31, number, 'merge-claim', 'no merge receipt for PR #' || number || ' in window.' FROM merged JOIN anyline USING (key) WHERE (key, number) NOT IN (SELECT (key, number) FROM found)
  UNION ALL SELECT key, 32, 0, 'merge-claim', 'merge receipts in window: ' || n || '; ' || CASE WHEN total IS NOT NULL THEN 'the draft claims ' || total || ' merged' ELSE 'the draft claims every item merged' END
    || CASE WHEN n = 0 THEN '; the window carries no merge receipt at all, so this claim is unsupported here.' ELSE '; the draft''s session-wide total cannot be checked here.' END
    FROM counts WHERE total > n OR (total IS NULL AND every)),
once AS (SELECT key, sentence, min(step) AS step, arg_min(o, CAST(step AS BIGINT) * 1000000000 + o) AS o, arg_min(family, step) AS family FROM facts GROUP BY key, sentence),
placed AS (SELECT key AS window_id, CAST(row_number() OVER (PARTITION BY key ORDER BY step, o, sentence) AS INTEGER) AS place, family, sentence FROM once)
SELECT * FROM placed WHERE place <= {W.MOST_FACTS}"""

#: What is claimed behind the text of a row, by the first digit of its key's MD5.
CLAIMS = {
    "01": ["The full suite ran: ", "N", " passed."], "2": ["I ran it and added ", "N", " passed tests."], "34": ["src/f", "M", ".py is tracked now."], "5": ["src/f", "M", ".py is not committed."],
    "67": ["See src/f", "M", ".py and branch b", "M", "."], "8": ["src/f", "M", ".py was removed, h", "M", "abc has it."], "9ab": ["All is pushed, PR #", "M", " merged and checks are green."], "cd": ["PR #", "M", " checks all passed, unpushed."], "ef": ["Nothing."],
}


def g5_contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, with what they claim, against facts of their conversation drawn by digits."""
    rows = _rows(spark, sf_dir)
    parts = {"N": F.col("N"), "M": F.col("M")}
    claims = rows.select(F.col("conv_id").alias("run"), F.col("turn").alias("place"), F.concat("t", F.lit(" "), _composed(parts, CLAIMS, F.substring("md5", 1, 1))).alias("claim"))
    runs = rows.select("conv_id", "N", "M").distinct().withColumn("md5", F.md5(F.concat(F.lit("run"), F.col("conv_id").cast("string"))))
    digit = lambda k: F.conv(F.substring("md5", k, 1), 16, 10).cast("long")
    fact = lambda at, kind, name, flag=None, number=None, said=None: F.struct(
        F.lit(at).alias("at"), F.lit(kind).alias("kind"), name.alias("name"), (F.lit(None).cast("boolean") if flag is None else flag).alias("flag"),
        (F.lit(None).cast("long") if number is None else number.cast("long")).alias("number"), (F.lit(None).cast("string") if said is None else said).alias("said"))
    path = F.concat(F.lit("src/f"), F.col("M"), F.lit(".py"))
    even = lambda k: digit(k) % 2 == 0
    facts = [
        fact(0, "tests", F.lit("run"), number=digit(1) + 20), fact(1, "tests", F.lit("again"), number=digit(2)), fact(2, "tracked", path, even(3)), fact(3, "tracked", path, even(4)), fact(4, "length", path, even(5)),
        fact(5, "commit", F.concat(F.lit("h"), F.col("M"), F.lit("abc")), even(6)), fact(6, "branch", F.concat(F.lit("b"), F.col("M")), even(7)), fact(7, "push-state", F.lit("main"), number=digit(8) % 3),
        fact(8, "pr-state", F.col("M"), said=F.when(even(9), "OPEN").otherwise("merged")), fact(9, "pr-checks", F.col("M"), said=F.when(even(10), "lint, test").otherwise("")),
    ]
    return W.contradicted(claims, runs.select(F.col("conv_id").alias("run"), F.explode(F.array(*facts)).alias("f")).select("run", "f.*"))


_DIGIT = lambda k: f"CAST('0x' || substr(m5, {k}, 1) AS BIGINT)"
_HAS = lambda p: f"regexp_matches(claim, '{p}')"
G5 = rf"""WITH src AS (SELECT conv_id || '-' || turn AS key, conv_id, turn, coalesce(text, '') AS t, CAST(conv_id % 50 AS VARCHAR) AS N, CAST(conv_id % 7 AS VARCHAR) AS M FROM conversations),
c AS (SELECT conv_id AS run, turn AS place, M, t || ' ' || {_composed_sql(CLAIMS, 1)} AS claim FROM src),
r AS (SELECT DISTINCT conv_id AS run, md5('run' || conv_id) AS m5 FROM conversations),
x AS (SELECT c.*, 'src/f' || M || '.py' AS path, {_DIGIT(1)} + 20 AS tests, {_DIGIT(4)} % 2 = 0 AS tracked, {_DIGIT(5)} % 2 = 0 AS there, {_DIGIT(6)} % 2 = 0 AS logged, {_DIGIT(7)} % 2 = 0 AS branch,
             {_DIGIT(8)} % 3 AS ahead, CASE WHEN {_DIGIT(9)} % 2 = 0 THEN 'OPEN' ELSE 'merged' END AS state, CASE WHEN {_DIGIT(10)} % 2 = 0 THEN 'lint, test' ELSE '' END AS failing,
             regexp_extract_all(claim, '{W.PASSING}', 1) AS passed FROM c JOIN r USING (run)),
y AS (SELECT *, CASE
    WHEN {_HAS(W.RUN_CUES)} AND NOT {_HAS(W.DELTA)} AND len(passed) = 1 AND CAST(passed[1] AS BIGINT) <> tests THEN ['1', 'run', 'claims ' || CAST(passed[1] AS BIGINT) || ' passing but the run reports ' || tests || ' passed']
    WHEN contains(claim, path) AND {_HAS(W.TRACKED)} AND NOT {_HAS(W.NOT_TRACKED)} AND NOT tracked THEN ['2', path, 'claims ' || path || ' is tracked, but it is not in the git index']
    WHEN contains(claim, path) AND {_HAS(W.NOT_TRACKED)} AND tracked THEN ['2', path, 'claims ' || path || ' is not tracked, but it is in the git index']
    WHEN contains(claim, path) AND NOT there AND NOT regexp_matches(replace(claim, path, ' '), '{W.ABSENT}') THEN ['3', path, 'names ' || path || ', which does not exist on disk']
    WHEN contains(claim, 'h' || M || 'abc') AND NOT logged THEN ['4', 'h' || M || 'abc', 'names commit h' || M || 'abc, which is not in the log']
    WHEN contains(claim, 'b' || M) AND NOT branch THEN ['5', 'b' || M, 'names branch b' || M || ', which does not exist'] END AS a,
  CASE WHEN {_HAS(W.PUSHED)} AND NOT {_HAS(W.NOT_PUSHED)} AND ahead > 0 THEN ['6', 'main', 'claims pushed, but main has ' || ahead || ' commit(s) not pushed'] END AS b,
  CASE WHEN regexp_extract(claim, '{W.CLAIM_NUMBER}', 1) = M AND {_HAS(W.CLAIM_MERGED)} AND state <> 'merged' THEN ['7', M, 'claims PR #' || M || ' is merged, but its state is ' || state]
       WHEN regexp_extract(claim, '{W.CLAIM_NUMBER}', 1) = M AND {_HAS(W.CHECKS_GREEN)} AND failing <> '' THEN ['8', M, 'claims PR #' || M || ' checks are green, but failing: ' || failing] END AS c FROM x),
z AS (SELECT run, place, a AS v FROM y WHERE a IS NOT NULL UNION ALL SELECT run, place, b FROM y WHERE a IS NULL AND b IS NOT NULL UNION ALL SELECT run, place, c FROM y WHERE a IS NULL AND c IS NOT NULL)
SELECT run, place, CAST(v[1] AS INTEGER) AS rule, v[2] AS name, v[3] AS reason FROM z"""

QUERIES = {"g5_contradicted": g5_contradicted, "g6_window_facts": g6_window_facts}
SQL = {"g5_contradicted": G5, "g6_window_facts": G6}
