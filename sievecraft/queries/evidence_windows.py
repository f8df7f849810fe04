"""Queries of evidence windows: every row of conversations is composed into a window by the digits of its key, and the SQL derives the same rows from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.operators import windows as W

RULE, ITEM = "\n\n===\n\n", "\n\n---\n\n"
REPORT = "REPORT FROM {} (unverified worker claim)\n"
#: Parts of a window for each first digit of the key's MD5: T is the text, I the text with its lines as items, N the number of a change, R the role.
TEMPLATES = {
    "0123": ["[previous turn -1]\n", "I", "\n\n[previous turn -2]\n", "I", RULE, "[session receipts]\n", "T", "\nMERGED PR #", "N", " [from: gh pr merge ", "N", " @ /w]", RULE, "[current turn]\n", "I"],
    "456": ["[previous turn -1]\n", "T", "\nREPORT FROM ", "R", " (unverified worker claim)\nMERGED PR #", "N", RULE, "[session receipts]\nMERGED PR #", "N", RULE, "[current turn]\n", "I"],
    "789": ["I", RULE, "T", '\n{"number": ', "N", ', "state": "OPEN"}'],
    "ab": ["[current turn reports]\n", REPORT.format("a"), "T", "\n\n", REPORT.format("b"), "T", RULE, "[current turn]\nx"],
    "c": ["[session receipts]\n", "T", '\n{"number": ', "N", ', "state": "OPEN"}', RULE, "[current turn]\n", "I", "\n[from: gh pr merge ", "N", " @ /w]", RULE, "[session receipts]\n", "T"],
    "d": ["[current turn]\n[...older content in this turn dropped...]\n", "I"],
    "e": ["[current turn]\n", "I", ITEM, "[relayed reports in this turn]\n", REPORT.format("c"), "T", RULE, "[contributed by check arms]\n> ", "T"],
    "f": ["T", "\n#", "N", " is still open"],
}


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("window_id", F.concat_ws("-", "conv_id", "turn"))
    text = F.coalesce("text", F.lit(""))
    parts = {"T": text, "I": F.replace(text, F.lit("\n"), F.lit(ITEM)), "N": (F.col("conv_id") % 50).cast("string"), "R": F.coalesce("role", F.lit(""))}
    digit, composed = F.substring(F.md5("window_id"), 1, 1), F.lit("")
    for digits, template in TEMPLATES.items():
        composed = F.when(digit.isin(*digits), F.concat(*[parts.get(x, F.lit(x)) for x in template])).otherwise(composed)
    return rows.select("window_id", composed.alias("text"), F.concat(F.lit("PR #"), parts["N"], F.lit(" was merged. "), text).alias("draft"))


def _text(x: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


_CASES = " ".join(f"WHEN substr(md5(window_id), 1, 1) IN ({', '.join(map(repr, digits))}) THEN {' || '.join(x if x in 'TINR' else _text(x) for x in template)}" for digits, template in TEMPLATES.items())
_SLOTS = " ".join(f"WHEN '{header}' THEN {W.SLOTS[section] * 10**9}" for header, section in W.HEADERS.items())
_NAMES = " ".join(f"WHEN '{header}' THEN '{section}'" for header, section in W.HEADERS.items())
_RANKS = " ".join(f"WHEN '{section}' THEN {rank}" for section, rank in W.RANKS.items())
_CUTS = ", ".join(f"'{x}'" for x in W.CUTS)
_OPENS = f"regexp_matches(bare, '^REPORT FROM([^A-Za-z0-9_]|$)') OR bare = '{W.REGION}'"
_PREV = r"regexp_extract(bare, '^\[previous turn -(\d+)\]$', 1)"
LINES = rf"""
src AS (SELECT conv_id || '-' || turn AS window_id, coalesce(text, '') AS T, replace(coalesce(text, ''), chr(10), {_text(ITEM)}) AS I,
               CAST(conv_id % 50 AS VARCHAR) AS N, coalesce(role, '') AS R FROM conversations),
win AS (SELECT window_id, CASE {_CASES} ELSE '' END AS text, 'PR #' || N || ' was merged. ' || T AS draft FROM src),
l0 AS (SELECT window_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM win WHERE text <> ''),
l1 AS (SELECT *, trim(raw) AS bare, raw = '===' AND lag(raw) OVER w = '' AND lead(raw) OVER w = '' AND lag(raw, 2) OVER w IS NOT NULL AND lead(raw, 2) OVER w IS NOT NULL AS cand
       FROM l0 WINDOW w AS (PARTITION BY window_id ORDER BY line)),
l2 AS (SELECT *, coalesce(cand, false) AND NOT coalesce(lag(cand, 2) OVER (PARTITION BY window_id ORDER BY line), false) AS rule, {_OPENS} AS opens, bare IN ({_CUTS}) AS cut,
              CASE WHEN {_PREV} <> '' THEN CAST({_PREV} AS BIGINT) ELSE CASE bare {_SLOTS} END END AS slot,
              CASE WHEN {_PREV} <> '' THEN 'prev(' || CAST({_PREV} AS BIGINT) || ')' ELSE CASE bare {_NAMES} END END AS named FROM l1),
l3 AS (SELECT *, coalesce(bool_or(opens OR cut) OVER (PARTITION BY window_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS frozen,
              coalesce(lag(rule, 2) OVER (PARTITION BY window_id ORDER BY line), false) AS behind FROM l2),
l4 AS (SELECT *, slot IS NOT NULL AND NOT frozen AND (line = 0 OR behind) AS placed FROM l3),
l5 AS (SELECT *, coalesce(bool_or(placed) OVER (PARTITION BY window_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM l4),
l6 AS (SELECT *, placed OR (known AND NOT frozen AND slot < 1000000000) IS TRUE AS put FROM l5),
l7 AS (SELECT *, max(CASE WHEN put THEN slot END) OVER (PARTITION BY window_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM l6),
l8 AS (SELECT *, put AND (highest IS NULL OR slot > highest) AS header FROM l7),
l9 AS (SELECT *, NOT header AND (line = 0 OR (behind AND slot IS NULL AND NOT frozen AND NOT known)) AS plain FROM l8),
m0 AS (SELECT *, (header OR plain) AND behind AS ruled, header OR plain AS starts FROM l9),
m1 AS (SELECT *, coalesce(lead(ruled, 1) OVER w, false) OR coalesce(lead(ruled, 2) OVER w, false) OR coalesce(lead(ruled, 3) OVER w, false) AS glue,
              sum(CAST(starts AS INT)) OVER w AS part FROM m0 WINDOW w AS (PARTITION BY window_id ORDER BY line)),
m2 AS (SELECT window_id, line, raw, bare, opens, cut, header, part, first_value(CASE WHEN header THEN named ELSE 'unknown' END) OVER (PARTITION BY window_id, part ORDER BY line) AS section,
              CASE WHEN header THEN 'header' WHEN glue THEN 'glue' ELSE 'content' END AS class FROM m1),
m3 AS (SELECT *, section IN ('receipts', 'contributed') AS linewise, section IN ('reports', 'prev_reports') AS reported,
              min(CASE WHEN opens THEN line * 2 WHEN cut THEN line * 2 + 1 END) OVER (PARTITION BY window_id, part, class ORDER BY line) AS turn_at FROM m2),
m4 AS (SELECT *, CASE WHEN linewise OR reported OR turn_at IS NULL THEN '' WHEN turn_at % 2 = 0 THEN 'claim' ELSE 'mixed' END AS turned FROM m3),
m5 AS (SELECT *, turned <> '' AND turn_at // 2 = line AS first_turned, lag(raw) OVER s AS before,
              NOT linewise AND NOT reported AND turned = '' AND raw = '---' AND lag(raw) OVER s = '' AND lead(raw) OVER s = '' AND lag(raw, 2) OVER s IS NOT NULL AND lead(raw, 2) OVER s IS NOT NULL AS cand
       FROM m4 WINDOW s AS (PARTITION BY window_id, part, class ORDER BY line)),
m6 AS (SELECT *, coalesce(cand, false) AND NOT coalesce(lag(cand, 2) OVER (PARTITION BY window_id, part, class ORDER BY line), false) AS rule, first_turned AND bare = '{W.REGION}' AS region FROM m5),
m7 AS (SELECT *, coalesce(lag(region) OVER s, false) AS after_region, coalesce(lag(rule, 2) OVER s, false) AS after_rule FROM m6 WINDOW s AS (PARTITION BY window_id, part, class ORDER BY line)),
m8 AS (SELECT *, header OR (class = 'content' AND (before IS NULL OR linewise OR first_turned OR after_region OR (NOT linewise AND NOT reported AND turned = '' AND after_rule)
              OR ((reported OR turned = 'claim') AND regexp_matches(bare, '^REPORT FROM([^A-Za-z0-9_]|$)') AND (trim(before) = '' OR after_region)))) AS begins FROM m7),
m9 AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY window_id ORDER BY line) AS number FROM m8),
n0 AS (SELECT *, max(CASE WHEN class <> 'glue' AND NOT (bare = '' OR regexp_matches(bare, '^(={{3,}}|-{{3,}})$')) THEN line END) OVER (PARTITION BY window_id, number) AS last FROM m9),
lines AS (SELECT window_id, CAST(line AS INTEGER) AS line, raw, section, number, last IS NOT NULL AND line <= last AND class <> 'glue' AS held,
            CASE WHEN header OR region THEN 'header' WHEN section = 'receipts' THEN 'fact' WHEN section = 'contributed' OR reported OR turned = 'claim' THEN 'claim' WHEN turned = 'mixed' THEN 'mixed' ELSE 'receipt' END AS kind,
            CASE WHEN section LIKE 'prev(%' THEN -CAST(regexp_extract(section, '\d+') AS DOUBLE) ELSE CASE section {_RANKS} END END AS rank FROM n0),
pieces AS (SELECT window_id, CAST(number AS BIGINT) AS piece, min(section) AS section, min(rank) AS rank, arg_min(kind, line) AS kind, arg_min(kind, line) IN ('fact', 'receipt') AS trusted,
             min(line) AS first_line, max(line) AS last_line, arg_min(raw, line) AS first, string_agg(raw, chr(10) ORDER BY line) AS text FROM lines WHERE held GROUP BY window_id, number)"""
_IDENTITY = r"'\s*\[from:\s*(.*?)(?:\s+@\s+([^\]]*))?\]\s*$'"
_SOURCE = rf"""CASE WHEN kind = 'claim' THEN nullif(regexp_extract(rtrim(first), '^REPORT FROM (.*) \(unverified worker claim(?:, previous turn -\d+)?\)$', 1), '')
  WHEN kind IN ('receipt', 'fact') THEN nullif(concat_ws(' @ ', nullif(trim(regexp_extract(first, {_IDENTITY}, 1)), ''), nullif(trim(regexp_extract(first, {_IDENTITY}, 2)), '')), '') END"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_lines(_windows(spark, sf_dir))


def _shown(parts: DataFrame, *more: str | Column) -> DataFrame:
    return parts.select("window_id", "piece", "section", "kind", "trusted", "source", "first_line", "last_line", F.sha2("text", 256).alias("text_sha256"), *more)


_COLUMNS = f"window_id, piece, section, kind, trusted, {_SOURCE} AS source, first_line, last_line, sha256(text) AS text_sha256"


def s14_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(W.pieces(_lines(spark, sf_dir)), "rank")


def p31_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted lines and claims of each section, without headers, by their number and their digests' first."""
    told = W.select_lines(_lines(spark, sf_dir)).where(F.col("trusted") | (F.col("kind") == "claim"))  # no claim is trusted
    return told.groupBy("window_id", "section", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.min(F.md5("raw")).alias("least"))


def w9_newest_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(W.newest(W.pieces(_lines(spark, sf_dir))))


def w9_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.receipts_for(W.pieces(_lines(spark, sf_dir))).select("window_id", "number", "place", "piece", "section")


def j19_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir)
    return W.state_verdicts(windows, W.state_signals(W.window_lines(windows)))


_NUMBERS = " UNION ".join(
    f"SELECT window_id, piece, rank, section, unnest(regexp_extract_all(text, '{p}', 1)) AS number FROM pieces WHERE trusted"
    for p in (r"\bgh\s+pr\s+merge\s+(\d+)", r"\bgh\s+pr\s+(?:view|checks)\s+(\d+)", r"\(#(\d+)\)", r"#(\d+)\b", r'"number"\s*:\s*(\d+)')
)
_FIRST = " UNION ".join(
    f"SELECT window_id, line, regexp_extract(raw, '{p}', 1) AS number FROM counted"
    for p in (r"\bgh\s+pr\s+merge\s+(\d+)", r"\bgh\s+pr\s+(?:view|checks)\s+(\d+)", r"\(#(\d+)\)", r"#(\d+)\b", r'"number"\s*:\s*(\d+)')
)
_STATE = r'"number"\s*:\s*(\d+)[^{}]{0,300}?"state"\s*:\s*"(\w+)"'
_OPEN = r"(?i)#(\d+)\b[^.\n]{0,40}?\b(open|not merged|draft)\b"
J19 = rf"""WITH {LINES},
told AS (SELECT window_id, line, raw, rank, kind IN ('fact', 'receipt') AS trusted FROM lines WHERE held AND kind <> 'header'),
flagged AS (SELECT *, regexp_matches(raw, '(?i)^\s*MERGED\b') OR contains(raw, '"mergedAt"') AS bearing FROM told WHERE regexp_matches(raw, '(?i)^\s*MERGED\b|\bgh\s+pr\s+merge\s+\d+|"mergedAt"\s*:\s*"[^"]+"')),
counted AS (SELECT * FROM flagged WHERE bearing OR (trusted AND regexp_matches(raw, {_IDENTITY}))),
first AS ({_FIRST}),
signals AS (
  SELECT window_id, line, rank, number, CASE WHEN lower(said) = 'merged' THEN 'MERGED' ELSE 'NOT_MERGED' END AS state, lower(said) AS raw_state, CASE WHEN trusted THEN 2 ELSE 0 END AS strength, true AS bearing
  FROM (SELECT *, unnest(regexp_extract_all(raw, '{_STATE}', 1)) AS number, unnest(regexp_extract_all(raw, '{_STATE}', 2)) AS said FROM told)
  UNION ALL
  SELECT window_id, line, rank, number, 'MERGED', 'merged', CASE WHEN NOT trusted THEN 0 WHEN bearing THEN 2 ELSE 1 END, bearing FROM counted JOIN first USING (window_id, line) WHERE number <> ''
  UNION ALL
  SELECT window_id, line, rank, number, 'NOT_MERGED', lower(arg_min(said, i)), 0, false
  FROM (SELECT *, unnest(regexp_extract_all(raw, '{_OPEN}', 1)) AS number, unnest(regexp_extract_all(raw, '{_OPEN}', 2)) AS said, unnest(range(len(regexp_extract_all(raw, '{_OPEN}', 1)))) AS i FROM told)
  GROUP BY window_id, line, rank, number),
claimed AS (SELECT window_id, regexp_extract(draft, '(?i)PR\s*#?(\d+)\b[^.\n]{{0,30}}?\bmerged\b', 1) AS number FROM win),
met AS (SELECT s.* FROM signals s JOIN claimed USING (window_id, number)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, number ORDER BY strength DESC, coalesce(rank, '-Infinity'::DOUBLE) DESC, line DESC, state DESC, raw_state DESC, bearing DESC) AS nth FROM met) WHERE nth = 1),
rivals AS (SELECT b.window_id, b.number, arg_min(m.raw_state, m.line) AS rival FROM best b JOIN met m USING (window_id, number)
           WHERE m.state <> b.state AND m.strength = b.strength AND (m.rank IS NULL OR b.rank IS NULL OR m.rank = b.rank) GROUP BY b.window_id, b.number),
denied AS (SELECT window_id, number, arg_min(raw_state, line) AS denied FROM met WHERE state <> 'MERGED' GROUP BY window_id, number),
ruled AS (SELECT b.*, rival, denied, CASE WHEN rival IS NOT NULL THEN 'A' WHEN b.state = 'MERGED' AND NOT b.bearing AND denied IS NOT NULL THEN 'B' WHEN b.state <> 'MERGED' THEN 'C' END AS rule
          FROM best b LEFT JOIN rivals USING (window_id, number) LEFT JOIN denied USING (window_id, number))
SELECT window_id, number, rule IS NOT NULL AS blocked,
       CASE rule WHEN 'A' THEN CASE WHEN state = 'MERGED' THEN rival ELSE raw_state END WHEN 'B' THEN denied WHEN 'C' THEN raw_state END AS raw_state, rule FROM ruled"""

QUERIES = {"s14_pieces": s14_pieces, "p31_lines": p31_lines, "w9_newest_piece": w9_newest_piece, "w9_receipts": w9_receipts, "j19_verdicts": j19_verdicts}
SQL = {
    "s14_pieces": f"WITH {LINES} SELECT {_COLUMNS}, rank FROM pieces",
    "p31_lines": f"WITH {LINES} SELECT window_id, section, kind, count(*) AS n, min(line) AS first_line, min(md5(raw)) AS least FROM lines WHERE held AND kind IN ('fact', 'receipt', 'claim') GROUP BY ALL",
    "w9_newest_piece": f"WITH {LINES} SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY rank DESC, piece DESC) AS nth FROM pieces WHERE kind <> 'header' AND rank IS NOT NULL) WHERE nth = 1",
    "w9_receipts": f"WITH {LINES}, named AS ({_NUMBERS}) SELECT window_id, number, CAST(row_number() OVER (PARTITION BY window_id, number ORDER BY rank DESC NULLS LAST, piece) AS INTEGER) AS place, piece, section FROM named",
    "j19_verdicts": J19,
}
