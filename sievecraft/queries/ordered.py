"""Queries of seeded orders and of excerpts over whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once
from sievecraft.operators import excerpts as X
from sievecraft.operators import ordering as O

SEED, FRACTION = 42, 0.3


def w5_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a seed's order, and whether they are held out."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    placed = O.in_order(rows, ["doc_id"], "shuffle", SEED)
    split = O.with_split(rows, ["doc_id"], FRACTION, SEED)
    return placed.join(split, "doc_id").select("doc_id", "rank", "place", "held_out")


def _network() -> str:
    keys, columns, a, b = O.round_keys(SEED), [], "a0", "b0"
    for k, (factor, term) in enumerate(keys):
        moved, by, size = (a, b, "small") if k % 2 == 0 else (b, a, "large")
        name = f"{moved[0]}{k + 1}"
        columns.append(f"({moved} + (((({by} % {O.PRIME}) * ({by} % {O.PRIME})) % {O.PRIME}) * {factor} + {term}) % {O.PRIME}) % {size} AS {name}")
        a, b = (name, b) if k % 2 == 0 else (a, name)
    return ", ".join(["x // large AS a0", "x % large AS b0", *columns]) + f", {a} * large + {b} AS y"


W5 = f"""WITH RECURSIVE k AS (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) AS bits FROM documents),
s AS (SELECT n, CAST(1 AS BIGINT) << (bits // 2) AS small, CAST(1 AS BIGINT) << (bits - bits // 2) AS large FROM k),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents),
w(doc_id, rank, y, n) AS (
  SELECT doc_id, rank, y, n FROM (SELECT doc_id, rank, n, {_network().replace('x //', 'rank //').replace('x %', 'rank %')} FROM r, s)
  UNION ALL SELECT doc_id, rank, y, n FROM (SELECT doc_id, rank, w.n, {_network().replace('x //', 'w.y //').replace('x %', 'w.y %').replace(' AS y', ' AS z')} FROM w, s WHERE w.y >= w.n) t(doc_id, rank, n, {', '.join(f'c{i}' for i in range(2 + O.ROUNDS))}, y))
SELECT doc_id, CAST(rank AS BIGINT) AS rank, CAST(y AS BIGINT) AS place, y < CAST(floor(n * {FRACTION} + 0.5) AS BIGINT) AS held_out FROM w WHERE y < n"""


def f19_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, lines of one or two words as headings: what is read of each, and what is quoted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?dm)^([^ \n]+ ?[^ \n]*)$", "## $1")
    path = F.concat("source", F.lit("/doc "), F.col("doc_id").cast("string"), F.lit(".md"))
    # one expression a row: columns that are used twice would be computed twice
    told = lambda s: F.struct(
        F.size(s["headings"]).alias("n_headings"), F.md5(F.array_join(s["headings"], "\n")).alias("headings_md5"), F.size(s["samples"]).alias("n_samples"),
        F.md5(F.array_join(s["samples"], "\n--\n")).alias("samples_md5"), X.quoted(path, s).alias("q"))
    rows = docs.select("doc_id", F.explode(F.array(bound_once(X.excerpt(text), told))).alias("r"))
    return rows.select("doc_id", "r.n_headings", "r.headings_md5", "r.n_samples", "r.samples_md5", "r.q.description", "r.q.question", "r.q.subject")


def _samples() -> tuple[str, str]:
    """A CTE for each sample, which goes on from the one before, and the list of those that are taken."""
    steps, last = ["s0 AS (SELECT * FROM e)"], "-1"
    for i in range(X.SAMPLES):
        place = f"{X.START} + {i} * (length(text) - {X.START}) // {X.SAMPLES}"
        cut = f"CASE WHEN p{i} + {X.SAMPLE_CHARS} >= length(text) THEN q{i} ELSE regexp_replace(q{i}, '(?s)^(.+)[ \\n][^ \\n]*$', '\\1') END"
        steps += [
            f"a{i} AS (SELECT *, strpos(substr(text, {place} + 1), chr(10)) AS n{i} FROM s{i})",
            f"b{i} AS (SELECT *, CASE WHEN n{i} > 0 THEN {place} + n{i} ELSE 0 END AS p{i} FROM a{i})",
            f"c{i} AS (SELECT *, substr(text, p{i} + 1, {X.SAMPLE_CHARS}) AS q{i} FROM b{i})",
            f"d{i} AS (SELECT *, regexp_replace({cut}, '^\\s+|\\s+$', '', 'g') AS t{i} FROM c{i})",
            f"e{i} AS (SELECT *, p{i} > 0 AND ({last} < 0 OR p{i} >= {last} + {X.SAMPLE_CHARS}) AND t{i} <> '' AS u{i} FROM d{i})",
            f"s{i + 1} AS (SELECT *, CASE WHEN u{i} THEN p{i} ELSE {last} END AS l{i} FROM e{i})",
        ]
        last = f"l{i}"
    return ",\n".join(steps), "list_filter([" + ", ".join(f"CASE WHEN u{i} THEN t{i} END" for i in range(X.SAMPLES)) + "], lambda z: z IS NOT NULL)"


_STEPS, _TAKEN = _samples()
F19 = rf"""WITH d AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '(?m)^([^ \n]+ ?[^ \n]*)$', '## \1', 'g') AS text FROM documents),
h AS (SELECT doc_id, source, text, list_transform(list_filter(string_split(text, chr(10)), lambda z: ltrim(z, ' ') LIKE '#%'), lambda z: trim(z)) AS f FROM d),
g AS (SELECT *, f[{X.HEADS + 1}:] AS rest FROM h),
e AS (SELECT *, list_concat(f[1:{X.HEADS}], list_transform(CASE WHEN len(rest) > {X.MORE_HEADS}
        THEN list_concat([rest[i * len(rest) // {X.MORE_HEADS} + 1] for i in range(0, {X.MORE_HEADS - 1})], [rest[len(rest)]]) ELSE rest END, lambda z: substr(z, 1, {X.HEAD_CHARS}))) AS heads FROM g),
{_STEPS},
s AS (SELECT * FROM s{X.SAMPLES}),
t AS (SELECT doc_id, source, heads, CASE WHEN length(text) > {X.SAMPLE_OVER} THEN {_TAKEN} ELSE [] END AS samples,
        list_filter(list_transform(heads, lambda z: trim(regexp_replace(z, '^#+', ''))), lambda z: z <> '') AS titles,
        list_filter(string_split_regex(array_to_string([trim(z) for z in string_split(substr(text, 1, {X.START}), chr(10)) if trim(z) <> '' AND z NOT LIKE '#%'], ' '), '\s+'), lambda z: z <> '')[1:{X.QUOTED_WORDS}] AS words FROM s)
SELECT doc_id, CAST(len(heads) AS INTEGER) AS n_headings, md5(array_to_string(heads, chr(10))) AS headings_md5, CAST(len(samples) AS INTEGER) AS n_samples, md5(array_to_string(samples, chr(10) || '--' || chr(10))) AS samples_md5,
  CASE WHEN len(titles) > 0 THEN 'This file is titled "' || titles[1] || '"' || CASE WHEN len(titles) > 1 THEN ' with sections ' || array_to_string(['"' || z || '"' for z in titles[2:5]], ', ') ELSE '' END || '.'
         || CASE WHEN len(words) > 0 THEN ' It begins: "' || array_to_string(words, ' ') || '"' ELSE '' END ELSE 'This file begins: "' || array_to_string(words, ' ') || '"' END AS description,
  CASE WHEN len(titles) > 0 THEN 'What does ' || titles[1] || ' say?' ELSE 'Which file says ' || array_to_string(words[1:8], ' ') || '?' END AS question,
  array_to_string(list_filter(string_split_regex(CASE WHEN len(titles) > 0 THEN titles[1] ELSE 'doc ' || doc_id END, '\s+'), lambda z: z <> '')[1:4], ' ') AS subject FROM t"""

QUERIES = {"w5_seeded_order": w5_seeded_order, "f19_excerpts": f19_excerpts}
SQL = {"w5_seeded_order": W5, "f19_excerpts": F19}
