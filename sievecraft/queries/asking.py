"""Queries over cells, fetches, pre-rules, named search, permits and evidence, with made-up answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.functions import text as T
from sievecraft.operators import evidence as E
from sievecraft.operators import graph
from sievecraft.operators import named_search as N
from sievecraft.operators import permit as P
from sievecraft.operators import sweep as S
from sievecraft.queries.documents import SQL_SQUEEZED, table, tokens
from sievecraft.queries.evaluation import d, digit
from sievecraft.queries.records import SQL_LINKS, _links

QUESTIONS = ["topic", "a_name_that_is_so_long_that_no_wire_key_of_it_can_be_sent_as_it_is"]


def _cells(spark, sf_dir):
    key = F.concat(F.lit("r_"), F.col("doc_id").cast("string"))
    return S.cells(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), key.alias("key"), F.col("doc_id").alias("pos")), QUESTIONS)


def j3_cells(spark, sf_dir):
    """Both questions of every labelled document."""
    return _cells(spark, sf_dir)


SQL_CELLS = f"""
    SELECT doc_id AS id, q AS question, 'q.' || q || '.' || doc_id AS logical_key, CASE WHEN length('q_' || q || '_r_' || doc_id) <= 64 THEN 'q_' || q || '_r_' || doc_id ELSE 'q' || k || '_r' || doc_id END AS wire_key
    FROM labels, (VALUES (0, '{QUESTIONS[0]}'), (1, '{QUESTIONS[1]}')) v(k, q)"""


def _answers(spark, sf_dir):
    """An answer for most cells of labelled documents, for all documents' first question besides, and some that are broken."""
    asked = _cells(spark, sf_dir).select("wire_key").unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("q_topic_r_"), F.col("doc_id").cast("string")).alias("wire_key"))).distinct()
    key = F.col("wire_key")
    a = digit("a", key, 101)
    first, second = a / F.lit(100.0), (100 - a + F.when(digit("t", key, 13) == 0, 7).otherwise(0)) / F.lit(100.0)
    chosen = F.when(digit("w", key, 17) == 0, "no such option").when(a >= 50, "yes").otherwise("no")
    keys = F.array(F.lit("yes"), F.lit("no"))
    blank = F.lit(None).cast("double")
    rows = asked.select("wire_key", F.lit("choice").alias("kind"), keys.alias("keys"), F.map_from_arrays(keys, F.array(first, second)).alias("probabilities"), chosen.alias("choice"), blank.alias("score"), ((digit("c", key, 45) + 55) / F.lit(100.0)).alias("confidence"), blank.alias("noul"))
    return rows.where(digit("m", key, 19) > 0)  # an answer that never came


SQL_ANSWERS = f"""
    SELECT wire_key, CASE WHEN {d('w', 'wire_key', 17)} = 0 THEN 'no such option' WHEN {d('a', 'wire_key', 101)} >= 50 THEN 'yes' ELSE 'no' END AS choice, {d('a', 'wire_key', 101)} AS a,
           {d('t', 'wire_key', 13)} = 0 AS off, ({d('c', 'wire_key', 45)} + 55) / 100.0 AS confidence
    FROM (SELECT wire_key FROM cells UNION SELECT 'q_topic_r_' || doc_id FROM documents) WHERE {d('m', 'wire_key', 19)} > 0"""
SQL_ANSWERED = f"""
    WITH cells AS ({SQL_CELLS}), answers AS ({SQL_ANSWERS}),
    z AS (SELECT wire_key, id, question, logical_key, confidence, greatest(a, 100 - a + CASE WHEN off THEN 7 ELSE 0 END) / (100.0 + CASE WHEN off THEN 7 ELSE 0 END) AS peak, choice,
      CASE WHEN id IS NULL THEN 'unasked' WHEN choice IS NULL THEN 'missing' WHEN off AND a < 7 THEN 'distribution' WHEN off THEN 'total' WHEN choice = 'no such option' THEN 'choice' ELSE 'valid' END AS state
      FROM cells FULL JOIN answers USING (wire_key))"""


def p4_answered_cells(spark, sf_dir):
    rows = S.answered_cells(_cells(spark, sf_dir), _answers(spark, sf_dir))
    return rows.select("wire_key", "id", "question", "state", "choice", F.round("confidence", 6).alias("confidence"), F.round("peak", 6).alias("peak"))


def j2_sweep_outcomes(spark, sf_dir):
    rows = S.sweep_outcomes(S.answered_cells(_cells(spark, sf_dir), _answers(spark, sf_dir)))
    return rows.select("id", "kind", F.round("min_confidence", 6).alias("min_confidence"))


def p7_allowed(spark, sf_dir):
    return S.allowed(S.sweep_outcomes(S.answered_cells(_cells(spark, sf_dir), _answers(spark, sf_dir)))).select("id")


def s2_checked_questions(spark, sf_dir):
    """Made-up questions: unsafe, too few options, blank descriptions, repeated names."""
    key = F.col("doc_id")
    name = F.when(digit("n", key, 7) == 0, F.concat(F.lit("not safe "), key.cast("string"))).when(digit("n", key, 7) == 1, "same").otherwise(F.concat(F.lit("q"), key.cast("string")))
    options = F.when(digit("o", key, 5) == 0, F.create_map(F.lit("a"), F.lit("x"))).when(digit("o", key, 5) == 1, F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("  "))).otherwise(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")))
    return S.checked_questions(table(spark, sf_dir, "documents").select(name.alias("name"), options.alias("options")))


def _judged(spark, sf_dir):
    """The documents of a source as one request's candidates."""
    key = F.col("doc_id")
    level = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "none", "none")]), digit("l", key, 5) + 1)
    level = F.when(digit("s", F.col("source"), 5) == 0, "none").otherwise(F.when(digit("u", key, 29) > 0, level))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("request"), key.alias("id"), level.alias("level"), (digit("c", key, 100) / F.lit(100.0)).alias("confidence"),
        F.when(digit("d", key, 3) > 0, digit("p", key, 90) / F.lit(100.0)).alias("p_level"), F.when(digit("d", key, 3) > 0, digit("q", key, 60) / F.lit(100.0)).alias("p_none"),
    )


SQL_JUDGED = f"""
    SELECT source AS request, doc_id AS id, CASE WHEN {d('s', 'source', 5)} = 0 THEN 'none' WHEN {d('u', 'doc_id', 29)} > 0 THEN (['high', 'medium', 'low', 'none', 'none'])[{d('l', 'doc_id', 5)} + 1] END AS level,
           {d('c', 'doc_id', 100)} / 100.0 AS confidence, CASE WHEN {d('d', 'doc_id', 3)} > 0 THEN {d('p', 'doc_id', 90)} / 100.0 END AS p_level, CASE WHEN {d('d', 'doc_id', 3)} > 0 THEN {d('q', 'doc_id', 60)} / 100.0 END AS p_none FROM documents"""


def r6_fetch(spark, sf_dir):
    rows = S.fetch(_judged(spark, sf_dir), 5)
    return rows.select("request", "id", F.round("score", 6).alias("score"), "confidence", "beats", "rank", "place")


def r6_fetch_summary(spark, sf_dir):
    return S.fetch_summary(_judged(spark, sf_dir))


def _requests(spark, sf_dir):
    """Turns of conversations as requests."""
    ident = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(ident.alias("request_id"), "text", "conv_id", "turn")


def _phrases(spark, sf_dir):
    """A catalog of the benchmark items: two words of each as utterances, the next two as a negative, all words of one conversation turn besides."""
    w = F.split("text", " ")
    three = lambda at: F.array_join(F.slice(w, at, 2), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array(three(1), three(3)).alias("utterances"), F.array(three(5), F.get(w, F.lit(0))).alias("negatives"))


SQL_PHRASES = r"""
    SELECT item_id AS id, list_transform(u, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS u, list_transform(n, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS n
    FROM (SELECT item_id, [array_to_string(w[1:2], ' '), array_to_string(w[3:4], ' ')] AS u, [array_to_string(w[5:6], ' '), w[1]] AS n FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))"""
SQL_REQUESTS = r"""SELECT conv_id || ':' || turn AS request_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS words FROM conversations"""


def r8_pre_rules(spark, sf_dir):
    """Decisions over all turns of all conversations; a judge's first choice is made up for most of them."""
    requests, catalog = _requests(spark, sf_dir), _phrases(spark, sf_dir)
    key = F.col("request_id")
    top = requests.where(digit("j", key, 9) > 0).select("request_id", digit("i", key, 40).cast("long").alias("id"), (digit("c", key, 100) / F.lit(100.0)).alias("confidence"))
    return S.pre_rules(requests.select("request_id", "text"), catalog, top, 0.6)


def a20_proposed_utterances(spark, sf_dir):
    """First lines of documents as corrections in favour of their sources, whose catalog has the first lines of documents of one language."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    catalog = rows.select(F.col("source").alias("id"), F.array(F.when(F.col("lang") == "en", F.col("line"))).alias("utterances"))
    found = S.proposed_utterances(rows.select(F.col("source").alias("chosen_id"), F.col("line").alias("request")), catalog, T.catalog_key)
    return found.select("id", F.md5("phrase").alias("phrase_md5"), "n")


def a21_thin_utterances(spark, sf_dir):
    return S.thin_utterances(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("utterances")))


def _short_requests(spark, sf_dir):
    """Requests made of vague and other words, and names of parts of one brand."""
    key = F.col("p_partkey")
    some = ("update it", "Fix THIS!", "what is it", "/Name", "restart the build of the site", "please", "check that one", "run these", "merge release branch", "stop")
    text = F.when(digit("n", key, 4) == 0, F.concat(F.lit("/"), F.upper("p_name"), F.lit("!"))).otherwise(F.element_at(F.array(*map(F.lit, some)), digit("t", key, 10) + 1))
    context = F.when(digit("x", key, 6) == 0, "the editor config").otherwise("it is")
    return table(spark, sf_dir, "part").select(key.alias("request_id"), text.alias("text"), context.alias("context")), some


def p20_underspecified(spark, sf_dir):
    rows, _ = _short_requests(spark, sf_dir)
    return rows.select("request_id", N.underspecified(F.col("text"), F.col("context")).alias("vague"))


def r11_search_status(spark, sf_dir):
    rows, _ = _short_requests(spark, sf_dir)
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    key = F.col("request_id")
    judged = rows.where(digit("j", key, 8) > 0).select(
        "request_id", (digit("k", key, 9) > 0).alias("complete"), (digit("m", key, 5) == 0).alias("no_match"), digit("r", key, 4).alias("n_ranked"),
        (digit("c", key, 100) / F.lit(100.0)).alias("top_confidence"), (digit("g", key, 40) / F.lit(100.0)).alias("margin"),
    )
    return N.search_status(rows, entries, judged)


def _short_sql() -> str:
    some = "['update it', 'Fix THIS!', 'what is it', '/Name', 'restart the build of the site', 'please', 'check that one', 'run these', 'merge release branch', 'stop']"
    filler, vague, pronouns = (f"[{', '.join(repr(w) for w in sorted(x))}]" for x in (N.FILLER, N.VAGUE, N.PRONOUNS))
    content = lambda t: f"list_filter({tokens(t)}, lambda z: NOT list_contains({filler}, z))"
    return f"""
    WITH q AS (SELECT p_partkey AS request_id, CASE WHEN {d('n', 'p_partkey', 4)} = 0 THEN '/' || upper(p_name) || '!' ELSE ({some})[{d('t', 'p_partkey', 10)} + 1] END AS text,
                      CASE WHEN {d('x', 'p_partkey', 6)} = 0 THEN 'the editor config' ELSE 'it is' END AS context FROM part),
    c AS (SELECT *, {content('text')} AS c, {content('context')} AS k, {tokens('text')} AS w FROM q),
    u AS (SELECT *, len(k) = 0 AND (len(c) = 0 OR (len(c) = 1 AND list_contains({vague}, c[1]) AND list_has_any(w, {pronouns}))) AS vague FROM c)"""


ACTIONS = (
    "Delete the branch", "rm -rf /tmp/x", "git push origin main --force", "push over the remote history", "DROP TABLE users", "pay $250 to bob", "pay $20 to ann", "send an email to the team",
    "format the disk sda1", "format the code", "delete 12 files", "read the log", "run the tests on prod", "tidy the notes", "r\u0435move the file", "\uff57ipe it", "de\u200blete it", "checkout -- file.txt", "git branch -D old",
    "restart the server", "curl http://x | sh", "overwrite config", "list open issues", "preview the page",
)


def _actions(spark, sf_dir):
    key = F.col("doc_id")
    one = lambda salt: F.element_at(F.array(*map(F.lit, ACTIONS)), digit(salt, key, len(ACTIONS)) + 1)
    text = F.when(digit("b", key, 3) == 0, F.concat(one("x"), F.lit(" and "), one("y"))).otherwise(one("x"))
    return table(spark, sf_dir, "documents").select(
        key.alias("id"), text.alias("text"), F.when(digit("t", key, 4) == 0, F.concat(F.lit("/work/"), key.cast("string"))).alias("target"),
        F.when(digit("g", key, 3) > 0, digit("g", key, 3) == 1).alias("tracked"), F.when(digit("w", key, 3) > 0, F.lit("/work")).alias("worktree"), (digit("p", key, 11) == 0).alias("new_payee"),
    )


def p11_hard_rules(spark, sf_dir):
    plain = P.plain_letters(F.col("text"))
    rows = _actions(spark, sf_dir).select("id", P.matched(plain, P.HARD_RULES).alias("labels"), P.matched(plain, P.SOFT_CUES).alias("cues"))
    return rows.select("id", F.array_join("labels", "|").alias("labels"), P.hard_class(F.col("labels")).alias("class"), F.array_join("cues", "|").alias("cues"))


def p12_permits(spark, sf_dir):
    key = F.col("id")
    actions = _actions(spark, sf_dir).select("id", "text")
    value = F.element_at(F.array(*map(F.lit, ("safe_to_auto", "safe_to_auto", "needs_approval", "refuse"))), digit("v", key, 4) + 1)
    answers = actions.select("id", F.when(digit("k", key, 5) > 0, "accepted").otherwise("review").alias("kind"), value.alias("value"), (digit("o", key, 6) == 0).alias("confidence_only"))
    return P.permits(actions, answers)


def p13_pre_decisions(spark, sf_dir):
    return P.pre_decisions(_actions(spark, sf_dir))


def _actions_sql() -> str:
    listed = "[" + ", ".join("'" + a.replace("\uff57", "w") + "'" for a in ACTIONS) + "]"  # the compatible form, which DuckDB can't make
    one = lambda salt: f"({listed})[{d(salt, 'doc_id', len(ACTIONS))} + 1]"
    letters = "'" + "".join(a for a, _ in P.LOOKALIKES) + "', '" + "".join(b for _, b in P.LOOKALIKES) + "'"
    plain = lambda t: rf"trim(regexp_replace(lower(translate(regexp_replace({t}, '\x{{200b}}', '', 'g'), {letters})), '\s+', ' ', 'g'))"
    return f"""
    WITH a AS (SELECT doc_id AS id, CASE WHEN {d('b', 'doc_id', 3)} = 0 THEN {one('x')} || ' and ' || {one('y')} ELSE {one('x')} END AS text, CASE WHEN {d('t', 'doc_id', 4)} = 0 THEN '/work/' || doc_id END AS target,
                      CASE WHEN {d('g', 'doc_id', 3)} > 0 THEN {d('g', 'doc_id', 3)} = 1 END AS tracked, CASE WHEN {d('w', 'doc_id', 3)} > 0 THEN '/work' END AS worktree, {d('p', 'doc_id', 11)} = 0 AS new_payee FROM documents),
    x AS (SELECT *, {plain('text')} AS plain, {plain("concat_ws(' ', text, target)")} AS whole FROM a)"""


def _labels_sql(column: str, rules: tuple) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({column}, '{r[1]}') THEN '{r[0]}' END" for r in rules)
    return f"array_to_string(list_filter([{cases}], lambda z: z IS NOT NULL), '|')"


def _class_sql(column: str) -> str:
    hit = lambda kind: " OR ".join(f"regexp_matches({column}, '{p}')" for _, p, c in P.HARD_RULES if c == kind)
    return f"CASE WHEN {hit('D')} THEN 'destructive' WHEN {hit('R')} THEN 'irreversible_routine' END"


def g2_completeness(spark, sf_dir):
    """Evidence of every order: its customer, nation and region as roles; the comment of a customer may say that it is superseded."""
    roots = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    links = _links(spark, sf_dir)
    docs = links.select(F.col("src").alias("id")).where("not (id like 'n%' and length(id) = 2)").distinct()
    visits = graph.walk(roots, links, 2)
    reports = graph.walk_report(visits, links, docs, 2)
    text = F.when(digit("s", F.col("id"), 7) == 0, F.concat(F.lit("Superseded by "), "id")).otherwise(F.col("id"))
    held = visits.join(docs, "id").withColumn("text", text)
    roles = [E.role_self("order"), E.role_prefix("customer", "c"), E.role_pattern("nation", "^n[0-9]+$", required=False), E.role_pattern("region", "^r", required=False)]
    return E.completeness(held, reports, roles, dangling_blocks=False).unionByName(E.completeness(held, reports, roles).withColumn("root", F.concat(F.lit("strict "), "root")))


def g2_prose_references(spark, sf_dir):
    """Numbers that a turn names as a word's number, of two shapes."""
    rows = table(spark, sf_dir, "conversations")
    found = E.prose_references(F.lower("text"), (r"(?:^| )([a-z]{3}) [a-z]{2} ", r" ([a-z]{5})\. "))
    return rows.select("conv_id", "turn", F.array_join(found, ",").alias("ids"))


QUERIES = {
    "s2_checked_questions": s2_checked_questions, "j3_cells": j3_cells, "p4_answered_cells": p4_answered_cells, "j2_sweep_outcomes": j2_sweep_outcomes, "p7_allowed": p7_allowed, "r6_fetch": r6_fetch, "r6_fetch_summary": r6_fetch_summary,
    "r8_pre_rules": r8_pre_rules, "a20_proposed_utterances": a20_proposed_utterances, "a21_thin_utterances": a21_thin_utterances, "p20_underspecified": p20_underspecified, "r11_search_status": r11_search_status,
    "p11_hard_rules": p11_hard_rules, "p12_permits": p12_permits, "p13_pre_decisions": p13_pre_decisions, "g2_completeness": g2_completeness, "g2_prose_references": g2_prose_references,
}
SQL_SWEPT = SQL_ANSWERED + """,
    k AS (SELECT id, CASE WHEN state = 'missing' THEN 'unanswered' WHEN state <> 'valid' THEN 'failed_validation' WHEN confidence < 0.75 OR confidence - peak > 0.05 + 1e-9 THEN 'review' ELSE 'accepted' END AS kind,
                 CASE WHEN state = 'valid' THEN confidence END AS c FROM z WHERE state <> 'unasked'),
    f AS (SELECT id, (['unaccounted', 'failed_validation', 'unanswered', 'insufficient_evidence', 'review', 'abstain', 'accepted'])[min(list_position(['unaccounted', 'failed_validation', 'unanswered', 'insufficient_evidence', 'review', 'abstain', 'accepted'], kind))] AS kind,
                 round(min(c), 6) AS min_confidence FROM k GROUP BY id)"""
BEATS = "(level <> 'none' AND coalesce(p_level > p_none, true))"
SQL = {
    "j3_cells": SQL_CELLS,
    "p4_answered_cells": SQL_ANSWERED + " SELECT wire_key, id, question, state, CASE WHEN state = 'valid' THEN choice END AS choice, CASE WHEN state = 'valid' THEN round(confidence, 6) END AS confidence, CASE WHEN state = 'valid' THEN round(peak, 6) END AS peak FROM z",
    "j2_sweep_outcomes": SQL_SWEPT + " SELECT id, kind, min_confidence FROM f",
    "p7_allowed": SQL_SWEPT + " SELECT id FROM f WHERE kind = 'accepted'",
    "s2_checked_questions": f"""
        WITH x AS (SELECT CASE {d('n', 'doc_id', 7)} WHEN 0 THEN 'not safe ' || doc_id WHEN 1 THEN 'same' ELSE 'q' || doc_id END AS name, {d('o', 'doc_id', 5)} AS o FROM documents)
        SELECT name, CASE WHEN name LIKE '% %' THEN 'name' WHEN o = 0 THEN 'options' WHEN o = 1 THEN 'description' WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'repeated' END AS problem FROM x""",
    "r6_fetch": f"""
        WITH j AS ({SQL_JUDGED}), s AS (SELECT *, CASE level WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 2 / 3 WHEN 'low' THEN 1 / 3 WHEN 'none' THEN 0 END AS score, {BEATS} AS beats FROM j WHERE level IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, confidence DESC, id) AS place, row_number() OVER (PARTITION BY request, beats ORDER BY score DESC, confidence DESC, id) AS k FROM s)
        SELECT request, id, round(score, 6) AS score, confidence, beats, CAST(CASE WHEN beats AND k <= 5 THEN k END AS INT) AS rank, CAST(place AS INT) AS place FROM r""",
    "r6_fetch_summary": f"""
        WITH j AS ({SQL_JUDGED}), g AS (SELECT request, count(*) AS judged, bool_or({BEATS}) AS hit, avg(CASE WHEN level = 'none' THEN confidence ELSE coalesce(p_none, 0) END) FILTER (NOT {BEATS}) AS mean FROM j WHERE level IS NOT NULL GROUP BY request)
        SELECT request, judged, NOT hit AS no_match, CASE WHEN hit THEN 0.0::DOUBLE ELSE floor(mean * 1000 + 0.5) / 1000 END AS no_match_confidence FROM g""",
    "r8_pre_rules": f"""
        WITH c AS ({SQL_PHRASES}), r AS ({SQL_REQUESTS}),
        u AS (SELECT DISTINCT id, unnest(u) AS phrase FROM c), o AS (SELECT min(id) AS id, phrase FROM u WHERE contains(phrase, ' ') GROUP BY phrase HAVING count(*) = 1),
        n AS (SELECT DISTINCT id, unnest(n) AS phrase FROM c),
        h AS (SELECT request_id, min(id) AS id, count(*) AS owners FROM (SELECT DISTINCT request_id, id FROM r JOIN o ON contains(words, ' ' || phrase || ' ')) GROUP BY request_id),
        x AS (SELECT DISTINCT request_id, id FROM r JOIN n ON phrase <> '' AND contains(words, ' ' || phrase || ' ')),
        t AS (SELECT request_id, CAST({d('i', 'request_id', 40)} AS BIGINT) AS id, {d('c', 'request_id', 100)} / 100.0 AS confidence FROM r WHERE {d('j', 'request_id', 9)} > 0),
        a AS (SELECT r.request_id, owners, h.id AS hit, t.id AS top, confidence, owners = 1 AND (r.request_id, h.id) NOT IN (SELECT (request_id, id) FROM x) AS served, (r.request_id, t.id) IN (SELECT (request_id, id) FROM x) AS demoted
              FROM r LEFT JOIN h USING (request_id) LEFT JOIN t USING (request_id))
        SELECT request_id, CASE WHEN served THEN 'serve' WHEN demoted THEN 'demote' WHEN owners IS NULL AND coalesce(confidence, 0) < 0.6 THEN 'noMatch' ELSE 'fallThrough' END AS decision, CASE WHEN served THEN hit WHEN demoted THEN top END AS id FROM a""",
    "a20_proposed_utterances": f"""
        WITH x AS (SELECT source AS id, lang, {SQL_SQUEEZED.format('string_split(text, chr(10))[1]')} AS phrase FROM documents)
        SELECT id, md5(phrase) AS phrase_md5, count(*) AS n FROM x WHERE phrase <> '' AND (id, phrase) NOT IN (SELECT (id, phrase) FROM x WHERE lang = 'en') GROUP BY id, phrase""",
    "a21_thin_utterances": "SELECT doc_id AS id, CAST(len(string_split(text, chr(10))) AS INT) AS n FROM documents WHERE len(string_split(text, chr(10))) < 3",
    "p20_underspecified": f"{_short_sql()} SELECT request_id, vague FROM u",
    "r11_search_status": f"""{_short_sql()},
        j AS (SELECT request_id, {d('k', 'request_id', 9)} > 0 AS complete, {d('m', 'request_id', 5)} = 0 AS no_match, {d('r', 'request_id', 4)} AS n_ranked, {d('c', 'request_id', 100)} / 100.0 AS top, {d('g', 'request_id', 40)} / 100.0 AS margin FROM q WHERE {d('j', 'request_id', 8)} > 0),
        e AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY lower(p_name) HAVING count(*) = 1),
        x AS (SELECT request_id, e.id FROM q JOIN e ON e.name = trim(regexp_replace(regexp_replace(lower(trim(text)), '^/', ''), '^["''`]+|["''`,.;:!?]+$', '', 'g')))
        SELECT request_id, x.id, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN vague THEN 'clarify' WHEN complete AND no_match THEN 'no_match' WHEN complete IS NULL OR NOT complete OR n_ranked = 0 THEN 'fallback'
               WHEN top >= 0.6 AND margin >= 0.1 THEN 'suggestions' ELSE 'clarify' END AS status, x.id IS NULL AND NOT vague AS asked FROM u LEFT JOIN x USING (request_id) LEFT JOIN j USING (request_id)""",
    "p11_hard_rules": f"{_actions_sql()} SELECT id, {_labels_sql('plain', P.HARD_RULES)} AS labels, {_class_sql('plain')} AS class, {_labels_sql('plain', P.SOFT_CUES)} AS cues FROM x",
    "p12_permits": f"""{_actions_sql()}, y AS (SELECT id, {_class_sql('plain')} AS class, {_labels_sql('plain', P.HARD_RULES)} AS labels, {_labels_sql('plain', P.SOFT_CUES)} AS cues, {d('k', 'id', 5)} > 0 AS ok,
        (['safe_to_auto', 'safe_to_auto', 'needs_approval', 'refuse'])[{d('v', 'id', 4)} + 1] AS value, {d('o', 'id', 6)} = 0 AS alone FROM x)
        SELECT id, CASE WHEN class = 'destructive' THEN 'refuse' WHEN class IS NOT NULL OR NOT ok THEN 'needs_approval' WHEN value = 'safe_to_auto' AND (alone OR cues <> '') THEN 'needs_approval' ELSE value END AS verdict, class, labels, cues FROM y""",
    "p13_pre_decisions": rf"""{_actions_sql()}, n AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS n, TRY_CAST(nullif(regexp_extract(text, '\$([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS amount, {_class_sql('whole')} AS class FROM x),
        o AS (SELECT *, nullif(regexp_extract(n, '\brm\s+-[a-z]*(?:rf|fr)[a-z]*\s+(?:the\s+)?(\S+)', 1), '') AS p, nullif(regexp_extract(n, '\bgit\s+push\b.*?(?:-f|--force)\b.*?\b([\w./-]+)$', 1), '') AS b,
              nullif(regexp_extract(n, '\bdrop\s+(?:table|database|column)\s+(?:the\s+)?([\w.]+)', 1), '') AS t, nullif(regexp_extract(n, '\bto\s+([\w.@-]+)\s*$', 1), '') AS y FROM n),
        f AS (SELECT id, class, tracked, worktree, new_payee, target, amount, TRY_CAST(nullif(regexp_extract(n, '\bdelete\s+([0-9]+)\s+files?\b', 1), '') AS BIGINT) AS n_files, CASE WHEN p IS NOT NULL THEN coalesce(target, p) END AS path, CASE WHEN b IS NOT NULL THEN coalesce(target, b) END AS branch,
              CASE WHEN t IS NOT NULL THEN coalesce(target, t) END AS dropped, CASE WHEN y IS NOT NULL AND (amount IS NOT NULL OR regexp_matches(n, '\bpay|wire|transfer|settle\b')) THEN coalesce(target, y) END AS payee FROM o),
        g AS (SELECT *, coalesce(path, dropped, target) AS aim FROM f),
        h AS (SELECT *, coalesce(class = 'destructive' AND tracked AND (aim = worktree OR starts_with(aim, worktree || '/')), false) AS kept, coalesce(amount > 200 OR (amount IS NOT NULL AND new_payee), false) AS dear FROM g)
        SELECT id, class, CASE WHEN kept THEN 'defer_to_judge' WHEN class = 'destructive' THEN 'refuse' WHEN dear THEN 'needs_approval' ELSE 'defer_to_judge' END AS verdict,
               CASE WHEN kept THEN NULL WHEN class = 'destructive' THEN 'hard_rule_destructive' WHEN dear THEN 'money_rule' END AS settled_by, path, branch, coalesce(regexp_matches(branch, '(^|/)(main|master)[.]*$'), false) AS protected, dropped, n_files, amount, payee FROM h""",
    "g2_completeness": f"""
        WITH RECURSIVE l AS ({SQL_LINKS}), k AS (SELECT DISTINCT src AS id FROM l WHERE NOT (src LIKE 'n%' AND length(src) = 2)),
        w(root, id, depth) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders UNION SELECT w.root, l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.id WHERE w.depth < 2),
        v AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY root, id),
        a AS (SELECT root, count(*) FILTER (k.id IS NULL) AS dangling, bool_or(depth = 2 AND k.id IS NOT NULL AND v.id IN (SELECT src FROM l)) AS truncated,
              {', '.join(f"count(*) FILTER (k.id IS NOT NULL AND {test} AND {d('s', 'v.id', 7)} <> 0) AS live{i}, count(*) FILTER (k.id IS NOT NULL AND {test} AND {d('s', 'v.id', 7)} = 0) AS old{i}" for i, test in enumerate(('v.id = root', "v.id LIKE 'c%'", "regexp_matches(v.id, '^n[0-9]+$')", "v.id LIKE 'r%'")))}
              FROM v LEFT JOIN k USING (id) GROUP BY root),
        p AS (SELECT root, dangling, [{', '.join((f"CASE WHEN live{i} = 0 AND old{i} > 0 THEN '{n}: superseded' WHEN live{i} = 0 THEN '{n}: missing' END, " if i < 2 else "") + f"CASE WHEN live{i} > 1 THEN '{n}: ' || live{i} END" for i, n in enumerate(('order', 'customer', 'nation', 'region')))}, CASE WHEN truncated THEN 'truncated' END] AS p FROM a),
        b AS (SELECT root, p FROM p UNION ALL SELECT 'strict ' || root, list_append(p, CASE WHEN dangling > 0 THEN 'dangling: ' || dangling END) FROM p)
        SELECT root, array_to_string(list_filter(p, lambda z: z IS NOT NULL), '; ') AS problems, len(list_filter(p, lambda z: z IS NOT NULL)) = 0 AS complete FROM b""",
    "g2_prose_references": r"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), ',') AS ids
        FROM (SELECT conv_id, turn, list_concat(regexp_extract_all(lower(text), '(?:^| )([a-z]{3}) [a-z]{2} ', 1), regexp_extract_all(lower(text), ' ([a-z]{5})\. ', 1)) AS l FROM conversations)""",
}
