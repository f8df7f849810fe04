"""Evidence windows as rows: lines with the labels of the piece that they are of, the pieces, and what they say about a numbered change.

A window is one composed text, bounded by what a judge reads, so its lines are a bounded group; windows are spread over tasks, and all
steps over the lines of a window share one shuffle and order. Trust is derived from where a line stands and never taken from what it says: once
a report is quoted, or a cut has fused records, nothing behind it can open a section or be trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.plans.spread import spread

# Headers of sections and marks of composed windows.
CURRENT, RECEIPTS, REPORTS, PREV_REPORTS, CONTRIBUTED, UNKNOWN = "current", "receipts", "reports", "prev_reports", "contributed", "unknown"
HEADERS = {
    "[current turn]": CURRENT,
    "[session receipts]": RECEIPTS,
    "[current turn reports]": REPORTS,
    "[relayed reports in previous turns]": PREV_REPORTS,
    "[contributed by check arms]": CONTRIBUTED,
}
PREV_HEADER = r"^\[previous turn -(\d+)\]$"
REGION = "[relayed reports in this turn]"
CUTS = ("[...older content in this turn dropped...]", "[...head of this report dropped...]")
REPORT_OPENS = r"^REPORT FROM(?![A-Za-z0-9_])"
REPORT_WHO = r"^REPORT FROM (.*) \(unverified worker claim(?:, previous turn -\d+)?\)$"
IDENTITY = r"\s*\[from:\s*(.*?)(?:\s+@\s+([^\]]*))?\]\s*$"
#: Order in which sections are composed: turns back from the newest, then these.
SLOTS = {PREV_REPORTS: 1, RECEIPTS: 2, REPORTS: 3, CURRENT: 4, CONTRIBUTED: 5}
#: Order in time of sections that are no previous turn (that has the negative of its number); others have none.
RANKS = {PREV_REPORTS: -0.5, RECEIPTS: 0.0, REPORTS: 1.0, CURRENT: 2.0}
#: Sections whose every line is a piece, and that hold reports only. All others hold items between rules.
LINEWISE, REPORTED = (RECEIPTS, CONTRIBUTED), (REPORTS, PREV_REPORTS)
RULE = r"^(?:={3,}|-{3,})$"
#: Bytes of windows whose lines a task sorts.
TEXT_OF_TASK = 2 << 20


def _prev_number(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, PREV_HEADER, 1), F.lit("")).try_cast("long")


def _of(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def recency_rank(section: Column) -> Column:
    """Order of sections in time; null (unknown, which is not oldest) of those without."""
    prev = F.regexp_extract(section, r"^prev\((\d+)\)$", 1)
    return F.when(prev != "", -F.nullif(prev, F.lit("")).try_cast("double")).otherwise(_of(RANKS, section))


def window_lines(windows: DataFrame, key: str = "window_id", text: str = "text") -> DataFrame:
    """(key, line, raw, section, part, piece, kind, trusted, rank): every line of every window; kind ``glue`` is of no piece.

    A rule ``===`` between blank lines opens a section if the line behind it is a header that is composed later than all headers before it, or
    if there was no header yet. Headers of previous turns need no rule among each other. After a line that opens a report or a cut mark
    there are no sections any more. Items of a section stand between rules ``---``; from the first report on all is claims, one for each label
    behind a blank line; from a cut mark on all is one piece of mixed origin. Blank lines and rules at the end of a piece are glue, and a piece
    without any other line is none. A rule that shares its blank line with a rule before it is content. Null and empty texts have no lines.
    """
    # texts are dealt, not lines, into partitions of a bounded size: each task sorts the lines of its windows in several orders
    texts = spread(windows.where(F.col(text) != "").select(key, text), [key], TEXT_OF_TASK, F.octet_length(text))
    rows = texts.select(F.col(key), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "raw"))
    w = Window.partitionBy(key).orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    lag, lead = (lambda c, n=1: F.lag(c, n).over(w)), (lambda c, n=1: F.lead(c, n).over(w))
    bare = F.trim(F.col("raw"))
    ruled = lambda rule, at: (F.col("raw") == rule) & (at(F.lag, 1) == "") & (at(F.lead, 1) == "") & at(F.lag, 2).isNotNull() & at(F.lead, 2).isNotNull()
    rows = rows.withColumn("cand", ruled("===", lambda f, n: f("raw", n).over(w)))
    rows = rows.withColumn("rule", F.col("cand") & ~F.coalesce(lag("cand", 2), F.lit(False)))
    rows = rows.withColumn("opens", bare.rlike(REPORT_OPENS) | (bare == REGION)).withColumn("cut", bare.isin(*CUTS))
    rows = rows.withColumn("frozen", F.coalesce(F.max(F.col("opens") | F.col("cut")).over(before), F.lit(False)))
    number = _prev_number(bare)
    named = F.coalesce(F.concat(F.lit("prev("), number.cast("string"), F.lit(")")), _of(HEADERS, bare))
    rows = rows.withColumn("named", named)
    later = _of(SLOTS, F.col("named"))
    rows = rows.withColumn("slot", F.when(number.isNotNull(), F.struct(F.lit(0).alias("a"), number.alias("b"))).when(later.isNotNull(), F.struct(later.alias("a"), F.lit(0).cast("long").alias("b"))))
    behind_rule = F.coalesce(lag("rule", 2), F.lit(False))
    rows = rows.withColumn("behind", behind_rule).withColumn("placed", F.col("slot").isNotNull() & ~F.col("frozen") & ((F.col("line") == 0) | F.col("behind")))
    rows = rows.withColumn("known", F.coalesce(F.max("placed").over(before), F.lit(False)))
    rows = rows.withColumn("placed", F.col("placed") | (F.col("known") & ~F.col("frozen") & bare.rlike(PREV_HEADER)))
    highest = F.max(F.when(F.col("placed"), F.col("slot"))).over(before)
    rows = rows.withColumn("highest", highest).withColumn("header", F.col("placed") & (F.col("highest").isNull() | (F.col("slot") > F.col("highest"))))
    rows = rows.withColumn("plain", ~F.col("header") & ((F.col("line") == 0) | (F.col("behind") & F.col("slot").isNull() & ~F.col("frozen") & ~F.col("known"))))
    rows = rows.withColumn("starts", F.col("header") | F.col("plain"))
    rows = rows.withColumn("ruled", F.col("starts") & F.col("behind"))
    glue = lambda c, at: F.coalesce(at(c, 1), F.lit(False)) | F.coalesce(at(c, 2), F.lit(False)) | F.coalesce(at(c, 3), F.lit(False))
    rows = rows.withColumn("glue", glue("ruled", lead))
    section = F.last(F.when(F.col("header"), F.col("named")).when(F.col("plain"), UNKNOWN), ignorenulls=True).over(so_far)
    rows = rows.withColumn("section", section).withColumn("part", F.sum(F.col("starts").cast("int")).over(so_far))
    return _pieces_of_lines(rows.select(key, "line", "raw", "section", "part", "opens", "cut", "header", "glue"), key)


def _pieces_of_lines(rows: DataFrame, key: str) -> DataFrame:
    bare = F.trim(F.col("raw"))
    rows = rows.withColumn("class", F.when(F.col("header"), "header").when(F.col("glue"), "glue").otherwise("content"))
    s = Window.partitionBy(key, "part", "class").orderBy("line")
    at = lambda f, n, c="raw": f(c, n).over(s)
    no = F.lit(False)
    linewise, reported = F.col("section").isin(*LINEWISE), F.col("section").isin(*REPORTED)
    turned = F.first(F.when(F.col("opens"), "claim").when(F.col("cut"), "mixed"), ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("turned", F.when(~linewise & ~reported, turned))
    rows = rows.withColumn("first_turned", F.col("turned").isNotNull() & at(F.lag, 1, "turned").isNull())
    rows = rows.withColumn("region", F.col("first_turned") & (bare == REGION))
    items = ~linewise & ~reported & F.col("turned").isNull()
    # the line behind the rule may be the one that opens a report
    cand = items & (F.col("raw") == "---") & (at(F.lag, 1) == "") & (at(F.lead, 1) == "") & at(F.lag, 2).isNotNull() & at(F.lead, 2).isNotNull()
    rows = rows.withColumn("cand", cand)
    rows = rows.withColumn("rule", F.col("cand") & ~F.coalesce(at(F.lag, 2, "cand"), no))
    behind = F.coalesce(at(F.lag, 2, "rule"), no)
    label = (reported | (F.col("turned") == "claim")) & bare.rlike(REPORT_OPENS) & (F.coalesce(F.trim(at(F.lag, 1)) == "", F.lit(True)) | F.coalesce(at(F.lag, 1, "region"), no))
    first = at(F.lag, 1).isNull()
    begins = (F.col("class") == "content") & (first | linewise | F.col("first_turned") | F.coalesce(at(F.lag, 1, "region"), no) | (items & behind) | F.coalesce(label, no))
    rows = rows.withColumn("begins", begins | (F.col("class") == "header"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("number", F.sum(F.col("begins").cast("int")).over(w))
    kind = (
        F.when(F.col("header") | F.col("region"), "header")
        .when(F.col("section") == RECEIPTS, "fact")
        .when((F.col("section") == CONTRIBUTED) | reported | (F.col("turned") == "claim"), "claim")
        .when(F.col("turned") == "mixed", "mixed")
        .otherwise("receipt")
    )
    inside = Window.partitionBy(key, "number")
    empty = (bare == "") | bare.rlike(RULE)
    last = F.max(F.when(~empty & (F.col("class") != "glue"), F.col("line"))).over(inside)
    rows = rows.withColumn("last", last)
    held = F.col("last").isNotNull() & (F.col("line") <= F.col("last")) & (F.col("class") != "glue")
    return rows.select(
        key,
        "line",
        "raw",
        "section",
        "part",
        F.when(held, F.col("number")).alias("piece"),
        F.when(held, kind).otherwise("glue").alias("kind"),
        (held & kind.isin("fact", "receipt")).alias("trusted"),
        recency_rank(F.col("section")).alias("rank"),
    )


def _source(kind: Column, first: Column) -> Column:
    """Who reports, or the command (and where it ran) that a receipt names; null where the line names none."""
    who = F.nullif(F.regexp_extract(F.rtrim(first), REPORT_WHO, 1), F.lit(""))
    command, where = (F.nullif(F.trim(F.regexp_extract(first, IDENTITY, k)), F.lit("")) for k in (1, 2))
    return F.when(kind == "claim", who).when(kind.isin("receipt", "fact"), F.nullif(F.concat_ws(" @ ", command, where), F.lit("")))


def pieces(lines: DataFrame, key: str = "window_id") -> DataFrame:
    """(key, piece, section, rank, kind, trusted, source, first_line, last_line, text) of ``window_lines``; a piece is of one kind but for an empty tail."""
    held = lines.where("piece is not null")
    one = held.groupBy(key, "piece").agg(
        F.first("section").alias("section"), F.first("rank").alias("rank"), F.min_by("kind", "line").alias("kind"), F.min_by("trusted", "line").alias("trusted"),
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min_by("raw", "line").alias("first"),
        F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("all"),
    )
    text = F.array_join(F.transform("all", lambda x: x["raw"]), "\n")
    return one.select(key, "piece", "section", "rank", "kind", "trusted", _source(F.col("kind"), F.col("first")).alias("source"), "first_line", "last_line", text.alias("text"))


def sections(parts: DataFrame, key: str = "window_id") -> DataFrame:
    """(key, section, place): the sections of each window, in the order of their first piece."""
    return parts.groupBy(key, "section").agg(F.min("piece").alias("place"))


def by_kind(parts: DataFrame, *kinds: str) -> DataFrame:
    return parts.where(F.col("kind").isin(*kinds))


def receipts(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("trusted") & (F.col("kind") != "header"))


def select_lines(lines: DataFrame, kinds: tuple[str, ...] = (), section: str | None = None, trusted: bool | None = None) -> DataFrame:
    """Lines of pieces by their labels; headers only where ``kinds`` names them, so that none is read as a fact."""
    out = lines.where(F.col("kind").isin(*kinds) if kinds else ~F.col("kind").isin("header", "glue"))
    out = out if section is None else out.where(F.col("section") == section)
    return out if trusted is None else out.where(F.col("trusted") == trusted)


def newest(parts: DataFrame, key: str = "window_id") -> DataFrame:
    """The newest piece of each window: of the highest rank, then the last. A piece without a rank is never the newest."""
    ranked = parts.where("kind != 'header' and rank is not null")
    best = ranked.groupBy(key).agg(F.max(F.struct("rank", "piece")).alias("best"))
    return parts.join(best.select(key, F.col("best.piece").alias("piece")), [key, "piece"])


# The ways in which a line names the number of a change, and says that it is merged or not.
NUMBERS = (r"(?<![A-Za-z0-9_])gh\s+pr\s+merge\s+(\d+)", r"(?<![A-Za-z0-9_])gh\s+pr\s+(?:view|checks)\s+(\d+)", r"\(#(\d+)\)", r"#(\d+)(?![A-Za-z0-9_])", r'"number"\s*:\s*(\d+)')
MERGED_CLAIM = r"(?i)PR\s*#?(\d+)(?![A-Za-z0-9_])[^.\n]{0,30}?(?<![A-Za-z0-9_])merged(?![A-Za-z0-9_])"
STATE_JSON = r'"number"\s*:\s*(\d+)[^{}]{0,300}?"state"\s*:\s*"(\w+)"'
MERGE_RECEIPT = r'(?i)^\s*MERGED(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])gh\s+pr\s+merge\s+\d+|"mergedAt"\s*:\s*"[^"]+"'
NOT_MERGED = r"(?i)#(\d+)(?![A-Za-z0-9_])[^.\n]{0,40}?(?<![A-Za-z0-9_])(open|not merged|draft)(?![A-Za-z0-9_])"


def named_numbers(text: Column) -> Column:
    """All numbers of changes that a text names."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NUMBERS])))


def receipts_for(parts: DataFrame, key: str = "window_id") -> DataFrame:
    """A row for each change that a trusted piece names, with its place among the pieces of that change, newest first, those without a rank last."""
    named = receipts(parts).select("*", F.explode(named_numbers(F.col("text"))).alias("number"))
    w = Window.partitionBy(key, "number").orderBy(F.desc_nulls_last("rank"), "piece")
    return named.withColumn("place", F.row_number().over(w))


def state_signals(lines: DataFrame, key: str = "window_id") -> DataFrame:
    """(key, number, rank, line, state, raw_state, strength, bearing): what the lines say of a change's state.

    A trusted line that holds the state has strength 2, a trusted command that would merge 1, prose and all that a report says 0.
    """
    raw, trusted = F.col("raw"), F.col("trusted")
    signal = lambda n, state, said, strength, bearing: F.struct(n.alias("number"), state.alias("state"), said.alias("raw_state"), strength.alias("strength"), bearing.alias("bearing"))
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(STATE_JSON), F.lit(1)).alias("n"), F.regexp_extract_all(raw, F.lit(STATE_JSON), F.lit(2)).alias("s"))
    merged = lambda s: F.when(F.lower(s) == "merged", "MERGED").otherwise("NOT_MERGED")
    sure = F.when(trusted, 2).otherwise(0)
    told = F.transform(pairs, lambda p: signal(p["n"], merged(p["s"]), F.lower(p["s"]), sure, F.lit(True)))
    state_line = raw.rlike(r"(?i)^\s*MERGED(?![A-Za-z0-9_])") | raw.contains('"mergedAt"')
    counts = raw.rlike(MERGE_RECEIPT) & (state_line | (trusted & raw.rlike(IDENTITY)))
    strength = F.when(~trusted, 0).when(state_line, 2).otherwise(1)
    first = F.array(*[F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in NUMBERS])
    names = F.array_distinct(F.filter(first, lambda n: n.isNotNull()))
    receipts_ = F.when(counts, F.transform(names, lambda n: signal(n, F.lit("MERGED"), F.lit("merged"), strength, state_line))).otherwise(F.array())
    prose = F.arrays_zip(F.regexp_extract_all(raw, F.lit(NOT_MERGED), F.lit(1)).alias("n"), F.regexp_extract_all(raw, F.lit(NOT_MERGED), F.lit(2)).alias("s"))
    denied = F.transform(prose, lambda p: signal(p["n"], F.lit("NOT_MERGED"), F.lower(p["s"]), F.lit(0), F.lit(False)))
    # the first prose of a line counts for each change
    alike = F.filter(denied, lambda d, i: F.size(F.filter(F.slice(denied, F.lit(1), i), lambda e: e["number"] == d["number"])) == 0)
    found = select_lines(lines).select(key, "rank", "line", F.explode(F.concat(told, receipts_, alike)).alias("x"))
    return found.select(key, "x.number", "rank", "line", "x.state", "x.raw_state", "x.strength", "x.bearing")


def state_verdicts(drafts: DataFrame, signals: DataFrame, key: str = "window_id", draft: str = "draft") -> DataFrame:
    """(key, number, blocked, raw_state, rule): whether a draft's claim that a change is merged stands against the signals of its window.

    The strongest signal decides, then the newest, then the last line. Rule A: another of the same strength says otherwise and can't be ordered against it (no rank,
    or the same): the side that is not merged wins. Rule B: a merge without a state of its own never outranks any that says not merged. Rule C: the
    strongest says not merged. Drafts without a claim or without signals have no row. Drafts are bounded texts; ``key`` names one draft.
    """
    claimed = drafts.withColumn("number", F.nullif(F.regexp_extract(F.col(draft), MERGED_CLAIM, 1), F.lit(""))).where("number is not null").select(key, "number")
    met = signals.join(claimed, [key, "number"])
    order = F.struct("strength", F.coalesce("rank", F.lit(float("-inf"))).alias("r"), "line", "state", "raw_state", "bearing", "rank")
    best = met.groupBy(key, "number").agg(F.max(order).alias("best"))
    both = met.join(best, [key, "number"])
    rival = (F.col("state") != F.col("best.state")) & (F.col("strength") == F.col("best.strength"))
    rival = rival & (F.col("rank").isNull() | F.col("best.rank").isNull() | (F.col("rank") == F.col("best.rank")))
    first = lambda c: F.min_by("raw_state", F.when(c, F.struct("line", "raw_state")))
    open_ = F.col("state") != "MERGED"
    said = both.groupBy(key, "number", "best").agg(F.max(rival).alias("tied"), first(rival).alias("rival"), F.max(open_).alias("open"), first(open_).alias("denied"))
    merged = F.col("best.state") == "MERGED"
    rule = F.when(F.col("tied"), "A").when(merged & ~F.col("best.bearing") & F.col("open"), "B").when(~merged, "C")
    shown = F.when(rule == "A", F.when(merged, F.col("rival")).otherwise(F.col("best.raw_state"))).when(rule == "B", F.col("denied")).when(rule == "C", F.col("best.raw_state"))
    return said.select(key, "number", rule.isNotNull().alias("blocked"), shown.alias("raw_state"), rule.alias("rule"))
