"""Whether an action may be taken: hard rules over its text, cues, facts about its target, and a model's answer."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that look like a Latin one, and what they are read as.
LOOKALIKES = (
    ("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("у", "y"), ("х", "x"), ("і", "i"), ("ј", "j"), ("ѕ", "s"),
    ("А", "a"), ("Е", "e"), ("О", "o"), ("Р", "p"), ("С", "c"), ("У", "y"), ("Х", "x"), ("І", "i"), ("Ј", "j"), ("Ѕ", "s"),
    ("α", "a"), ("ο", "o"), ("ρ", "p"), ("υ", "y"), ("ι", "i"), ("β", "b"), ("κ", "k"), ("ν", "v"), ("τ", "t"), ("χ", "x"), ("η", "n"),
    ("Α", "a"), ("Β", "b"), ("Ε", "e"), ("Ζ", "z"), ("Η", "h"), ("Ι", "i"), ("Κ", "k"), ("Μ", "m"), ("Ν", "n"), ("Ο", "o"), ("Ρ", "p"), ("Τ", "t"), ("Υ", "y"), ("Χ", "x"),
)
# Characters that show nothing.
UNSEEN = "[\u200b-\u200f\u202a-\u202e\u2060\ufeff]"
# What makes an action irreversible, and whether it is destructive (D) or routine (R).
HARD_RULES = (
    ("delete", r"\bdelet(e|es|ed|ing)\b", "R"),
    ("remove", r"\bremov(e|es|ed|ing)\b", "R"),
    ("rm", r"\brm(\s+-[a-z]+)?\b", "R"),
    ("rm -rf", r"\brm\s+-[a-z]*(rf|fr)[a-z]*\b", "D"),
    ("wipe", r"\bwipe\b", "D"),
    ("purge", r"\bpurge\b", "D"),
    ("drop table/database/column", r"\bdrop\s+(table|database|column)\b", "D"),
    ("truncate", r"\btruncate\b", "D"),
    ("force push", r"\bforce[-_ ]push\b", "D"),
    ("push --force", r"\bpush\s+(-f|--force)\b", "D"),
    ("git push -f", r"\bgit\s+push\b[\s\S]*-f\b", "D"),
    ("push over remote history", r"\bpush(es|ed|ing)?\s+over\s+(the\s+)?(remote\s+)?history\b", "D"),
    ("merge to main", r"\bmerge\s+(to|into)\s+main\b", "R"),
    ("reset --hard", r"\breset\s+--hard\b", "D"),
    ("checkout --", r"\bcheckout\s+--(\s|$)", "D"),
    ("branch -D", r"\bbranch\s+-d\b", "D"),
    ("pay/payment", r"\b(pay|pays|paid|paying|payment)\b", "R"),
    ("invoice", r"\binvoice\b", "R"),
    ("transfer/settle", r"\b(transfer|send\s+money|settle)\b", "R"),
    ("wire", r"\bwire\b", "D"),
    ("dollar amount", r"\$\d", "R"),
    ("usd", r"\busd\b", "R"),
    ("crypto", r"\bcrypto\b", "D"),
    ("send email/message", r"\bsend\s+(an?\s+|the\s+)?(email|mail|message|text|sms)\b", "R"),
    ("reply to customer/client", r"\breply\s+to\s+(the\s+)?(customer|client)\b", "R"),
    ("post/publish/tweet/release/deploy", r"\b(post|publish|tweet|release|deploy)\b", "R"),
    ("restart/stop/kill service", r"\b(restart|stop|kill)\s+(the\s+)?(app|bot|server|service|launchd)\b", "R"),
    ("shutdown", r"\bshutdown\b", "R"),
    ("format", r"\bformat(s|ted|ting)?\s+(the\s+|a\s+|an\s+|this\s+|that\s+|my\s+|our\s+|every\s+|each\s+)?(disk|drive|volume|partition|sd\s*card|usb)\b|\bmkfs\b|\bdiskutil\s+erase", "D"),
    ("overwrite", r"\boverwrite\b", "D"),
    ("chmod/chown -R", r"\b(chmod|chown)\b[\s\S]*-r\b", "R"),
    ("curl | sh", r"\bcurl\b[\s\S]*\|\s*sh\b", "D"),
)
# Cues that call for a look.
SOFT_CUES = (
    ("clean up", r"\bclean\s*up\b"), ("tidy", r"\btidy\b"), ("old backups", r"\bold\s+backups\b"), ("stale", r"\bstale\b"), ("away", r"\baway\b"), ("over the remote", r"\bover\s+the\s+remote\b"),
    ("history", r"\bhistory\b"), ("production", r"\bproduction\b"), ("prod", r"\bprod\b"), ("live", r"\blive\b"),
)
MONEY_LIMIT = 200.0


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC form; plain ASCII texts are handed on as they are."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def plain_letters(text: Column) -> Column:
    """Compatible forms, nothing unseen, lookalikes as Latin letters, lower case, single spaces."""
    read = F.translate(F.regexp_replace(compatible(text), UNSEEN, ""), "".join(a for a, _ in LOOKALIKES), "".join(b for _, b in LOOKALIKES))
    return F.trim(F.regexp_replace(F.lower(read), r"\s+", " "))


def matched(plain: Column, rules: tuple) -> Column:
    """Labels of the rules that a plain text matches, in their order."""
    return F.array_compact(F.array(*[F.when(plain.rlike(rule[1]), rule[0]) for rule in rules]))


def hard_class(labels: Column) -> Column:
    """destructive if any label is, else irreversible_routine; null without labels."""
    destructive = F.arrays_overlap(labels, F.array(*[F.lit(n) for n, _, c in HARD_RULES if c == "D"]))
    return F.when(F.size(labels) == 0, None).when(destructive, "destructive").otherwise("irreversible_routine")


def permits(actions: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdict of each action (id, text): refuse, needs_approval or safe_to_auto, with its class, labels and cues.

    A hard rule settles it without an answer. Of the accepted answers (id, kind, value, confidence_only) safe_to_auto is taken back where only the
    model's own confidence stands behind it, or where the text has a cue. Anything else needs approval.
    """
    rows = actions.withColumn("_plain", plain_letters(F.col("text"))).withColumn("labels", matched(F.col("_plain"), HARD_RULES)).withColumn("cues", matched(F.col("_plain"), SOFT_CUES))
    rows = rows.withColumn("class", hard_class(F.col("labels"))).join(answers, "id", "left")
    known = (F.col("kind") == "accepted") & F.col("value").isin("safe_to_auto", "needs_approval", "refuse")
    safe = F.when((F.col("value") == "safe_to_auto") & (F.coalesce("confidence_only", F.lit(False)) | (F.size("cues") > 0)), "needs_approval").otherwise(F.col("value"))
    verdict = F.when(F.col("class") == "destructive", "refuse").when(F.col("class").isNotNull(), "needs_approval").when(known, safe).otherwise("needs_approval")
    return rows.select("id", verdict.alias("verdict"), "class", F.array_join("labels", "|").alias("labels"), F.array_join("cues", "|").alias("cues"))


def action_objects(actions: DataFrame) -> DataFrame:
    """What an action (id, text, target) is about: path, branch, dropped thing, number of files, amount and payee, null where it names none."""
    n = F.trim(F.regexp_replace(F.lower(compatible(F.col("text"))), r"\s+", " "))
    found = lambda text, pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    own = lambda value: F.when(value.isNotNull(), F.coalesce("target", value))
    amount = found(F.col("text"), r"\$([0-9]+(?:\.[0-9]+)?)", 1).cast("double")
    money = amount.isNotNull() | n.rlike(r"\bpay|wire|transfer|settle\b")
    return actions.select(
        "id",
        own(found(n, r"\brm\s+-[a-z]*(?:rf|fr)[a-z]*\s+(?:the\s+)?(\S+)", 1)).alias("path"),
        own(found(n, r"\bgit\s+push\b.*?(?:-f|--force)\b.*?\b([\w./-]+)$", 1)).alias("branch"),
        own(found(n, r"\bdrop\s+(?:table|database|column)\s+(?:the\s+)?([\w.]+)", 1)).alias("dropped"),
        found(n, r"\bdelete\s+([0-9]+)\s+files?\b", 1).cast("long").alias("n_files"),
        amount.alias("amount"),
        F.when(money, own(found(n, r"\bto\s+([\w.@-]+)\s*$", 1))).alias("payee"),
    )


def protected_branch(branch: Column) -> Column:
    """A branch whose last part is main or master."""
    return F.regexp_replace(F.regexp_replace(F.trim(branch), r"\.+$", ""), "/+$", "").rlike("(^|/)(main|master)$")


def inside(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies in it; null if either is unknown."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def pre_decisions(actions: DataFrame, limit: float = MONEY_LIMIT) -> DataFrame:
    """refuse, needs_approval or defer_to_judge for each action (id, text, target, tracked, worktree, new_payee), before any model is asked.

    A destructive action on a target that is tracked in the task's own tree can be undone and is left to the judge; any other is refused. An amount over the
    limit or a new payee needs approval. Facts that are null are unknown and settle nothing.
    """
    plain = plain_letters(F.concat_ws(" ", "text", "target"))
    rows = actions.withColumn("class", hard_class(matched(plain, HARD_RULES))).join(action_objects(actions), "id")
    target = F.coalesce("path", "dropped", "target")
    recoverable = (F.col("class") == "destructive") & F.col("tracked") & inside(target, F.col("worktree"))
    costly = F.col("amount").isNotNull() & ((F.col("amount") > limit) | F.coalesce("new_payee", F.lit(False)))
    verdict = F.when(recoverable, "defer_to_judge").when(F.col("class") == "destructive", "refuse").when(costly, "needs_approval").otherwise("defer_to_judge")
    settled = F.when(recoverable, None).when(F.col("class") == "destructive", "hard_rule_destructive").when(costly, "money_rule")
    protected = protected_branch(F.col("branch"))
    return rows.select("id", "class", verdict.alias("verdict"), settled.alias("settled_by"), "path", "branch", F.coalesce(protected, F.lit(False)).alias("protected"), "dropped", "n_files", "amount", "payee")
