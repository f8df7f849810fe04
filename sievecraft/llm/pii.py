r"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Spark's regular-expression functions give matches without their places,
so a place is the running sum of the lengths of gaps (split by the pattern) and matches: both come
from the same leftmost non-overlapping search. The sums are made in blocks, so that they cost about
n * sqrt(n) for n matches of one text. Where a text can't hold a kind (no @, no digit), its pattern is not run.

Patterns are written with possessive quantifiers, which here accept exactly the same strings as the
greedy ones (what follows a repeated class never starts with a character of it) but don't backtrack or recurse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import table, text_or_empty

LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts a run of local characters, or where the match before ended.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Code points on either side of a span in which context words are looked for.
NEAR = 40
#: Other matches of the kind, on either side, through which they are looked for.
NEIGHBOURS = 4
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of span. Base kinds are kept whatever their score; others from ``least`` on."""

    name: str
    pattern: str
    hint: str  # a text without this can't hold the kind
    score: float
    words: str  # context words, any case
    base: bool = True
    least: float = 0.5


KINDS = (
    Kind("email", EMAIL, "@", 0.9, "mail|contact|write|address"),
    Kind("ip", IP, r"[0-9]\.[0-9]", 0.6, "ip|address|host|server|login"),
    Kind("card", CARD, "[0-9]{2}|[0-9][ -][0-9]", 0.7, "card|visa|pay|credit|konto|tarjeta|carte"),
    Kind("phone", PHONE, r"\+[0-9]", 0.7, "phone|tel|call|fax|mobile"),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|konto", base=False),
    Kind("ssn", SSN, "[0-9]-[0-9]{2}-[0-9]", 0.3, "ssn|social|security|tax", base=False),
)


def running_starts(lengths: Column) -> Column:
    """Sum of all earlier elements, for each element of an array of longs."""

    def sums(block: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("done"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done"))
        return F.aggregate(block, zero, step, lambda s: s["done"])

    zero = F.lit(0).cast("bigint")
    total = lambda block: F.aggregate(block, zero, lambda s, x: s + x)
    count = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(lengths, (i - 1) * BLOCK + 1, F.lit(BLOCK)))
    begins = sums(F.transform(blocks, total), zero)
    return F.flatten(F.zip_with(blocks, begins, sums))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97(iban: Column) -> Column:
    """True if the account number, its first four characters moved to its end and letters as 10 to 35, is 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(values, zero, lambda s, v: F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97) == 1


def valid(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind.name == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind.name == "ssn":
        return ~match.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def once(value: Column, use) -> Column:
    """use(value) with the value computed once: what a lambda names from outside would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, kind: Kind) -> Column:
    """Array of (start, rank, end, kind, score) of a kind in the text, in order of start; code points, end exclusive.

    A match's context are the NEAR code points on either side, through at most NEIGHBOURS other matches. It is taken from the gaps
    and matches already in hand, so a text of many matches costs time in proportion to its length.
    """
    rank = KINDS.index(kind)
    before, behind = (lambda x: F.substring(x, -NEAR, NEAR)), (lambda x: F.substring(x, 1, NEAR))

    def measured(s: Column) -> Column:
        n = F.size(s["m"])
        earlier, later = F.slice(s["g"], F.lit(1), n), F.slice(s["g"], F.lit(2), n)
        return F.struct(
            s["m"].alias("m"),
            F.transform(s["g"], before).alias("left"),
            F.transform(s["g"], behind).alias("right"),
            F.zip_with(earlier, s["m"], lambda g, m: F.concat(before(g), m)).alias("tails"),
            F.zip_with(s["m"], later, lambda m, g: F.concat(m, behind(g))).alias("heads"),
            F.transform(earlier, lambda g: F.length(g).cast("bigint")).alias("gap"),
            once(F.zip_with(earlier, s["m"], lambda g, m: (F.length(g) + F.length(m)).cast("bigint")), running_starts).alias("from"),
        )

    def scored(b: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            first = F.greatest(i - NEIGHBOURS, F.lit(0))
            left = before(F.concat(F.array_join(F.slice(b["tails"], first + 1, i - first), ""), F.get(b["left"], i)))
            right = behind(F.concat(F.get(b["right"], i + 1), F.array_join(F.slice(b["heads"], i + 2, F.lit(NEIGHBOURS)), "")))
            bonus = F.when(F.concat(left, F.lit(" "), right).rlike(rf"(?i)\b(?:{kind.words})"), 0.25).otherwise(0.0)
            start = F.get(b["from"], i) + F.get(b["gap"], i)
            score = F.when(valid(kind, m), F.least(F.lit(1.0), F.lit(kind.score) + bonus))
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

        return F.transform(b["m"], one)

    cut_up = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("g"))
    found = once(cut_up, lambda s: once(measured(s), scored))
    found = F.filter(found, lambda s: s["score"].isNotNull() if kind.base else s["score"] >= kind.least)
    kept = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"
    return F.when(text.rlike(kind.hint), found.cast(kept)).otherwise(F.array().cast(kept))


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and spans (array of start, rank, end, kind, score, in that order) of each row.

    Null text is empty; texts without spans have an empty array. Rows are independent: repeated rows are returned each.
    A very long text, or one of many matches, is one row's work in time little above linear; other columns are ignored.
    """
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    found = F.flatten(F.array(*[spans(F.col("__text"), k) for k in KINDS]))
    return rows.select(*keep, F.array_sort(found).alias("spans"))


def _listed(found: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = [k for k in KINDS if k.base]
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    counts = [count(k.name).alias(f"n_{k.name}") for k in base]
    of_base = F.filter("spans", lambda s: s["rank"] < len(base))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(
        "doc_id", *counts, F.sha2(_listed(of_base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), scores.alias("scores")
    )
