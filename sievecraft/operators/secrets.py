"""Secret-shaped text: what kinds a text holds, and texts with the sections that hold any left out.

All are column expressions over one row, in the JVM and without a shuffle: a text is scanned where it lies. A text is cut at its
headings, outside fenced blocks; a section with a secret is withheld whole, with MARGIN lines on either side, whatever sections those are of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once

WITHHELD = "[withheld: secret-shaped text in this section]"
#: Lines beside a withheld section that are withheld too, and the share of lines from which on a text is held whole.
MARGIN, MOST_HELD = 3, 0.5
#: Bits of each character from which on an assigned value counts as random.
RANDOM_BITS = 3.5
KINDS = ("card", "ssn", "token", "assignment", "password", "table", "seed", "key-block")

# Numbers that processors publish for tests; no account has them.
TEST_CARDS = (
    "4111111111111111", "4242424242424242", "4012888888881881", "4000056655665556", "5555555555554444", "5105105105105100", "5200828282828210",
    "6011111111111117", "6011000990139424", "3530111333300000", "3566002020360505", "378282246310005", "371449635398431", "378734493671000",
)
#: All patterns are for folded text and read alike by engines without lookaround.
SCRUBBED = (r"https?://[^ \n]+", r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", r"[0-9]{4}-[0-1][0-9]-[0-3][0-9]")
DIGIT_RUN = r"[0-9]+(?:[ -][0-9]+)*"
NETWORK = r"^(?:4|5[1-5]|2[2-7]|6[05]|3[0458])"
DASHED_RUN, SSN = r"[0-9]+(?:-[0-9]+)*", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
NO_SSN = r"^(?:000|666|9[0-9]{2})-|-00-|-0000$"
SSN_LABEL = r"(?:^|[^a-z])(?:ssn|social security)(?: number| no)?[ :#.]{1,3}[0-9]{9}(?:[^0-9]|$)"
TOKEN = (
    r"(?:^|[^a-z0-9_])(?:sk-[a-z0-9_-]{20}|gh[pousr]_[a-z0-9]{20}|glpat-[a-z0-9_-]{20}|xox[baprs]-[a-z0-9-]{10}|akia[0-9a-z]{16}|aiza[0-9a-z_-]{35}"
    r"|eyj[a-z0-9_-]{10,}[.][a-z0-9_-]{10,}[.][a-z0-9_-]{5})"
)
ASSIGNMENT = r"(?:^|[^a-z0-9])[a-z0-9_-]{0,20}(?:key|token|secret|credential)[a-z0-9_-]{0,20}[\"' ]*[:=][ \"']*([a-z0-9+/_=.-]{10,150})"
PASSWORD = r"(?:^|[^a-z0-9])(?:password|passwd|passphrase|pwd|pin)[\"' ]*[:=][ \"']*([^ \"'\n,;|]{4,})"
PASSWORD_IS = r"(?:^|[^a-z0-9])(?:password|passwd|passphrase|pwd|pin) is [\"']*([^ \"'\n,;|]{4,})"
NO_VALUE = r"^(?:x+|[*]+|[-]+|[.]+|<.*|[$][{(].*|[{\[].*|your.*|none|null|required|optional|changeme|redacted|placeholder|hidden|true|false|string)[.]?$"
COLUMN_LABEL = r"^(?:password|passwd|passphrase|pwd|pin|pin code|secret)$"
SEED = r"^ *[a-z]{3,8}(?: [a-z]{3,8}){11,23} *$"
#: What each match of a pattern holds: a pattern is slow to try at every place, and most texts hold none of these.
TOKEN_WORDS, BLOCK_WORDS = ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "akia", "aiza", "eyj"), ("-----begin ", "mii")
ASSIGNMENT_WORDS, PASSWORD_WORDS, SSN_WORDS = ("key", "token", "secret", "credential"), ("password", "passwd", "passphrase", "pwd", "pin"), ("ssn", "social security")
KEY_BLOCK = r"-----begin [a-z ]*private key-----|mii[a-z0-9+/]{60}"
HEADING = r"(?md)^(#{1,6}[^\S\n]+[^\n]*\S)"
FENCE = r"(?md)^(?=[^\S\n]*```)"
#: Zero-width characters, which split a key in two unseen; full-width forms of ASCII; the mark of a heading, which no text holds then.
ZERO_WIDTH = "​‌‍⁠﻿­"
FULL_WIDTH, ASCII = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))
MARK = "\0"


def scannable(text: Column) -> Column:
    """The form that is scanned: lower case, without zero-width characters; controls but newlines are spaces, letters beyond ASCII x, digits 0, others spaces."""

    def of(whole: Column) -> Column:
        seen = F.translate(F.translate(whole, ZERO_WIDTH, ""), FULL_WIDTH, ASCII)
        folded = F.regexp_replace(F.regexp_replace(F.lower(seen), r"[[^\x00-\x7F]&&[\p{L}\p{M}]]", "x"), r"[[^\x00-\x7F]&&\p{Nd}]", "0")
        return F.regexp_replace(F.when(_is_ascii(whole), F.lower(whole)).otherwise(folded), r"[^\x0A\x20-\x7E]", " ")

    return bound_once(F.coalesce(text, F.lit("")), of)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def _lines_with(lines: Column, *words: tuple[str, ...]) -> Column:
    """The lines that hold a word of each tuple, as one text: a pattern whose matches have those words and lie in one line, but for a newline before or behind, has the same matches there."""
    held = lambda x: reduce(lambda a, b: a & b, [_has(x, w) for w in words])
    return F.array_join(F.filter(lines, held), "\n")


def entropy(value: Column) -> Column:
    """Bits of each character (Shannon), from the counts of the characters; 0 of an empty text."""
    n = F.length(value).cast("double")
    bits = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) * F.log2(n - F.length(F.replace(value, c, F.lit(""))))
    chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    return F.when(n > 0, F.log2(n) - F.aggregate(chars, F.lit(0.0), lambda s, c: s + bits(c)) / n).otherwise(F.lit(0.0))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _real_card(digits: Column) -> Column:
    return F.call_function("luhn_check", digits) & ~digits.isin(*TEST_CARDS)


def _run_has_card(run: Column, sure: Column) -> Column:
    """A run of digit groups with a card: a group of 16 digits or 15 of the right network, or four groups of 4 (or 4, 6 and 5) in a row.

    Groups after the first must be led by a network's digits, with 1 to 4 groups before them and at most 4 after, of 4 digits or more at most 2 on
    each side, so that of a long row of numbers not each window counts. Where the digits aren't ``sure``, shape alone counts.
    """

    def of(groups: Column) -> Column:
        long = lambda a, b: F.size(F.filter(F.slice(groups, a, F.greatest(b, F.lit(0))), lambda g: F.length(g) >= 4))

        def window(i: Column, sizes: tuple[int, ...]) -> Column:
            parts = [F.get(groups, i + k) for k in range(len(sizes))]
            shape = F.lit(True)
            for part, size in zip(parts, sizes, strict=True):
                shape = shape & (F.length(part) == size)
            digits = F.concat(*parts)
            after = F.size(groups) - i - len(sizes)
            near = (i <= 4) & (after <= 4) & (long(F.lit(1), i) <= 2) & (long(i + len(sizes) + 1, after) <= 2)
            network = digits.rlike(NETWORK if sum(sizes) == 16 else "^3[47]")
            led = network if sum(sizes) == 15 else ((i == 0) | (network & near))
            return F.coalesce(shape & (~sure | (_real_card(digits) & led)), F.lit(False))

        return F.exists(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: window(i, (16,)) | window(i, (15,)) | window(i, (4, 4, 4, 4)) | window(i, (4, 6, 5)))

    return bound_once(F.split(run, "[ -]"), of)


def _has_table(text: Column) -> Column:
    """A pipe table with a column of passwords and a value in it. The first row of a table has its labels."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), "^[|]+|[|]+$", ""), "[|]"), lambda c: F.regexp_replace(c, "^[ *_`]+|[ *_`]+$", ""))
    kind = "struct<labels:array<int>,hit:boolean>"

    def labels(line: Column) -> Column:
        return bound_once(cells(line), lambda cs: F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: F.get(cs, i).rlike(COLUMN_LABEL)))

    def value(line: Column, columns: Column) -> Column:
        return bound_once(cells(line), lambda cs: F.exists(columns, lambda i: F.coalesce((F.get(cs, i) != "") & ~F.get(cs, i).rlike(NO_VALUE), F.lit(False))))

    def step(s: Column, line: Column) -> Column:
        row = F.ltrim(line).startswith("|")
        told = F.when(~row, F.lit(None).cast("array<int>")).when(s["labels"].isNull(), labels(line)).otherwise(s["labels"])
        hit = row & (F.coalesce(F.size(s["labels"]), F.lit(0)) > 0) & ~line.rlike("^[ |:-]+$")
        return F.struct(told.alias("labels"), (s["hit"] | F.when(hit, value(line, s["labels"])).otherwise(False)).alias("hit")).cast(kind)

    start = F.struct(F.lit(None).cast("array<int>").alias("labels"), F.lit(False).alias("hit")).cast(kind)
    return text.contains("|") & F.aggregate(F.split(text, "\n"), start, step, lambda s: s["hit"])


def secret_kinds(text: Column) -> Column:
    """The KINDS of secrets in a text, in their order; none of a null or empty text."""
    whole = F.coalesce(text, F.lit(""))

    def of(t: Column, lines: Column, sure: Column) -> Column:
        scrubbed = t
        for pattern in SCRUBBED:
            scrubbed = F.regexp_replace(scrubbed, pattern, " ")
        random = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & (entropy(v) >= RANDOM_BITS - 1e-9)
        real = lambda v: ~v.rlike(NO_VALUE)
        bare = lambda line: F.split(F.trim(line), " ")
        told = _lines_with(lines, PASSWORD_WORDS)
        hits = {
            "card": t.rlike("[0-9]{4}") & F.exists(_found(scrubbed, DIGIT_RUN), lambda r: _run_has_card(r, sure)),
            "ssn": (t.contains("-") & F.exists(_found(t, DASHED_RUN), lambda r: r.rlike(SSN) & ~r.rlike(NO_SSN))) | (_has(t, SSN_WORDS) & t.rlike(SSN_LABEL)),
            "token": _has(t, TOKEN_WORDS) & t.rlike(TOKEN),
            "assignment": _has(t, ASSIGNMENT_WORDS) & F.exists(_found(_lines_with(lines, ASSIGNMENT_WORDS, (":", "=")), ASSIGNMENT, 1), random),
            "password": _has(t, PASSWORD_WORDS)
            & bound_once(told, lambda x: F.exists(_found(x, PASSWORD, 1), real) | F.exists(_found(x, PASSWORD_IS, 1), lambda v: real(v) & v.rlike("[0-9!@#$%^&*?]"))),
            "table": _has_table(t),
            "seed": F.exists(lines, lambda x: x.rlike(SEED) & (F.size(F.array_distinct(bare(x))) >= F.size(bare(x)) - 1)),
            "key-block": _has(t, BLOCK_WORDS) & t.rlike(KEY_BLOCK),
        }
        return F.filter(F.array(*[F.when(hits[kind], F.lit(kind)) for kind in KINDS]), lambda k: k.isNotNull())

    # a digit beyond ASCII is folded to 0, so its true value is lost and no check digit can be tested
    sure = lambda x: _is_ascii(x) | ~x.rlike(r"[\p{Nd}&&[^0-9]]")
    read = lambda t: F.struct(t.alias("t"), F.split(t, "\n").alias("lines"), sure(whole).alias("sure"))
    return bound_once(bound_once(scannable(text), read), lambda s: of(s["t"], s["lines"], s["sure"]))


def sections(text: Column) -> Column:
    """The text cut before its headings outside fenced blocks; together they are the text, in which NUL is read as a space. An empty text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARK, " ")
    # behind the newline that is put first, every other part is inside a fence
    parts = F.split(F.concat(F.lit("\n"), plain), FENCE, -1)
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, HEADING, f"{MARK}$1")).otherwise(p))
    cut = F.split(F.substr(F.array_join(marked, ""), F.lit(2)), MARK, -1)
    return F.filter(cut, lambda s, i: (i > 0) | (s != ""))


def judged_sections(text: Column) -> Column:
    """Array of (text, lines, kinds): a section without its last newline, its number of lines and what it holds."""
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def of(cut: Column) -> Column:
        body = lambda s, i: F.when(i < F.size(cut) - 1, F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)
        return F.transform(F.transform(cut, body), lambda s: F.struct(s.alias("text"), (lines(s) + 1).alias("lines"), secret_kinds(s).alias("kinds")))

    return bound_once(sections(text), of)


def withheld(text: Column) -> Column:
    """Struct of the text that may be shown (null where it is held whole), the number of lines, of withheld lines and of sections with secrets, and all kinds.

    A text without a secret stays as it is, and none of its sections has any: no pattern reaches over the newline before a heading. It is held whole where the secret is in no section alone, where more than MOST_HELD of its lines would be
    withheld, and where what is left still holds one. Numbers of lines stay.
    """
    bad = lambda s: F.size(s["kinds"]) > 0
    none = F.lit(0)

    def beside(all_: Column, i: Column, way: int) -> Column:
        """Lines of section i that are withheld because of sections before it (way -1) or behind it."""
        reach, between = none, none
        for k in range(1, MARGIN + 1):
            other = F.get(all_, i + way * k)
            reach = F.greatest(reach, F.when(F.coalesce(bad(other), F.lit(False)), MARGIN - between).otherwise(none))
            between = between + F.coalesce(other["lines"], none)
        return reach

    def edges(all_: Column) -> Column:
        return F.transform(all_, lambda s, i: F.struct(s["text"].alias("text"), s["lines"].alias("lines"), bad(s).alias("bad"), beside(all_, i, -1).alias("lead"), beside(all_, i, 1).alias("trail")))

    def shown(all_: Column) -> Column:
        def of(s: Column, i: Column) -> Column:
            before = F.get(all_, i - 1)
            last_held = F.coalesce(before["bad"] | (before["trail"] > 0) | (before["lead"] >= before["lines"]), F.lit(False))
            held = lambda j: s["bad"] | (j < s["lead"]) | (j >= s["lines"] - s["trail"])
            first = lambda j: ~F.when(j == 0, last_held).otherwise(held(j - 1))
            lines = F.transform(F.split(s["text"], "\n", -1), lambda x, j: F.when(~held(j), x).when(first(j), WITHHELD).otherwise(""))
            return F.when(s["bad"] | (s["lead"] > 0) | (s["trail"] > 0), F.array_join(lines, "\n")).otherwise(s["text"])

        return F.array_join(F.transform(all_, of), "\n")

    def summed(all_: Column, of) -> Column:
        return F.aggregate(all_, F.lit(0).cast("long"), lambda n, s: n + of(s))

    def judged(all_: Column) -> Column:
        n = summed(all_, lambda s: s["lines"])
        held = summed(all_, lambda s: F.when(s["bad"], s["lines"]).otherwise(F.least(s["lines"], s["lead"] + s["trail"])))
        return F.struct(n.alias("lines"), held.alias("held"), F.size(F.filter(all_, lambda s: s["bad"])).cast("long").alias("bad"), shown(all_).alias("shown"))

    def decided(kinds: Column) -> Column:
        def of(j: Column) -> Column:
            partly = (j["bad"] > 0) & (j["held"] <= MOST_HELD * j["lines"]) & (F.size(secret_kinds(j["shown"])) == 0)
            told = lambda left: F.struct(left.alias("text"), j["lines"].alias("n_lines"), F.when(left.isNull(), j["lines"]).otherwise(j["held"]).alias("n_held"), j["bad"].alias("n_bad"), kinds.alias("kinds"))
            return bound_once(F.when(partly, j["shown"]), told)

        return bound_once(bound_once(bound_once(judged_sections(text), edges), judged), of)

    def unless_free(kinds: Column) -> Column:
        whole = F.coalesce(text, F.lit(""))
        newlines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))
        zero = F.lit(0).cast("long")
        n = F.when(whole == "", zero).otherwise(newlines.cast("long") + 1)
        free = F.struct(whole.alias("text"), n.alias("n_lines"), zero.alias("n_held"), zero.alias("n_bad"), kinds.alias("kinds"))
        return F.when(F.size(kinds) == 0, free).otherwise(decided(kinds))

    return bound_once(secret_kinds(text), unless_free)


def without_secrets(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``shown`` (their text without withheld sections, null where held whole), ``n_lines``, ``n_held``, ``n_bad`` and ``kinds``."""
    told = rows.withColumn("_w", withheld(F.col(text)))
    names = {"shown": "text", "n_lines": "n_lines", "n_held": "n_held", "n_bad": "n_bad", "kinds": "kinds"}
    return told.select(*rows.columns, *[F.col(f"_w.{field}").alias(name) for name, field in names.items()])


# Keywords that make a path segment secret-shaped, and payload keys that never hold a user's text.
PATH_KEYWORDS = "password|passwd|secret|token|api[_-]?key|private[_-]?key"
MACHINE_KEYS = ("sha256", "id", "sourceId", "rootId", "children", "pointer", "principals", "ticket", "attemptId")
#: A keyword at the start of a word, a joiner, and a word that holds a digit, with all that is joined to it.
PATH_SECRET = rf"(?i)(?<![0-9A-Za-z])({PATH_KEYWORDS})[-_\x{{2010}}-\x{{2015}}](?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"


def path_has_secret(path: Column) -> Column:
    return F.coalesce(path.rlike(PATH_SECRET), F.lit(False))


def redacted_path(path: Column) -> Column:
    """The path with every keyword that is joined to a value as keyword-[REDACTED], the keyword in lower case; all else stays."""
    found = F.regexp_extract_all(path, F.lit(PATH_SECRET), F.lit(1))
    gaps = F.split(path, PATH_SECRET, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.concat(F.lower(F.get(found, i)), F.lit("-[REDACTED]")), F.lit("")))), "")


def payload_kinds(payload: Column, depth: int = 4) -> Column:
    """Kinds of secrets in the keys and string values of a JSON object, arrays and objects within up to ``depth`` levels (deeper ones are read as one text); what stands under MACHINE_KEYS isn't read.

    Each string is scanned by itself, without its escapes. The kinds of a payload that is no JSON are null, so that it can be refused.
    """
    empty = F.array().cast("array<string>")
    nests = lambda v: v.rlike(r"^\s*[{\[]") & F.try_parse_json(v).isNotNull()
    every = F.array(*map(F.lit, KINDS))

    def read(level: Column) -> Column:
        """Keys, and the values with whether they nest, of all objects and arrays of a level; each is parsed once."""
        objects = F.filter(level, lambda v: F.ltrim(v).startswith("{"))
        lists = F.filter(level, lambda v: F.ltrim(v).startswith("["))
        entries = F.flatten(F.transform(objects, lambda v: F.coalesce(F.map_entries(F.from_json(v, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))))
        items = F.flatten(F.transform(lists, lambda v: F.coalesce(F.from_json(v, "array<string>"), empty)))

        def of(members: Column) -> Column:
            below = F.transform(F.filter(members, lambda e: ~e["key"].isin(*MACHINE_KEYS)), lambda e: e["value"])
            values = F.filter(F.concat(below, items), lambda v: v.isNotNull())
            return F.struct(F.transform(members, lambda e: e["key"]).alias("keys"), F.transform(values, lambda v: F.struct(v.alias("v"), nests(v).alias("nests"))).alias("values"))

        return bound_once(entries, of)

    def found(texts: Column, level: Column, left: int) -> Column:
        if not left:
            return F.flatten(F.transform(F.concat(texts, level), secret_kinds))

        def of(r: Column) -> Column:
            leaves = F.transform(F.filter(r["values"], lambda x: ~x["nests"]), lambda x: x["v"])
            nested = F.transform(F.filter(r["values"], lambda x: x["nests"]), lambda x: x["v"])
            parts = F.struct(F.concat(texts, r["keys"], leaves).alias("texts"), nested.alias("level"))
            return bound_once(parts, lambda s: found(s["texts"], s["level"], left - 1))

        return bound_once(read(level), of)

    def kinds(whole: Column) -> Column:
        all_ = bound_once(found(empty, F.array(whole), depth), lambda got: F.filter(every, lambda k: F.array_contains(got, k)))
        return F.when(nests(whole), all_)

    return bound_once(payload, kinds)
