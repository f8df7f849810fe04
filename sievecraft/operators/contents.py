"""Tables of contents of files by their suffix, pages and outlines of them within a budget, and records that are kept as the one current list.

Headings and definitions of shell and script files are found by column expressions in the row of the file; a Python file is parsed by Python itself, in
Arrow batches, and falls back to headings where it can't be. Lists in a row are of one file's parts, so they grow with files and not with tables.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import bound_once
from sievecraft.operators.secrets import FENCE, MARK, secret_kinds

PARTS = "array<struct<name:string,start:int,end:int,doc:string,calls:array<string>>>"
# What starts a part in each kind of file, and sizes of what is shown.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # Unicode's space separators
HEADING = r"(?d)^#{1,6}[^\S\n]+(.*\S)"
SHELL = r"^\s*(?:function\s+([A-Za-z_][\w:.-]*)\s*(?:\(\s*\))?|([A-Za-z_][\w:.-]*)\s*\(\s*\))\s*\{?\s*$"
SHELL_WORDS = ("if", "for", "while", "case")
SCRIPT = (
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*([A-Za-z_$][\w$]*)|class\s+([A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>)"
)
SUFFIXES = {"python": (".py",), "shell": (".sh", ".bash", ".zsh"), "script": (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx")}
NAME_CHARS, LINE_CHARS, DOC_CHARS, TOP_LINES, MOST_CALLS = 80, 160, 80, 30, 20
MAX_PARTS_SHOWN, PAGE_CHARS, BIG_PAGE_CHARS, FOLDER_PAGE_CHARS, OUTLINE_PARTS, OUTLINE_CHARS = 40, 500, 1400, 400, 12, 1800


def file_kind(path: Column) -> Column:
    kind = F.lit("text")
    for name, suffixes in SUFFIXES.items():
        kind = F.when(F.lower(path).rlike("(?:" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"), name).otherwise(kind)
    return kind


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _ranges(starts: Column, lines: Column) -> Column:
    """Parts from starts (name, start): each ends before the next, the last with the file."""

    def of(found: Column) -> Column:
        end = lambda s, i: F.greatest(s["start"], F.coalesce(F.get(found, i + 1)["start"] - 1, F.size(lines)))
        return F.transform(found, lambda s, i: F.struct(s["name"].alias("name"), s["start"].alias("start"), end(s, i).alias("end"), F.lit("").alias("doc"), F.array().cast("array<string>").alias("calls")))

    return bound_once(starts, of).cast(PARTS)


def _named(lines: Column, name) -> Column:
    """(name, start) of the lines for which ``name`` isn't null."""
    told = F.transform(lines, lambda x, i: F.struct(name(x).alias("name"), (i + 1).alias("start")))
    return F.filter(told, lambda s: s["name"].isNotNull())


def _first_group(line: Column, pattern: str, groups: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(line, pattern, k), F.lit("")) for k in range(1, groups + 1)])


def text_parts(text: Column) -> Column:
    """Parts of a note: its headings outside fences, and <intro> before the first where there is any text."""
    parts = F.split(F.concat(F.lit("\n"), F.translate(F.coalesce(text, F.lit("")), MARK, " ")), FENCE, -1)
    # a line inside a fence is led by the mark, so that it is no heading
    fenced = F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.concat(F.lit(MARK), F.replace(p, F.lit("\n"), F.lit("\n" + MARK)))))
    lines = F.split(F.substr(F.array_join(fenced, ""), F.lit(2)), "\n", -1)

    def of(ls: Column) -> Column:
        heads = _named(ls, lambda x: F.substring(F.nullif(F.regexp_extract(x, HEADING, 1), F.lit("")), 1, NAME_CHARS))

        def with_intro(found: Column) -> Column:
            first = F.get(found, F.lit(0))["start"]
            intro = F.exists(F.slice(ls, F.lit(1), F.greatest(first - 1, F.lit(0))), lambda x: _trim(F.translate(x, MARK, "")) != "")
            return F.when((first > 1) & intro, F.concat(F.array(F.struct(F.lit("<intro>").alias("name"), F.lit(1).alias("start"))), found)).otherwise(found)

        return _ranges(bound_once(heads, with_intro), ls)

    return bound_once(lines, of)


def shell_parts(text: Column) -> Column:
    def name(x: Column) -> Column:
        found = _first_group(x, SHELL, 2)
        return F.when(~found.isin(*SHELL_WORDS), found)

    return bound_once(_lines(text), lambda ls: _ranges(_named(ls, name), ls))


def script_parts(text: Column) -> Column:
    return bound_once(_lines(text), lambda ls: _ranges(_named(ls, lambda x: _first_group(x, SCRIPT, 3)), ls))


def text_purpose(text: Column) -> Column:
    """The first line with text that is no heading."""
    lines = F.filter(_lines(text), lambda x: (_trim(x) != "") & ~x.rlike(HEADING))
    return F.coalesce(F.substring(_trim(F.get(lines, F.lit(0))), 1, LINE_CHARS), F.lit(""))


def top_comment(text: Column, *marks: str) -> Column:
    """The comment lines (of the first of ``marks`` that gives any) at the top of a file, as one line."""

    def of(mark: str) -> Column:
        kind = "struct<said:array<string>,open:boolean>"
        start = F.struct(F.array().cast("array<string>").alias("said"), F.lit(True).alias("open")).cast(kind)

        def step(s: Column, line: Column) -> Column:
            x = F.trim(line)
            blank = (x == "") | x.startswith("#!")
            body = F.regexp_replace(F.regexp_replace(x, f"^[{mark}]+", ""), "^[ */]+|[ */]+$", "")
            said = F.when(~blank & x.startswith(mark) & (body != ""), F.concat(s["said"], F.array(body))).otherwise(s["said"])
            goes_on = F.when(blank, F.size(s["said"]) == 0).otherwise(x.startswith(mark) & (F.length(F.array_join(said, " ")) <= LINE_CHARS))
            return F.when(s["open"], F.struct(said.alias("said"), goes_on.alias("open"))).otherwise(s).cast(kind)

        joined = F.aggregate(F.slice(_lines(text), 1, TOP_LINES), start, step, lambda s: F.array_join(s["said"], " "))
        return F.nullif(F.substring(joined, 1, LINE_CHARS), F.lit(""))

    return F.coalesce(*[of(m) for m in marks], F.lit(""))


def python_contents(text: str) -> tuple[str, list[dict]] | None:
    """Purpose and functions of a Python file, methods under their class, with what they call; None where it can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last: the parser's stack overflowed
        return None
    first = lambda doc: next((x.strip()[:LINE_CHARS] for x in (doc or "").splitlines() if x.strip()), "")
    parts, open_ = [], [(node, "") for node in reversed(tree.body)]
    while open_:
        node, prefix = open_.pop()
        if isinstance(node, ast.ClassDef):
            open_ += [(inner, f"{prefix}{node.name}.") for inner in reversed(node.body)]
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)}
            parts.append({"name": prefix + node.name, "start": node.lineno, "end": node.end_lineno or node.lineno, "doc": first(ast.get_docstring(node)), "calls": sorted(calls)[:MOST_CALLS]})
    return first(ast.get_docstring(tree)), sorted(parts, key=lambda p: p["start"])


def contents(files: DataFrame, parse_python: bool = True) -> DataFrame:
    """(path, purpose, parts) of files (path, text). Null texts are empty; rows are returned each, whatever their paths. Long texts cost time in proportion.

    Without ``parse_python`` Python files go by their headings, as those do that can't be parsed.
    """
    kind = F.col("kind")
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"), file_kind(F.col("path")).alias("kind"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [python_contents(x) for x in batch["text"].to_pylist()]
            parts = pa.array([None if f is None else f[1] for f in found], PARTS_TYPE)
            yield pa.RecordBatch.from_arrays([batch["path"], batch["text"], pa.array([f[0] if f else None for f in found], pa.string()), parts], ["path", "text", "purpose", "parts"])

    told = rows.where(kind == "python").select("path", "text").mapInArrow(parsed, f"path string, text string, purpose string, parts {PARTS}")
    heads = F.coalesce("parts", text_parts(F.col("text")))
    purpose = F.when(F.col("parts").isNull(), text_purpose(F.col("text"))).otherwise(F.coalesce(F.nullif("purpose", F.lit("")), top_comment(F.col("text"), "#")))
    told = told.select("path", purpose.alias("purpose"), heads.alias("parts"))
    text = F.col("text")
    parts = F.when(kind == "shell", shell_parts(text)).when(kind == "script", script_parts(text)).otherwise(text_parts(text))
    purpose = F.when(kind == "shell", top_comment(text, "#")).when(kind == "script", top_comment(text, "//", "/*")).otherwise(text_purpose(text))
    if not parse_python:
        return rows.select("path", purpose.alias("purpose"), parts.alias("parts"))
    return rows.where(kind != "python").select("path", purpose.alias("purpose"), parts.alias("parts")).unionByName(told)


PARTS_TYPE = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("doc", pa.string()), ("calls", pa.list_(pa.string()))]))


def innermost(tables: DataFrame, places: DataFrame) -> DataFrame:
    """Places (path, line) with the smallest part of their file's table of contents around them, the later of two alike: path, line, name. Parts are looked at in the row of the file."""
    met = places.join(tables.select("path", "parts"), "path", "left")
    around = F.filter("parts", lambda p: (p["start"] <= F.col("line")) & (p["end"] >= F.col("line")))
    sized = F.transform(around, lambda p: F.struct((p["end"] - p["start"]).alias("size"), (-p["start"]).alias("start"), p["name"].alias("name")))
    return met.select("path", "line", F.array_min(sized)["name"].alias("name"))


def _fitting(rows: Column, used: Column, most: int, extra: int = 1, counted: int = 0) -> Column:
    """The first rows that fit ``most`` characters beside those that are used; the first always does. A row takes its length and ``extra``, of which ``counted`` must fit."""
    kind = "struct<rows:array<string>,used:int,open:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("rows"), used.alias("used"), F.lit(True).alias("open")).cast(kind)

    def step(s: Column, row: Column) -> Column:
        fits = s["open"] & ((F.size(s["rows"]) == 0) | (s["used"] + F.length(row) + counted <= most))
        return F.when(fits, F.struct(F.concat(s["rows"], F.array(row)).alias("rows"), (s["used"] + F.length(row) + extra).alias("used"), F.lit(True).alias("open"))).otherwise(
            F.struct(s["rows"].alias("rows"), s["used"].alias("used"), F.lit(False).alias("open"))
        ).cast(kind)

    return F.aggregate(rows, start, step)


def toc_page(path: Column, description: Column, purpose: Column, parts: Column) -> Column:
    """What is shown of a file: path, description, purpose, and as many parts (the first MAX_PARTS_SHOWN) as fit PAGE_CHARS; the names of the rest as they fit BIG_PAGE_CHARS."""
    none = F.lit("")
    head = F.concat(path, F.lit("\n"), F.coalesce(description, none), F.lit("\npurpose: "), F.coalesce(purpose, none), F.lit("\n"))
    row = lambda p: F.concat(F.lit("- "), p["name"], F.lit(" (lines "), p["start"].cast("string"), F.lit("-"), p["end"].cast("string"), F.lit(")"), F.when(p["doc"] != "", F.concat(F.lit(": "), F.substring(p["doc"], 1, DOC_CHARS))).otherwise(none))

    def of(fit: Column) -> Column:
        names = F.transform(F.slice(parts, F.size(fit["rows"]) + 1, F.greatest(F.size(parts) - F.size(fit["rows"]), F.lit(0))), lambda p: p["name"])
        kind = "struct<more:string,open:boolean>"

        def step(s: Column, name: Column) -> Column:
            fits = s["open"] & (fit["used"] + F.length(s["more"]) + F.length(name) <= BIG_PAGE_CHARS)
            return F.struct(F.when(fits, F.concat(s["more"], name, F.lit(", "))).otherwise(s["more"]).alias("more"), fits.alias("open")).cast(kind)

        more = F.aggregate(names, F.struct(F.lit("also: ").alias("more"), F.lit(True).alias("open")).cast(kind), step, lambda s: s["more"])
        rest = F.when(more == "also: ", F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(more, "[, ]+$", "")))
        return F.concat(head, F.array_join(F.concat(fit["rows"], rest), "\n"))

    return bound_once(_fitting(F.transform(F.slice(parts, 1, MAX_PARTS_SHOWN), row), F.length(head), PAGE_CHARS), of)


def folder_page(folder: Column, n: Column, names: Column) -> Column:
    """What is shown of a folder: its number of files and as many of their names, each once, as fit FOLDER_PAGE_CHARS."""
    head = F.concat(F.when(folder == "", ".").otherwise(folder), F.lit("/ ("), n.cast("string"), F.when(n == 1, " file)\n").otherwise(" files)\n"))

    def of(fit: Column) -> Column:
        rest = n - F.size(fit["rows"])
        more = F.when(rest > 0, F.array(F.concat(F.lit("... "), rest.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
        return F.concat(head, F.array_join(F.concat(fit["rows"], more), ", "))

    return bound_once(_fitting(F.array_distinct(names), F.length(head), FOLDER_PAGE_CHARS, extra=2, counted=2), of)


def outline(path: Column, purpose: Column, purpose_line: Column, parts: Column) -> Column:
    """One passage of facts about a file, each with its place, as many as fit OUTLINE_CHARS; a fact that holds a secret is left out."""
    at = F.when((purpose != "") & purpose_line.isNotNull(), F.array(F.concat(F.lit("purpose ("), path, F.lit(":"), purpose_line.cast("string"), F.lit("): "), purpose))).otherwise(F.array().cast("array<string>"))
    told = F.transform(
        F.slice(parts, 1, OUTLINE_PARTS),
        lambda p: F.concat(F.lit("part "), p["name"], F.lit(" ("), path, F.lit(":"), p["start"].cast("string"), F.lit("-"), p["end"].cast("string"), F.lit(")"), F.when(p["doc"] != "", F.concat(F.lit(": "), F.substring(p["doc"], 1, DOC_CHARS))).otherwise("")),
    )
    safe = F.filter(F.concat(at, told), lambda f: F.size(secret_kinds(f)) == 0)
    kind = "struct<rows:array<string>,used:int,open:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("rows"), F.lit(0).alias("used"), F.lit(True).alias("open")).cast(kind)

    def step(s: Column, row: Column) -> Column:
        fits = s["open"] & (s["used"] + F.length(row) + 1 <= OUTLINE_CHARS)
        return F.struct(F.when(fits, F.concat(s["rows"], F.array(row))).otherwise(s["rows"]).alias("rows"), F.when(fits, s["used"] + F.length(row) + 1).otherwise(s["used"]).alias("used"), fits.alias("open")).cast(kind)

    lead = F.concat(F.lit("Outline of "), F.element_at(F.split(path, "/"), -1), F.lit(" (facts from connected files, each with its path:line)\n"))
    return F.concat(lead, F.aggregate(safe, start, step, lambda s: F.array_join(s["rows"], "\n")))


def is_living_record(text: Column) -> Column:
    """Whether a file is kept as the one current list of its kind: an entry rule in its first lines, one section Current and a change log."""
    lines = _lines(text)
    heads = F.transform(F.filter(lines, lambda x: x.startswith("## ")), lambda x: F.lower(F.trim(x)))
    rule = F.exists(F.slice(lines, 1, 12), lambda x: x.startswith("Entry rule:"))
    return rule & (F.size(F.filter(heads, lambda h: h.startswith("## current"))) == 1) & F.exists(heads, lambda h: h.startswith("## change log") | h.startswith("## changelog"))
