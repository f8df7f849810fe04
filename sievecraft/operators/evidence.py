"""Evidence that a walk gathered: who fills which role, what is missing, and whether the last question may be asked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what marks a document that another replaces.
SUPERSEDED = r"(?i)\bsuperseded\b"


@dataclass(frozen=True)
class Role:
    """A role: which documents fill it (a test of the columns root, id and text), whether one must, whether only one may."""

    name: str
    fills: Callable[[], Column]
    required: bool = True
    unique: bool = True


def role_self(name: str, **kinds) -> Role:
    return Role(name, lambda: F.col("id") == F.col("root"), **kinds)


def role_prefix(name: str, prefix: str, **kinds) -> Role:
    return Role(name, lambda: F.col("id").startswith(prefix), **kinds)


def role_pattern(name: str, pattern: str, of: str = "id", **kinds) -> Role:
    return Role(name, lambda: F.col(of).rlike(pattern), **kinds)


def role_of(roles: list[Role]) -> Column:
    """Number of the first role that a document fills; null for none."""
    found = F.when(F.lit(False), 0)
    for k, role in enumerate(roles):
        found = found.when(role.fills(), k)
    return found


def completeness(visits: DataFrame, reports: DataFrame, roles: list[Role], dangling_blocks: bool = True) -> DataFrame:
    """For each root: problems (in order, joined by ;) and complete. ``visits``: root, id, text of the documents reached; ``reports``: root, dangling, truncated.

    A superseded document fills nothing. A required role without a live document, a unique one with several, a walk that was cut short and, unless
    told otherwise, a reference to a document that nobody holds are problems. Documents are counted, never gathered.
    """
    rows = visits.withColumn("_role", role_of(roles)).withColumn("_old", F.coalesce(F.col("text").rlike(SUPERSEDED), F.lit(False)))
    counts = []
    for k in range(len(roles)):
        mine = F.col("_role") == k
        counts += [F.count_if(mine & ~F.col("_old")).alias(f"live{k}"), F.count_if(mine & F.col("_old")).alias(f"old{k}")]
    told = reports.join(rows.groupBy("root").agg(*counts), "root", "left")
    problems = []
    for k, role in enumerate(roles):
        live, old = F.coalesce(f"live{k}", F.lit(0)), F.coalesce(f"old{k}", F.lit(0))
        if role.required:
            problems.append(F.when((live == 0) & (old > 0), f"{role.name}: superseded").when(live == 0, f"{role.name}: missing"))
        if role.unique:
            problems.append(F.when(live > 1, F.concat(F.lit(f"{role.name}: "), live.cast("string"))))
    problems.append(F.when(F.col("truncated"), "truncated"))
    if dangling_blocks:
        problems.append(F.when(F.col("dangling") > 0, F.concat(F.lit("dangling: "), F.col("dangling").cast("string"))))
    listed = F.array_compact(F.array(*problems))
    return told.select("root", F.array_join(listed, "; ").alias("problems"), (F.size(listed) == 0).alias("complete"))


def askable(cases: DataFrame, complete: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (root, ...) that may be asked, and those that incomplete evidence blocks, with their problems."""
    rows = cases.join(complete, "root", "left")
    ok = F.coalesce("complete", F.lit(False))
    return rows.where(ok).drop("problems", "complete"), rows.where(~ok).drop("complete")


def prose_references(text: Column, patterns: tuple[str, ...]) -> Column:
    """Distinct ids that the patterns' first groups find in a text, in order of the patterns."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])))
