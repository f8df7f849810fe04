"""Heading-aware line chunks of documents. One document at a time, in Arrow batches: a chunk's start depends on all lines before it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_WORDS = 180
HEADING = re.compile(r"(#{1,6})\s+(.*)")


def chunk_lines(text: str, target: int = TARGET_WORDS) -> Iterator[tuple[int, int, str, str]]:
    """(first line, last line, heading trail, text) of each chunk; lines count from 1.

    A heading or a line that would pass ``target`` words starts a new chunk. A skipped heading level stays empty in the trail. Blank
    lines belong to the chunk they stand in; a chunk of blank lines alone is dropped.
    """
    trail: list[str] = []
    held: list[str] = []
    first, words = 1, 0

    def done() -> Iterator[tuple[int, int, str, str]]:
        if any(x.strip() for x in held):
            yield first, first + len(held) - 1, " > ".join(trail), "\n".join(held)
        held.clear()

    for number, line in enumerate(text.split("\n"), 1):
        size, heading = len(line.split()), HEADING.match(line)
        if heading or (words and words + size > target):
            yield from done()
            words = 0
        if heading:
            level = len(heading[1])
            trail = [*trail[: level - 1], *[""] * (level - 1 - len(trail)), heading[2]]
        if not held:
            first = number
        held.append(line)
        words += size
    yield from done()


def chunks(docs: DataFrame, target: int = TARGET_WORDS) -> DataFrame:
    """doc_id, source_sha, idx, first_line, last_line, heading, text of every chunk. Null text has none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "source_sha", "idx", "first_line", "last_line", "heading", "text"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text:
                    sha = hashlib.sha256(text.encode()).hexdigest()
                    rows += [(doc_id, sha, k, *c) for k, c in enumerate(chunk_lines(text, target))]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(made, f"doc_id {kind}, source_sha string, idx int, first_line int, last_line int, heading string, text string")
