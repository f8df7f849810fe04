"""Budgeted plans: records into calls in their order, with limits on number and size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_fit(sizes: Column, max_count: int, max_size: int, envelope: int = 0) -> Column:
    """Call index of each element of an ordered array of sizes, -1 for one that can't fit any call.

    A new call starts when the open one has ``max_count`` records or would pass ``max_size``. The fold carries the open call and
    one number for each record; an array is a request, a conversation or a folder, not a corpus.
    """
    zero = F.struct(F.lit(0).alias("call"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = x.cast("long") + envelope
        too_large = size > max_size
        full = (s["n"] > 0) & ((s["n"] >= max_count) | (s["used"] + size > max_size))
        call = F.when(full, s["call"] + 1).otherwise(s["call"])
        put = F.struct(
            call.alias("call"),
            F.when(full, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(full, size).otherwise(s["used"] + size).alias("used"),
            F.concat(s["out"], F.array(call)).alias("out"),
        )
        skip = F.struct(s["call"].alias("call"), s["n"].alias("n"), s["used"].alias("used"), F.concat(s["out"], F.array(F.lit(-1))).alias("out"))
        return F.when(too_large, skip).otherwise(put)

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def _in_order(rows: DataFrame, group: str, order: str, size: Column, start: Callable, step: Callable, name: str, kind: str, newest: bool = False) -> DataFrame:
    """group, ``order``, size and what ``step(state, size)`` says of each row, in order within its group; ``start()`` is the state of a new group.

    Rows are sorted in their partitions and read as a stream, so a task holds one state, however many rows a group has.
    """
    picked = rows.select(group, order, size.cast("long").alias("size"), F.col(group).cast("string").alias("_group"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, order)}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            told = []
            for g, n in zip(batch["_group"].to_pylist(), batch["size"].to_pylist(), strict=True):
                if g != current:
                    current, state = g, start()
                told.append(step(state, n))
            yield pa.RecordBatch.from_arrays([batch[group], batch[order], batch["size"], pa.array(told, pa.int32() if kind == "int" else pa.bool_())], [group, order, "size", name])

    by = F.desc(order) if newest else F.col(order)
    ordered = picked.repartition(F.col(group)).sortWithinPartitions("_group", by)
    return ordered.mapInArrow(fold, f"{group} {kinds[group]}, {order} {kinds[order]}, size bigint, {name} {kind}")


def plan_calls(records: DataFrame, group: str, order: str, size: Column, max_count: int, max_size: int) -> DataFrame:
    """group, ``order``, size and call of each record, planned in order within each group as by next_fit."""

    def step(open_: list[int], n: int) -> int:
        call, count, used = open_
        if n > max_size:
            return -1
        if count and (count >= max_count or used + n > max_size):
            call, count, used = call + 1, 0, 0
        open_[:] = call, count + 1, used + n
        return call

    return _in_order(records, group, order, size, lambda: [0, 0, 0], step, "call", "int")


def fit_window(rows: DataFrame, group: str, order: str, size: Column, room: int) -> DataFrame:
    """group, ``order`` and kept of each row, the newest first: each that still fits in what is left of the group's room."""

    def step(used: list[int], n: int) -> bool:
        fits = used[0] + n <= room
        used[0] += n if fits else 0
        return fits

    return _in_order(rows, group, order, size, lambda: [0], step, "kept", "boolean", newest=True).drop("size")


def call_totals(plan: DataFrame, group: str) -> DataFrame:
    """Number and size of the records of each call; records that fit none are counted under call -1."""
    return plan.groupBy(group, "call").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def records_per_call(requested: Column, questions: Column, cap: int = 255) -> Column:
    """How many records a call may have if each is asked every question."""
    return F.least(requested, F.floor(F.lit(cap) / questions)).cast("int")


def fit_by_priority(sizes: Column, room: int) -> Column:
    """Which elements of an array, in order of priority, are kept: each that still fits in what is left of the room."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x.cast("long") <= room
        used = F.when(fits, s["used"] + x.cast("long")).otherwise(s["used"])
        return F.struct(used.alias("used"), F.concat(s["out"], F.array(fits)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def pack_groups(files: DataFrame, group: str, order: str, size: Column, max_files: int = 6, max_size: int = 24_000) -> DataFrame:
    """Consecutive packs of files within each group; a file too large for a pack and a pack of one file are left out."""
    planned = plan_calls(files, group, order, size, max_files, max_size).where("call >= 0")
    packs = planned.groupBy(group, "call").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min(order).alias("first"), F.max(order).alias("last"))
    return packs.where("n > 1").drop("call")
