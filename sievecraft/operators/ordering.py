"""Seeded orders and splits of rows: the place of any row is computed from its rank alone, so nothing is sorted into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.plans.lineage import cut

#: A prime above which no half of a place reaches, rounds of the network, and steps after which a walk outside the rows has ended (it goes on with a chance of a half at most).
PRIME, ROUNDS, STEPS = 2_147_483_647, 4, 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Factor and term of each round."""
    keys, x = [], seed % PRIME
    for _ in range(2 * ROUNDS):
        x = (x * 48_271 + 11) % PRIME
        keys.append(x or 1)
    return list(zip(keys[::2], keys[1::2], strict=True))


def halves(n: int) -> tuple[int, int]:
    """Sizes (powers of two) of the two halves of a place: together the least that holds ``n`` rows."""
    bits = max(2, (n - 1).bit_length())
    return 1 << bits // 2, 1 << bits - bits // 2


def permuted(rank: Column, n: int, seed: int) -> Column:
    """The place of each rank from 0 to n - 1 in a permutation that the seed determines: a Feistel network over the two halves of the rank, walked on while it leads outside the rows.

    Up to 2 ** 60 rows.
    """
    if n <= 1:
        return F.lit(0).cast("long") + rank * 0
    small, large = halves(n)

    def mixed(half: Column, key: tuple[int, int]) -> Column:
        x = half % PRIME
        return ((x * x % PRIME) * key[0] + key[1]) % PRIME

    def network(place: Column) -> Column:
        state = F.struct(F.floor(place / large).cast("long").alias("a"), (place % large).alias("b"))
        for k, key in enumerate(round_keys(seed)):
            # in turn the small half is moved by the large one, and the large by the small
            if k % 2 == 0:
                step = lambda s, key=key: F.struct(((s["a"] + mixed(s["b"], key)) % small).alias("a"), s["b"].alias("b"))
            else:
                step = lambda s, key=key: F.struct(s["a"].alias("a"), ((s["b"] + mixed(s["a"], key)) % large).alias("b"))
            state = _applied(state, step)
        return _applied(state, lambda s: s["a"] * large + s["b"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), network(rank.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a place was not found")).cast("long"))


def _applied(value: Column, use) -> Column:
    """use(value), with the value computed once; ``use`` takes one argument."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """The rows with their rank from 0 by ``order`` (nulls first; equal rows in any order): sorted in ranges, of which only the sizes, a row for each, meet in one task."""
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    first = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = first.select("_part", "_first", before.alias("_before"))
    return sorted_.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def in_order(rows: DataFrame, order: list[str], kind: str = "forward", seed: int = 0) -> DataFrame:
    """The rows with ``rank`` by ``order`` and ``place``: forward, reverse, or shuffle by the seed."""
    told = cut(ranked(rows, order))
    n = told.count()
    places = {"forward": F.col("rank"), "reverse": F.lit(n - 1) - F.col("rank"), "shuffle": permuted(F.col("rank"), n, seed)}
    return told.withColumn("place", places[kind].cast("long"))


def with_split(rows: DataFrame, order: list[str], fraction: float, seed: int) -> DataFrame:
    """The rows with ``held_out``: the first of them in the seed's order, as many as the fraction of all, rounded half up."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction that is held out is from 0 to 1")
    told = cut(in_order(rows, order, "shuffle", seed))
    n = told.count()
    return told.withColumn("held_out", F.col("place") < int(n * fraction + 0.5)).drop("rank", "place")
