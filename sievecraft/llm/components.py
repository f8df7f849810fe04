"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import cut, release

#: Edges (16 bytes each) up to which the rounds stay in one partition and shuffle nothing; a round of more is dealt over all tasks.
FEW = 50_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("v", "u")])
    return down.join(least, "u").select(F.inline(linked)).where("u <> v")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Alternating large-star and small-star rounds over edges (u, v) of long ids, u <> v.

    Result: one row (vertex, root) for each vertex that is not itself the smallest of its
    component. The rounds grow with the logarithm of the vertices; each is cut, and only two
    numbers of a round reach the driver. Of at most ``few`` edges a round is one small task.
    """
    edges, seen, n = cut(edges.select("u", "v").distinct()), None, None
    while True:
        n = edges.count() if n is None else n
        if not n:
            break
        if n <= few:
            edges = edges.coalesce(1)
        edges = cut(_small_star(_large_star(edges).distinct()).distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen:
            break
        seen, n = (state.n, state.h), state.n
    release(edges.sparkSession)
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
