"""URL filters by a cascade of Bloom filters (DataFrame functions only).

A rule is a host and a path; it fits the host and its subdomains where the url's path starts with the
rule's. The keys of a url are its host's suffixes by label, each with the prefixes of its path in the
lengths that rules have. Of its keys that are listed the longest wins.

Level 1 of a cascade encodes the listed keys, level 2 the false positives of level 1 among all keys of
the corpus, level 3 the listed keys that level 2 takes, and so on until nothing is left. Since the key
universe is complete, the first level without a key tells exactly whether it is listed. A level is a short bitmap,
sized by the keys that it encodes, and stands in the expression itself, so urls are judged in one pass, without a join.
Lists of over MAX_KEYS keys are dealt by hash into several cascades, and a key asks only its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import cut, table

#: host, path, verdict
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Listed keys of one cascade: its bitmaps hold about 16 bits for each.
MAX_KEYS = 200_000
BITS_PER_KEY = 16
HASHES = 4
CHUNK = 4096 * 8  # bits of one bitmap_construct_agg
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, to / ? # or the end; A-Z lower-cased) and path (then to ? # or the end); both empty without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys of a url: (host suffix, path prefix) of the given lengths, longest rule first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    of_length = lambda n: F.transform(suffixes, lambda s: F.struct(s.alias("h"), F.substring(path, 1, n).alias("p")))
    none = F.expr("cast(array() as array<struct<h:string,p:string>>)")
    every = F.flatten(F.array(none, *[F.when(F.length(path) >= n, of_length(n)).otherwise(none) for n in lengths]))
    return F.when(host != "", every).otherwise(none)


def _bit(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key["h"], key["p"], F.lit(1000 * level + k)), F.lit(bits))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    chunks: tuple[bytes, ...]

    def holds(self, key: Column) -> Column:
        """True if all bits of the key are set. Bit b of a chunk is bit b % 8 of its byte b / 8."""
        chunks = F.array(*[F.lit(c) for c in self.chunks])

        def is_set(bit: Column) -> Column:
            chunk = F.element_at(chunks, (F.floor(bit / CHUNK) + 1).cast("int"))
            inside = bit % CHUNK
            octet = F.conv(F.hex(F.substring(chunk, (F.floor(inside / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.call_function("getbit", octet, (inside % 8).cast("int")) == 1

        # over an array of bits, so that the bitmaps stand in the expression once
        return F.forall(F.array(*[_bit(key, self.number, k, self.bits) for k in range(HASHES)]), is_set)


def _level(keys: DataFrame, number: int, n: int) -> Level:
    """Bloom filter of the n rows of ``keys`` (key): bitmaps are built by a map-side combined aggregate."""
    bits = max(64, 1 << math.ceil(math.log2(n * BITS_PER_KEY)))
    bit = F.explode(F.array(*[_bit(F.col("key"), number, k, bits) for k in range(HASHES)]))
    made = (
        keys.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / CHUNK).alias("chunk"))
        .agg(F.bitmap_construct_agg(F.col("bit") % CHUNK).alias("bits"))
        .collect()  # of n * BITS_PER_KEY bits, n <= MAX_KEYS and a small share of that from level 2 on
    )
    have = {r.chunk: bytes(r.bits) for r in made}
    return Level(number, bits, tuple(have.get(c, bytes(4096)) for c in range(-(-bits // CHUNK))))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        listed = F.lit(len(self.levels) % 2 == 1)  # taken by all levels: listed if the last encodes listed keys
        for at in range(len(self.levels) - 1, -1, -1):
            listed = F.when(~self.levels[at].holds(key), F.lit(at % 2 == 1)).otherwise(listed)
        return listed if self.levels else F.lit(False)


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade of ``listed`` (key, at most MAX_KEYS rows) over ``universe`` (key, all distinct keys of the corpus)."""
    listed = listed.distinct()
    levels: list[Level] = []
    inside = listed
    outside = universe.join(F.broadcast(listed), "key", "left_anti")
    n = inside.count()
    while n:
        levels.append(_level(inside, len(levels), n))
        inside, outside = cut(outside.where(levels[-1].holds(F.col("key")))), inside
        n = inside.count()
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule ("host" + "path" of the longest rule that fits, else null), verdict of each page.

    ``rules``: host, path, verdict (allow or block; of a rule listed twice block counts). A url without a rule is
    allowed. A null url or one without :// has an empty host and no rule. Repeated rows are returned each.
    """
    rules = rules.select(F.struct(F.col("host").alias("h"), F.col("path").alias("p")).alias("key"), "verdict").groupBy("key").agg(F.max("verdict").alias("verdict"))
    parts = max(1, -(-rules.count() // MAX_KEYS))
    lengths = sorted(r.n for r in rules.select(F.length("key.p").alias("n")).distinct().collect())
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = cut(urls.select(F.explode("keys").alias("key")).distinct())
    part = lambda key: F.pmod(F.xxhash64(key["h"], key["p"]), F.lit(parts))

    def of(verdict: str) -> list[Cascade]:
        listed = rules.where(F.col("verdict") == verdict).select("key")
        return [cascade(listed.where(part(F.col("key")) == k), universe.where(part(F.col("key")) == k)) for k in range(parts)]

    def lists(cascades: list[Cascade], key: Column) -> Column:
        found = F.lit(False)
        for k, c in enumerate(cascades):
            found = F.when(part(key) == k, c.lists(key)).otherwise(found)
        return found

    allow, block = of("allow"), of("block")
    told = F.transform("keys", lambda k: F.struct(k["h"].alias("h"), k["p"].alias("p"), F.when(lists(block, k), "block").when(lists(allow, k), "allow").alias("verdict")))
    order = lambda k: F.struct(F.length(k["h"]) + F.length(k["p"]), F.length(k["h"]), k["h"], k["p"], k["verdict"])
    best = F.array_max(F.transform(F.filter(told, lambda k: k["verdict"].isNotNull()), order))
    return urls.withColumn("best", best).select(
        "page_id",
        "host",
        "path",
        F.concat(F.col("best.h"), F.col("best.p")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP9_SQL = r"""
WITH r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(verdict, length(h || p)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""
