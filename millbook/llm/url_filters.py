"""URL filters by a cascade of Bloom filters: exact membership without joins.

A rule is a host, a path and an action; it fits the host and all its
subdomains where the path starts with the rule's, and the longest fitting rule
wins. A URL's keys are the pairs (host suffix, path opening) that could be a
rule: suffixes of as many labels, openings of as many characters, as some rule
has. The corpus's complete key universe is known before the filters are built,
so a cascade can be exact on it: level 1 encodes the listed keys, level 2 the
unlisted keys of the universe that pass level 1, level 3 the listed keys that
pass level 2, and so on until nothing passes wrongly. A key is listed if the
first level it fails has an even number (or it passes all and their number is odd).

There is one cascade per action. A level holds about ``log2(1/p) / ln 2`` bits
per key; with the first level's rate set by the size of the universe the later
ones hold fewer keys than the list, so the filters grow with the list times
the logarithm of the universe. They travel inside the plan as literals, in
shards of the key space of at most ``max_bytes`` each; every shard is one more
pass over the keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millbook.plans.lineage import staged

MAX_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ACTIONS = ("allow", "block")


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/ ? #`` with A-Z lower-cased, then up to ``? #``; else both empty."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: list[int], openings: list[int]) -> Column:
    """``struct(length, host_length, key)`` of every pair of a host suffix and a path opening that a rule could have."""
    parts = F.split(host, r"\.", -1)
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")) for n in labels]
    keys = [F.when(s.isNotNull() & (F.length(path) >= k), F.struct(
        (F.length(s) + k).alias("length"), F.length(s).alias("host_length"),
        F.concat(s, F.substring(path, 1, k)).alias("key"))) for s in suffixes for k in openings]
    return F.array_compact(F.array(*keys))


@dataclass
class BloomLevel:
    """``hashes`` positions among the bits of ``filled``, salted by the level's number."""

    filled: bytes
    hashes: int
    salt: int

    def passes(self, key: Column) -> Column:
        hit = F.lit(True)
        for at in _positions(key, self.salt, self.hashes, 8 * len(self.filled)):
            byte = F.substring(F.lit(self.filled), (F.floor(at / 8) + 1).cast("int"), F.lit(1))
            hit = hit & (F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")), (at % 8).cast("int")) == 1)
        return hit


def _positions(key: Column, salt: int, hashes: int, bits: int) -> list[Column]:
    """Double hashing: ``h1 + j * h2`` modulo the bits, both halves kept small enough not to overflow."""
    h1 = F.pmod(F.xxhash64(F.lit(2 * salt), key), F.lit(bits))
    h2 = F.pmod(F.xxhash64(F.lit(2 * salt + 1), key), F.lit(bits))
    return [F.pmod(h1 + h2 * j, F.lit(bits)) for j in range(hashes)]


def bloom_level(keys: DataFrame, n: int, rate: float, salt: int) -> BloomLevel:
    """A filter over the ``n`` keys of ``keys`` (column ``key``) that passes others at about ``rate``.

    Bits are set in Spark (a grouped ``bit_or`` per byte); the driver receives
    the filter's bytes, a size set by ``n`` and ``rate``.
    """
    hashes = max(1, round(math.log2(1 / rate)))
    size = max(1, math.ceil(n * hashes / math.log(2) / 8))
    found = (keys.select(F.explode(F.array(*_positions(F.col("key"), salt, hashes, 8 * size))).alias("at"))
             .groupBy(F.floor(F.col("at") / 8).alias("byte"))
             .agg(F.bit_or(F.pow(F.lit(2), F.col("at") % 8).cast("int")).alias("bits")))
    filled = bytearray(size)
    for r in found.collect():
        filled[r["byte"]] = r["bits"]
    return BloomLevel(bytes(filled), hashes, salt)


def cascade(universe: DataFrame, listed: str) -> list[BloomLevel]:
    """Levels that tell exactly which keys of ``universe`` (``key`` and a boolean column ``listed``) are listed."""
    remaining = universe.select("key", F.col(listed).alias("in"))
    levels: list[BloomLevel] = []
    while True:
        count = {r["in"]: r["count"] for r in remaining.groupBy("in").count().collect()}
        encode = len(levels) % 2 == 0  # odd levels hold listed keys
        n, others = count.get(encode, 0), count.get(not encode, 0)
        if n == 0:
            return levels
        rate = min(0.5, max(1e-9, n / (math.sqrt(2) * max(others, 1)))) if not levels else 0.5
        level = bloom_level(remaining.filter(F.col("in") == encode), n, rate, len(levels) + 1)
        levels.append(level)
        if others == 0:
            return levels
        # those encoded all pass; of the others only the false positives go on
        remaining = staged(remaining.filter((F.col("in") == encode) | level.passes(F.col("key"))), "cascade")
        if remaining.filter(F.col("in") != encode).isEmpty():
            return levels


def is_listed(levels: list[BloomLevel], key: Column) -> Column:
    """Exact for every key of the universe the levels were built on."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
    return answer


def filter_urls(pages: DataFrame, rules: Iterable[Rule], id_cols: list[str], url_col: str = "url",
                default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``id_cols, host, path, rule, verdict`` for every row of ``pages``.

    ``rule`` is the key of the longest fitting rule (the longer host on a tie),
    else null; ``verdict`` its action, else ``default``. A null URL, or one
    without ``://``, has an empty host and path and fits no rule. Two rules of
    one key: ``block`` stands.
    """
    spark: SparkSession = pages.sparkSession
    by_key = {r.key: r for r in sorted(rules, key=lambda r: _ACTIONS.index(r.action))}
    labels = sorted({r.host.count(".") + 1 for r in by_key.values()})
    openings = sorted({len(r.path) for r in by_key.values()})
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(*id_cols, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, openings))
    best = F.lit(None).cast("struct<length:int,host_length:int,key:string,action:string>")
    if by_key:
        rows = staged(rows, "urls")
        schema = "key string, action string"
        listed = spark.createDataFrame([(r.key, r.action) for r in by_key.values()], schema)
        keys = rows.select(F.explode("keys.key").alias("key")).distinct().withColumn("action", F.lit(None).cast("string"))
        universe = staged(keys.unionByName(listed).groupBy("key").agg(F.max("action").alias("action")).select(
            "key", *[(F.coalesce("action", F.lit("")) == a).alias(a) for a in _ACTIONS]), "universe")
        size = max(1, len(by_key))
        seen = universe.count()
        bits = size * (math.log2(max(seen / size, 2)) + 4) / math.log(2)
        shards = max(1, math.ceil(bits / 8 / max_bytes))
        rows = rows.withColumn("best", best)
        for s in range(shards):
            mine = F.pmod(F.xxhash64(F.lit(0), "key"), F.lit(shards)) == s
            part = universe if shards == 1 else staged(universe.filter(mine), "universe")
            levels = {a: cascade(part, a) for a in _ACTIONS}

            def found(action: str, levels=levels, s=s) -> Column:
                def hit(k: Column) -> Column:
                    own = is_listed(levels[action], k["key"])
                    return own if shards == 1 else (F.pmod(F.xxhash64(F.lit(0), k["key"]), F.lit(shards)) == s) & own
                return F.transform(F.filter("keys", hit), lambda k: F.struct(
                    k["length"].alias("length"), k["host_length"].alias("host_length"), k["key"].alias("key"),
                    F.lit(action).alias("action")))

            own = F.array_max(F.concat(*[found(a) for a in _ACTIONS if levels[a]])) if any(levels.values()) else best
            rows = rows.withColumn("best", F.greatest("best", own))
            if s < shards - 1:
                rows = staged(rows, "urls")
    else:
        rows = rows.withColumn("best", best)
    return rows.select(*id_cols, "host", "path", F.col("best.key").alias("rule"),
                       F.coalesce("best.action", F.lit(default)).alias("verdict"))
