"""Sharding over fixed virtual slots.

Records hash by id into a fixed number of slots, far more than there are
shards. Bytes are summed per slot, and a versioned map says which shard holds
which slot. A new map places the heaviest slots first, each on the lightest
shard, so shards end near equal in bytes. Rebalancing edits the map: it moves
few slots and writes the next version; records never hash anew.

The map has one entry per slot, a size fixed by ``slots`` and not by the data:
it is planned on the driver from one total per slot, and broadcast.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millbook.llm.text import text_of
from millbook.plans.lineage import shared_dir, staged

SLOTS = 4096
HOT = 4.0             # mean slots of bytes or rows; the rows of a key with more are dealt over all slots


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 8 for the id; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``id_col, size, text_crc32, virtual_slot`` of every row (staged; the texts are read once).

    A null id hashes by its text, so many of them still spread.
    """
    text = text_of(docs, text_col)
    crc = F.crc32(text)
    rows = docs.select(F.col(id_col), record_size(F.col(text_col).cast("string")).alias("size"), crc.alias("text_crc32"))
    slot = F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col("text_crc32"))), F.lit(slots))
    return staged(rows.withColumn("virtual_slot", slot), "sharded")


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Slot -> (bytes, rows); at most one entry per slot."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["n"]) for r in found}


def hot_spread(rows: DataFrame, totals: dict[int, tuple[int, int]], id_col: str = "doc_id",
               slots: int = SLOTS) -> DataFrame:
    """``rows``, each row of a key with over ``HOT`` mean slots of bytes or rows hashed by itself (staged then).

    A key is an id, or the text's checksum of a null id. Only keys of slots as heavy are counted, and at most
    ``2 * slots / HOT`` keys can be hot. Equal rows part by their place in the staged table.
    """
    most, many = (HOT * sum(t[i] for t in totals.values()) / slots for i in (0, 1))
    heavy = [s for s, (b, n) in totals.items() if n > 1 and (b > most or n > many)]
    if not heavy:
        return rows
    own = [F.col(id_col), F.when(F.col(id_col).isNull(), F.col("text_crc32"))]
    hot = staged(rows.filter(F.col("virtual_slot").isin(heavy)).groupBy(own[0].alias("hot_id"), own[1].alias("hot_crc"))
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
                 .filter((F.col("n") > 1) & ((F.col("bytes") > most) | (F.col("n") > many)))
                 .select("hot_id", "hot_crc", F.lit(True).alias("hot")), "hot-keys")
    if hot.isEmpty():
        return rows
    found = rows.withColumn("nth", F.monotonically_increasing_id()).join(
        F.broadcast(hot), own[0].eqNullSafe(F.col("hot_id")) & own[1].eqNullSafe(F.col("hot_crc")), "left")
    slot = F.when(F.col("hot"), F.pmod(F.xxhash64(id_col, "text_crc32", "nth"), F.lit(slots))).otherwise(
        F.col("virtual_slot"))
    return staged(found.withColumn("virtual_slot", slot).select(*rows.columns), "sharded")


def new_map(weights: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Slot -> shard: heaviest slot first onto the lightest shard; ties go to the lower number."""
    heap = [(0, s) for s in range(shards)]
    where = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        where[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return where


def _loads(where: list[int], weights: dict[int, int], shards: int) -> list[int]:
    loads = [0] * shards
    for slot, shard in enumerate(where):
        loads[shard] += weights.get(slot, 0)
    return loads


def rebalanced(where: list[int], weights: dict[int, int], shards: int, tolerance: float = 0.01) -> list[int]:
    """An edited map for ``shards`` shards (as many as before or more).

    While the heaviest shard is over the mean by more than ``tolerance``, its
    slot that best fills the lightest shard moves there. Slots that need not
    move stay, so a grown map moves slots only off the shards that are too heavy.
    """
    where, loads = list(where), _loads(where, weights, shards)
    mean = sum(loads) / shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(where):
        held[shard].append(slot)
    while True:
        top = max(range(shards), key=lambda s: (loads[s], -s))
        low = min(range(shards), key=lambda s: (loads[s], s))
        gap = loads[top] - loads[low]
        movable = [s for s in held[top] if 0 < weights.get(s, 0) < gap]
        if loads[top] <= mean * (1 + tolerance) or not movable:
            return where
        slot = min(movable, key=lambda s: (abs(gap / 2 - weights[s]), s))
        held[top].remove(slot)
        held[low].append(slot)
        where[slot] = low
        loads[top] -= weights[slot]
        loads[low] += weights[slot]


def store_map(spark: SparkSession, where: list[int], path: str, version: int) -> None:
    """Write the map as one version of the table at ``path``; an existing version is never changed."""
    frame = spark.createDataFrame(list(enumerate(where)), "virtual_slot long, shard int").coalesce(1)
    frame.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A stored version of the map, the latest by default."""
    table = spark.read.schema("virtual_slot long, shard int, version int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return [r["shard"] for r in table.filter(F.col("version") == version).orderBy("virtual_slot").collect()]


def assigned(rows: DataFrame, where: list[int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """``rows`` with their ``shard`` and ``place``: 0, 1, 2, ... within a shard, without a gap.

    A shard's slots lie one after another; a row's place is the rows of earlier
    slots plus its number within its slot. Only slots are windowed, never shards.
    """
    filled, before = {}, []
    for slot, shard in enumerate(where):
        before.append(filled.get(shard, 0))
        filled[shard] = filled.get(shard, 0) + totals.get(slot, (0, 0))[1]
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(zip(where, before, strict=True))],
                                  "virtual_slot long, shard int, first long")
    order = [c for c in rows.columns if c != "virtual_slot"]
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1
    return (rows.withColumn("inside", inside).join(F.broadcast(table), "virtual_slot")
            .withColumn("place", F.col("first") + F.col("inside")).drop("first", "inside"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
          slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``id_col, size, text_crc32, virtual_slot, shard, place`` for every row of ``docs``.

    The map is stored as version 1 of the table at ``path`` (by default a new
    one in the shared folder) and read back from there.
    The law is ``bytes``: shards near equal in bytes. Rows of one id share a
    slot, but for ids that repeat so often that they would outgrow it (see
    ``hot_spread``); empty input gives no rows; other columns are not read.
    """
    rows = with_slots(docs, id_col, text_col, slots)
    totals = slot_totals(rows)
    spread = hot_spread(rows, totals, id_col, slots)
    if spread is not rows:
        rows, totals = spread, slot_totals(spread)
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"
    store_map(spark, new_map({s: b for s, (b, _) in totals.items()}, shards, slots), path, 1)
    return assigned(rows, load_map(spark, path), totals)
