"""Exact dedup by deterministic block naming.

The normalised text is cut into fixed-size blocks of bytes. Distinct blocks
are sorted and get integer names; then adjacent names are paired, distinct
pairs are named the same way, and so on until every document has one name.
Two documents have the same (level, name) exactly when their texts are equal:
names stand for contents, never for hashes.

The text itself is shuffled once, in the grouping that finds the distinct
blocks (combined map-side, so a block that a third of the corpus shares moves
once per task). Documents find the names of their blocks through a 128-bit
link of each block. Before it is used, the link is checked to be injective on
all distinct blocks of the corpus; if two blocks share one, the next seed is
tried, so a collision can change the running time and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millbook.llm.text import WHITESPACE, row_key, rows_of, text_of
from millbook.plans.lineage import staged

BLOCK_BYTES = 4096


def _link(block: Column, seed: int, bits: int) -> list[Column]:
    """Two 64-bit words; ``bits`` < 128 keeps fewer (tests force collisions with it)."""
    def words(s: int, n: int) -> Column:
        h = F.xxhash64(F.lit(s), block)
        return h if n >= 64 else h.bitwiseAND(F.lit((1 << n) - 1)) if n > 0 else F.lit(0).cast("long")
    return [words(2 * seed, min(bits, 64)).alias("a"), words(2 * seed + 1, bits - 64).alias("b")]


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys sorted within their hash partitions; the name is the place in that order."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """``bytes`` (normalised text) and ``n_blocks`` (1 for an empty text) beside the columns of ``docs``."""
    return (docs.withColumn("bytes", F.translate(text_of(docs, text_col), WHITESPACE, "").cast("binary"))
            .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes).cast("int"))))


def _block(i: Column, block_bytes: int) -> Column:
    return F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes))


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES, link_bits: int = 128) -> DataFrame:
    """One row per row of ``docs``: ``rid, id, n_chars, text_sha256, level, name`` (staged).

    ``(level, name)`` is the identity of the normalised text. A null text is
    an empty one (one empty block).
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        base = _blocks(source, "text", block_bytes)
        rows = staged(base.select(
            F.monotonically_increasing_id().alias("rid"), "id",
            F.char_length(text_of(source, "text")).alias("n_chars"), F.sha2("bytes", 256).alias("text_sha256"),
            F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                        lambda i: F.struct(*_link(_block(i, block_bytes), seed, link_bits))).alias("links")), "docs")
        contents = (base.select("bytes", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("i"))
                    .select(_block(F.col("i"), block_bytes).alias("block")).distinct())
        names = staged(_named(contents, ["block"]).select(
            *_link(F.col("block"), seed, link_bits), "name"), "block-names")
        if names.groupBy("a", "b").count().filter("count > 1").isEmpty():
            break
        seed, link_bits = seed + 1, min(128, 2 * link_bits)
    longest = rows.agg(F.max(F.size("links"))).first()[0] or 0
    parts = (rows.select("rid", F.size("links").alias("n"), F.posexplode("links").alias("pos", "link"))
             .select("rid", "n", "pos", F.col("link.a").alias("a"), F.col("link.b").alias("b"))
             .join(names, ["a", "b"]).select("rid", "n", "pos", "name"))
    finished, level = [parts.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = staged(
            parts.filter("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.ceil(F.max("n") / 2).cast("int").alias("n")), "pairs")
        names = staged(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        parts = pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name")
        finished.append(parts.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    ids = finished[0]
    for more in finished[1:]:
        ids = ids.unionByName(more)
    return staged(rows.drop("links").join(ids, "rid"), "identities")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES, link_bits: int = 128) -> DataFrame:
    """Group the rows of ``docs`` by equal text (white space ignored).

    One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` of the normalised text, ``name_level``, ``name`` and
    ``n_chars``. Of a group the row with the most code points in its original
    text stays, then the smallest id (a null id last); of wholly equal rows one.
    Empty input gives no rows; other columns of ``docs`` are not read.
    """
    named = name_texts(docs, id_col, text_col, block_bytes, link_bits)
    best = F.max(F.struct("n_chars", F.col("id").isNotNull().alias("has_id"),
                          F.bitwise_not("id").alias("low_id"), F.bitwise_not("rid").alias("low_rid")))
    groups = staged(named.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
                    .select("level", "name", "group_size", F.bitwise_not("best.low_id").alias("keep_id"),
                            F.bitwise_not("best.low_rid").alias("keep_rid")), "groups")
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        "text_sha256", F.col("level").alias("name_level"), "name", "n_chars")


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of equal texts of equal length the smallest ``doc_id`` stays (where
    ``docs`` has that column). Rows equal in id and text count as one row.
    """
    doc = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    source = docs.select(F.struct(doc.alias("doc"), row_key(docs, text_col).alias("key")).alias("id"),
                         F.col(text_col).alias("text"))
    named = name_texts(source, "id", "text", **options)
    best = F.max(F.struct("n_chars", F.col("id.doc").isNotNull().alias("has_doc"),
                          F.bitwise_not("id.doc").alias("low_doc"), F.col("id.key").alias("key")))
    keep = named.groupBy("level", "name").agg(best.alias("best")).select("best.key")
    repeated = not named.groupBy("id.key").count().filter("count > 1").isEmpty()
    return rows_of(docs, keep, text_col, once=repeated)
