"""Mixing sources to target weights by systematic sampling.

Every source has a target in words; a document's expected copies are its
source's target over its source's size. Within a source the expected copies
are summed in order (a prefix sum), one random offset per source is added, and
a document is emitted once per integer boundary its interval crosses. Documents
are taken in order of size, so neighbouring boundaries fall on documents of
like size and the words taken stay within about one document of the target.

Expected copies are integers in units of 2**-24, so prefix sums are exact
whatever the partitioning: an interval starts where the one before it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millbook.functions.paging import dense_number
from millbook.functions.prefix import running_sum
from millbook.llm.text import WORD, fresh, row_key, text_of
from millbook.plans.lineage import staged

UNIT = 1 << 24
SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (3, 1, 2), 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, share: float = SHARE, cap: float = CAP,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` of each source in ``sized`` (``source, size``).

    Sources in code-point order, null last, weigh ``weights`` over and over.
    Together they get ``share`` times all sizes. A target stops at ``cap``
    times its source's size and the excess is shared again by weight until none
    is above: every target is ``min(cap * size, level * weight)``, and with the
    sources sorted by ``cap * size / weight`` the level is the first at which
    the next source stays under its cap. Running sums find it, so the number of
    sources may grow with the corpus.
    """
    sizes = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                   .withColumn("last", F.col("source").isNull()), "sources")
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    ranked = dense_number(sizes, ["last", "source"], "place", start=0).withColumn(
        "weight", F.element_at(wheel, (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("ratio", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    ranked = running_sum(ranked, ["ratio", "place"], "source_size", "size_to_here")
    ranked = staged(running_sum(ranked, ["ratio", "place"], "weight", "weight_to_here"), "targets")
    totals = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"))
    total, all_weights = (F.coalesce(totals.select(c).scalar(), F.lit(0)) for c in ("s", "w"))
    # the level if every source before this one is at its cap and this one is not
    level = ((total * F.lit(float(share)) - (F.col("size_to_here") - F.col("source_size")) * F.lit(float(cap)))
             / (all_weights - F.col("weight_to_here") + F.col("weight")))
    levels = ranked.select("ratio", "place", level.alias("level")).filter("level <= ratio")
    # none: share >= cap, every source stops at its cap
    first = levels.agg(F.min_by("level", F.struct("ratio", "place")).alias("m")).scalar()
    capped = F.col("source_size") * F.lit(float(cap))
    return ranked.select("source", "source_size",
                         F.coalesce(F.least(capped, first * F.col("weight")), capped).alias("target"))


def plan_mix(docs: DataFrame, keys: list[str], text_col: str = "text", source_col: str = "source",
             share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: its ``keys``, ``source, size, source_size, target, copies``.

    ``size`` counts words (0 for a null text); ``copies`` is how often the mix
    emits the document, never above ``ceil(cap)``. The same input and seed give
    the same plan; rows equal in size and keys may swap their copies.
    """
    sized = staged(docs.select(*keys, F.col(source_col).alias("source"),
                               word_count(text_of(docs, text_col)).alias("size")), "sizes")
    targets = staged(source_targets(sized, share, cap, weights), "source-targets")
    rate = F.coalesce(F.round(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * UNIT), F.lit(0.0))
    per = targets.select(F.col("source").alias("s"), "source_size", "target", rate.cast("long").alias("rate"),
                         F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("")),
                                           F.col("source").isNull()), F.lit(UNIT)).alias("offset"))
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    summed = running_sum(rows, ["size", *keys], "rate", "end", group=["source"])
    end = F.col("end") + F.col("offset")
    copies = F.floor(end / UNIT) - F.floor((end - F.col("rate")) / UNIT)
    return summed.select(*keys, "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each repeated ``copies`` times.

    Rows equal in id and text share their copies out evenly.
    """
    key, n, twins, once = (fresh(c, docs.columns) for c in ("row_key", "copies", "twins", "copy"))
    keyed = docs.withColumn(key, row_key(docs, text_col))
    plan = staged(plan_mix(keyed, [key], text_col, source_col, **options).groupBy(key).agg(
        F.sum("copies").alias(n), F.count(F.lit(1)).alias(twins)), "copies")
    rows = keyed.join(plan.filter(F.col(n) > 0), key)
    if not plan.filter(F.col(twins) > 1).isEmpty():
        before = F.row_number().over(Window.partitionBy(key).orderBy(key)) - 1
        rows = rows.withColumn(once, before).withColumn(
            n, F.floor((F.col(once) + 1) * F.col(n) / F.col(twins)) - F.floor(F.col(once) * F.col(n) / F.col(twins))
        ).drop(once).filter(F.col(n) > 0)
    return rows.withColumn(once, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(key, n, twins, once)
