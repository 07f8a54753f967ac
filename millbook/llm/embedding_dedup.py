"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them.

Vectors of equal label are compared by cosine. Equal vectors meet first and
count with their multiplicity. Spherical k-means (fitted on a bounded sample,
on the driver) assigns every distinct vector to its nearest centroid's cell. A
vector also visits every other cell whose border is at most half the angle of
``least`` away. Two linked vectors on both sides of a border cannot both be
farther from it than that, so one of them visits the other's cell and no link
is lost, whatever the centroids. Visitors meet residents only, and a pair that
two cells see is counted in one of them, so counts are exact.

A cell's residents and its visitors are dealt over blocks of about ``block``
rows by hash; every pair of resident blocks and every resident block with every
visitor block is one matrix product, so even vectors that all visit all cells
cost no more than twice the comparison of all with all. A product returns per
vector how many it links with, and a spanning forest of the links; pairs are
never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millbook.llm.components import connected_components
from millbook.llm.text import with_row_ids
from millbook.plans.lineage import staged

LEAST = 0.93
SAMPLE = 20_000       # vectors the centroids are fitted on, about
PER_CELL = 1_000      # wanted vectors of one label in a cell
MAX_CELLS = 2_048     # centroids; more rows then make cells larger, still compared in whole
BLOCK = 1_024
_ROUNDING = 1e-6      # far above the rounding of a product of unit vectors and of a centroids' distance


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``x``: nearest by cosine, then the normalised mean."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a:a + 4096] @ centroids.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def fit_centroids(vectors: DataFrame, per_cell: int, sample: int) -> dict[int, np.ndarray]:
    """Dimension -> centroids, fitted on about ``sample`` of the distinct vectors (chosen by a hash).

    As many cells as the largest label needs for ``per_cell`` vectors in each.
    """
    sizes = vectors.groupBy("label", "dim").count().groupBy("dim").agg(
        F.max("count").alias("most"), F.sum("count").alias("n")).collect()  # one row per dimension
    total = sum(r["n"] for r in sizes)
    drawn = vectors.filter(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(1 << 30))
                           < int(min(1.0, sample / max(total, 1)) * (1 << 30)))
    rows = drawn.select("dim", "vid", "vector").toPandas().sort_values("vid")
    found = {}
    for r in sizes:
        own = rows.loc[rows["dim"] == r["dim"], "vector"]
        k = min(MAX_CELLS, max(1, math.ceil(r["most"] / per_cell)), len(own))
        if k > 1:
            found[r["dim"]] = spherical_kmeans(_unit(list(own)), k)
    return found


def with_cells(vectors: DataFrame, centroids: dict[int, np.ndarray], least: float) -> DataFrame:
    """``vid, home, visits``: the nearest cell, and all others whose border is within half the angle of ``least``.

    The sine of the angle between ``x`` and the border of cells ``a`` and ``b`` is ``x.(a - b) / |a - b|``.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CELLS vectors per dimension
    reach = math.sin(math.acos(min(1.0, max(-1.0, least))) / 2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {dim: np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) for dim, c in shared.value.items()}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            home, visits = np.zeros(len(dims), np.int32), [[]] * len(dims)
            for dim in np.unique(dims).tolist():
                if dim not in shared.value:
                    continue
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 2048)):
                    cosine = _unit([batch.column(2)[i].as_py() for i in part.tolist()]) @ shared.value[dim].T
                    own = home[part] = cosine.argmax(axis=1)
                    near = cosine.max(axis=1, keepdims=True) - cosine <= reach * apart[dim][own] + _ROUNDING
                    near[np.arange(len(part)), own] = False
                    for i, row in zip(part.tolist(), near, strict=True):
                        visits[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(home), pa.array(visits, pa.list_(pa.int32()))], ["vid", "home", "visits"])

    return vectors.select("vid", "dim", "vector").mapInArrow(assign, "vid long, home int, visits array<int>")


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row of a symmetric boolean matrix."""
    low = np.arange(len(linked))
    while True:
        best = np.minimum(low, np.where(linked, low[None, :], len(linked)).min(axis=1, initial=len(linked)))
        best = best[best]
        if (best == low).all():
            return low
        low = best


def _visitors_links(cell: int, x: np.ndarray, rows: pd.DataFrame, resident: np.ndarray, least: float) -> np.ndarray:
    """Which residents link with which visitors, without the pairs that the visitor's own, lower cell counts."""
    linked = x[resident] @ x[~resident].T >= least
    homes, place = np.unique(rows["home"].to_numpy()[~resident], return_inverse=True)
    visits = list(rows["visits"][resident])
    row, to = np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate([np.zeros(0, np.int64), *visits])
    at = np.searchsorted(homes, to).clip(max=len(homes) - 1)
    lower = (homes[at] == to) & (to < cell)
    there = np.zeros((len(visits), len(homes)), bool)
    there[row[lower], at[lower]] = True
    return linked & ~there[:, place]


def compare_blocks(cell: int, rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """One product of two blocks (or of one with itself): ``vid, other, n``.

    Residents meet residents, or a block of them meets one of visitors. ``n`` with a null ``other``: linked rows
    of ``vid`` in this product; ``other``: a row of the same component.
    """
    x = _unit(list(rows["vector"]))
    vid, times, block = rows["vid"].to_numpy(), rows["times"].to_numpy(np.int64), rows["own"].to_numpy()
    resident = rows["home"].to_numpy() == cell
    if resident.all():
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        if (block != block[0]).any():
            linked &= block[:, None] != block[None, :]
    else:
        linked = np.zeros((len(x), len(x)), bool)
        if resident.any():
            linked[np.ix_(resident, ~resident)] = _visitors_links(cell, x, rows, resident, least)
            linked |= linked.T
    some = np.flatnonzero(linked.any(axis=1))
    n = linked[some] @ times
    root = some[_forest(linked[np.ix_(some, some)])]
    tied = np.flatnonzero(root != some)
    return pd.DataFrame({
        "vid": np.concatenate([vid[some], vid[some[tied]]]),
        "other": pd.array([None] * len(some) + vid[root[tied]].tolist(), dtype="Int64"),
        "n": np.concatenate([n, np.zeros(len(tied), np.int64)])})


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 least: float = LEAST, per_cell: int = PER_CELL, block: int = BLOCK,
                 sample: int = SAMPLE) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``rows``.

    Rows without a label or a usable vector link with nothing and stay, as do
    vectors of another length. ``component_id`` is the smallest id reachable;
    ``kept`` where it is the row's own. Repeated rows link with each other.
    Empty input gives no rows; other columns are not read.
    """
    vector = F.col(vector_col).cast("array<double>")
    source, rid = with_row_ids(rows.select(F.col(id_col).alias("id"), vector.alias("vector"),
                                           F.col(label_col).alias("label")))
    seed = 0
    while True:  # rows find their distinct vector by a 128-bit key, checked to be injective
        key = [F.xxhash64(F.lit(2 * seed + i), "vector").alias(f"k{i}") for i in (0, 1)]
        good = source.filter(F.col("label").isNotNull() & usable(F.col("vector")))
        distinct = staged(good.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("times"))
                          .select("*", *key, F.size("vector").alias("dim"),
                                  F.monotonically_increasing_id().alias("vid")), "vectors")
        if distinct.groupBy("label", "k0", "k1").count().filter("count > 1").isEmpty():
            break
        seed += 1
    centroids = fit_centroids(distinct, per_cell, sample)
    placed = staged(distinct.select("vid", "label", "dim", "times", "vector").join(
        with_cells(distinct, centroids, least), "vid"), "cells")
    members = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits")))
    resident = F.col("cell") == F.col("home")

    def blocks_of(some: Column) -> Column:
        return F.ceil(F.count_if(some) / block).cast("int")

    blocks = staged(members.groupBy("label", "dim", "cell").agg(
        blocks_of(resident).alias("homes"), blocks_of(~resident).alias("guests")).filter("homes > 0"), "blocks")
    hashed = F.xxhash64("vid")
    dealt = (members.join(blocks, ["label", "dim", "cell"])  # blocks of residents are numbered before those of visitors
             .withColumn("own", F.when(resident, F.pmod(hashed, F.col("homes")))
                         .otherwise(F.col("homes") + F.pmod(hashed, F.col("guests"))).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("homes") - 1 + F.when(resident, F.col("guests"))
                                                      .otherwise(0))))
             .withColumn("first", F.least("own", "with")).withColumn("second", F.greatest("own", "with")))

    def product(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return compare_blocks(int(key[2]), group, least)

    found = staged(dealt.select("label", "dim", "cell", "first", "second", "own", "vid", "times", "home", "visits", "vector")
                   .groupBy("label", "dim", "cell", "first", "second")
                   .applyInPandas(product, "vid long, other long, n long"), "products")
    counts = found.groupBy("vid").agg(F.sum("n").alias("n"))
    ties = connected_components(found.filter("other is not null"), "vid", "other")
    joined = (distinct.select("vid", "label", "k0", "k1", "low", "times").join(counts, "vid", "left")
              .join(ties.withColumnRenamed("node", "vid"), "vid", "left")
              .withColumn("component", F.coalesce("component", "vid")))
    lowest = staged(joined.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    by_vector = staged(joined.join(lowest, "component").select(
        "label", "k0", "k1", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("links"), "component_id"), "by-vector")
    good = good.select("id", rid, "label", *key)
    told = good.join(by_vector, ["label", "k0", "k1"]).select("id", F.col("links").alias("n_links"), "component_id")
    alone = source.filter(~(F.col("label").isNotNull() & usable(F.col("vector")))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return told.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                          (F.col("id") == F.col("component_id")).alias("kept"))
