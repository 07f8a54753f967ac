"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 fingerprint bits are grouped into parts so that correlated bits share a
part. If thresholds ``t`` of the parts satisfy ``sum(t + 1) = k + 1``, any two
fingerprints within ``k`` bits agree up to ``t`` bits in some part, so a
fingerprint finds all its neighbours by probing, in each part with ``t >= 0``,
the keys within ``t`` bits of its own. The thresholds are unequal and chosen
per fingerprint by dynamic programming over the parts, on estimated candidate
counts: the exact number of fingerprints sharing a part's key, raised for
wider thresholds by the corpus's bit frequencies. Candidates are verified by
their bit distance inside the probing join, which thus emits links only.

A fingerprint whose parts are all crowded (a large cluster of near copies)
falls back to one part of all 64 bits, where the ball of radius ``k`` has a
fixed number of keys; so no fingerprint costs more than that many probes,
however large its cluster, and nothing is capped.

Copies meet first: the search runs on distinct fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millbook.llm.components import connected_components
from millbook.llm.text import row_key, rows_of
from millbook.plans.lineage import staged

SHINGLE_WORDS, MAX_BITS, PARTS, SEED = 3, 2, 3, 42
ALL = -1  # the mask of the one part that holds every bit
_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, as a signed long; 0 for a text without words."""
    # bytes.lower() and bytes.split() know A-Z and the six ASCII white-space characters only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = [digest(joined[s:e], SEED)
                  for s, e in zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist(), strict=True)]
        rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_cols: list[str], text_col: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``id_cols, fp`` of every row (staged)."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(len(id_cols))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*id_cols, "fp"])

    schema = docs.select(*id_cols).schema.add("fp", "long")
    return staged(docs.select(*id_cols, F.col(text_col).cast("string")).mapInArrow(of_batches, schema), "fingerprints")


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each pair of bits is set together, over all distinct fingerprints, and their number.

    64 x 64 counts per partition are summed in Spark; 4,096 numbers reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            together += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(4097), pa.int32()), pa.array([*together.ravel().tolist(), n], pa.int64())], ["i", "n"])

    total = fps.select("fp").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(4097, np.int64)
    for r in total:
        found[r["i"]] = r["n"]
    return found[:4096].reshape(64, 64), int(found[4096])


def correlated_parts(together: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """64 bits in ``parts`` groups of near-equal width, correlated bits together.

    Each part starts with the most correlated pair still free and grows by the
    bit most correlated with those it has.
    """
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, groups))) // (parts - k)
        own = corr[np.ix_(free, free)]
        i, j = np.unravel_index(int(own.argmax()), own.shape)
        group = [free[i], free[j]] if i != j else free[:2]
        group = group[:width]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].sum(axis=1).argmax())])
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def allocations(widths: list[int], k: int) -> list[tuple[int, ...]]:
    """All thresholds with ``sum(t + 1) = k + 1``, ``-1 <= t <= k``, t below the part's width."""
    return [t for t in itertools.product(range(-1, k + 1), repeat=len(widths))
            if sum(t) + len(t) == k + 1 and all(x <= w for x, w in zip(t, widths, strict=True))]


def _growth(p: np.ndarray, bits: list[int], k: int) -> list[float]:
    """Candidates within 0..k bits of a key over candidates that share it, were the bits independent.

    ``differ / agree`` per bit from its frequency; the elementary symmetric sums count the ways to differ.
    """
    differ = 2 * p[bits] * (1 - p[bits])
    sums = [1.0] + [0.0] * k
    for x in differ / np.maximum(1 - differ, 1e-9):
        for e in range(k, 0, -1):
            sums[e] += x * sums[e - 1]
    return list(np.cumsum(sums))


def _ball(width: int, t: int) -> int:
    total, ways = 1, 1
    for e in range(1, t + 1):
        ways = ways * (width - e + 1) // e
        total += ways
    return total


def with_thresholds(fps: DataFrame, parts: list[list[int]], p: np.ndarray, k: int) -> DataFrame:
    """``fp, plan``: the cheapest allocation per fingerprint; ``plan`` indexes ``allocations``, or -1 for the ball.

    The dynamic program: the best cost of the first parts for every budget of
    ``t + 1`` spent, extended by one part at a time (unrolled into column
    expressions; with its few states it is exact).
    """
    keyed = staged(fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(b))) for b in parts]))
                              .alias("part", "key")), "part-keys")
    crowd = staged(keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")), "part-counts")
    counted = keyed.join(crowd, ["part", "key"]).groupBy("fp").agg(
        *[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(len(parts))])
    plans = allocations([len(b) for b in parts], k)

    def cost(i: int, t: int) -> Column:
        # a probe and a verification cost about the same
        return F.lit(float(_ball(len(parts[i]), t))) + F.col(f"n{i}") * F.lit(_growth(p, parts[i], k)[t])

    # best[u]: the cheapest way of the parts so far to spend a budget of u, with the thresholds chosen
    best: dict[int, Column] = {0: F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("t"))}
    for i, bits in enumerate(parts):
        longer: dict[int, list[Column]] = {}
        for u, so_far in best.items():
            for t in range(-1, min(k - u, len(bits)) + 1):
                step = F.lit(0.0) if t < 0 else cost(i, t)
                longer.setdefault(u + t + 1, []).append(F.struct(
                    (so_far["cost"] + step).alias("cost"), F.concat(so_far["t"], F.array(F.lit(t))).alias("t")))
        counted = counted.select("fp", *[c for c in counted.columns if c.startswith("n")],
                                 *[(F.least(*o) if len(o) > 1 else o[0]).alias(f"b{u}") for u, o in longer.items()])
        best = {u: F.col(f"b{u}") for u in longer}
    found = best[k + 1]
    index = F.array_position(F.array(*[F.array(*[F.lit(x) for x in t]) for t in plans]), found["t"]) - 1
    return counted.select("fp", F.when(found["cost"] > _ball(64, k), F.lit(-1)).otherwise(index).cast("int").alias("plan"))


def _flips(mask_bits: list[int], t: int) -> list[int]:
    """All changes of at most ``t`` of the bits, as masks."""
    return [_mask(list(c)) for e in range(t + 1) for c in itertools.combinations(mask_bits, e)]


def near_pairs(fps: DataFrame, k: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """``a, b`` (may repeat): all pairs of the distinct fingerprints ``fps`` that differ in 1 to ``k`` bits."""
    together, n = bit_statistics(fps)
    p = np.diag(together) / max(n, 1)
    groups = correlated_parts(together, n, parts)
    planned = staged(with_thresholds(fps, groups, p, k), "thresholds")
    plans = allocations([len(b) for b in groups], k)
    used = {r["plan"] for r in planned.select("plan").distinct().collect()}  # at most as many as there are plans
    masks = [_mask(b) for b in groups] + [ALL]
    index = planned.select(F.col("fp").alias("b"), F.col("plan").alias("plan_b"), F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in masks[:len(masks) - (-1 not in used)]])).alias("part", "key"))
    probes = None
    for plan in sorted(used):
        thresholds = plans[plan] if plan >= 0 else (*[-1] * len(groups), k)
        for i, t in enumerate(thresholds):
            if t < 0:
                continue
            bits = groups[i] if i < len(groups) else list(range(64))
            own = planned.filter(F.col("plan") == plan).select("fp", "plan", F.lit(i).alias("part"))
            key = F.col("fp").bitwiseAND(F.lit(masks[i]))
            own = (own.withColumn("key", key) if t == 0 else own.withColumn(
                "flip", F.explode(F.array(*[F.lit(x) for x in _flips(bits, t)]))).select(
                    "fp", "plan", "part", key.bitwiseXOR(F.col("flip")).alias("key")))
            probes = own if probes is None else probes.unionByName(own)
    if probes is None:
        return planned.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    probes = probes.select(F.col("fp").alias("a"), F.col("plan").alias("plan_a"), "part", "key")
    # fingerprints with the same plan find each other, so one direction is enough; with different plans either may
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, k)
             & ((F.col("a") < F.col("b")) | (F.col("plan_a") != F.col("plan_b"))))
    return probes.join(index, ["part", "key"]).filter(close).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    k: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """``id_col, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``k``
    differing bits. A null text is an empty one (fingerprint 0). A null id
    keeps its row, with the component its fingerprint has. Repeated rows share
    a fingerprint; empty input gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = fingerprints(source, ["id"], "text", shingle)
    groups = fingerprint_groups(marked, k, parts)
    lowest = (marked.groupBy("fp").agg(F.min("id").alias("low")).join(groups, "fp")
              .groupBy("component").agg(F.min("low").alias("component_id")))
    by_fp = staged(groups.join(staged(lowest, "lowest"), "component").select("fp", "component_id"), "by-fp")
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_groups(marked: DataFrame, k: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """``fp, component`` of every distinct fingerprint of ``marked`` (staged)."""
    distinct = staged(marked.select("fp").distinct(), "distinct-fingerprints")
    links = staged(near_pairs(distinct, k, parts), "links")
    linked = connected_components(links, "a", "b").select(F.col("node").alias("fp"), "component")
    return staged(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")),
                  "fingerprint-groups")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE_WORDS, k: int = MAX_BITS,
                         parts: int = PARTS) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest ``doc_id``.

    A null id (or none in ``docs``) comes last; among rows with that id the
    row key decides, and rows equal in id and text count as one row.
    """
    doc = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    source = docs.select(doc.alias("doc"), row_key(docs, text_col).alias("key"), F.col(text_col).alias("text"))
    marked = fingerprints(source, ["doc", "key"], "text", shingle)
    first = F.struct(F.col("doc").isNull().alias("last"), "doc", "key")
    keep = (marked.join(fingerprint_groups(marked, k, parts), "fp").groupBy("component")
            .agg(F.min(first).alias("first")).select("first.key"))
    repeated = not marked.groupBy("key").count().filter("count > 1").isEmpty()
    return rows_of(docs, keep, text_col, once=repeated)
