"""Vector code compression: product codes from an integer Lloyd that rescans only what moved.

A vector's components become integers, ``floor(scale * x)``, and the vector is
cut into ``parts`` equal parts. Every part position has its own codebook, which
starts as that part of the first vectors by id. A round assigns every part to
its nearest entry (squared distance, ties to the lower index) and moves each
entry to the floor of its parts' mean.

*Active entries.* Every part carries its assigned entry and the exact distance to
it. After a round an entry is active if it moved. A part whose entry stayed
where it was compares the active entries only with what it stored: no other
entry can have come nearer, and ties are settled by index as a whole scan would.
A part whose own entry moved is scanned against all entries. So every assignment
equals that of a whole scan, with as many distances as there was movement.

Assignments are staged per round, next to the integers; sums and counts per
(part, entry) are added up inside every task and merged by Spark, so a round
moves some numbers per task, and the driver holds the codebooks only. All
arithmetic is on integers, so results do not depend on how rows are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.plans.lineage import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 28   # of a component's integer: squares of differences, over a part, stay within 64 bits
_EXACT = 1 << 22    # below it distances are exact in doubles too, and one matrix product gives them
_ROWS = 1024        # vectors worked on at a time


def usable(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to every row of ``book``, exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) * x.shape[1] < _EXACT:
        f, g = x.astype(np.float64), book.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    return ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row, the lower of equals, and its distance."""
    d = distances(x, book)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray,
             distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row, from its last ``entry`` and the exact ``distance`` to where that was.

    ``moved``: which entries are elsewhere now.
    """
    entry, distance = entry.copy(), distance.copy()
    rescan = moved[entry]
    if rescan.any():
        entry[rescan], distance[rescan] = nearest(x[rescan], book)
    active, still = np.flatnonzero(moved), np.flatnonzero(~rescan)
    if len(active) and len(still):
        place, d = nearest(x[still], book[active])
        other = active[place]
        better = (d < distance[still]) | ((d == distance[still]) & (other < entry[still]))
        entry[still[better]], distance[still[better]] = other[better], d[better]
    return entry, distance


@dataclass
class Codebooks:
    entries: np.ndarray  # (parts, entries, components of a part) integers

    def sha256(self) -> str:
        """Digest of all components, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


@dataclass
class Codes:
    vectors: DataFrame   # id, label, code, error
    codebooks: Codebooks


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """``rows`` with ``entry`` and ``distance`` per part as they are with ``books``; the first time all are scanned."""
    parts, _, size = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, moved))  # parts x entries x components: fixed by the parameters
    again = "entry" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                x = _matrix(batch.column(2), parts * size)
                old = [_matrix(batch.column(i), parts) for i in (3, 4)] if again else None
                entry, distance = (np.zeros((len(x), parts), t) for t in (np.int64, np.int64))
                for p in range(parts):
                    own = x[:, p * size:(p + 1) * size]
                    entry[:, p], distance[:, p] = (
                        reassign(own, books[p], moved[p], old[0][:, p].astype(np.int64), old[1][:, p])
                        if again else nearest(own, books[p]))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(entry.ravel().astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(distance.ravel()))],
                    ["id", "label", "x", "entry", "distance"])

    kinds = rows.select("id", "label").schema
    schema = kinds.add("x", T.ArrayType(T.LongType())).add("entry", T.ArrayType(T.IntegerType())).add(
        "distance", T.ArrayType(T.LongType()))
    return rows.select("id", "label", "x", *["entry", "distance"] * again).mapInArrow(assign, schema)


def _sums(assigned: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts of every entry and their number: one row per (task, part, entry) is merged."""
    parts, entries, size = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, entry = _matrix(batch.column(0), parts * size), _matrix(batch.column(1), parts)
            for p in range(parts):
                np.add.at(total[p], entry[:, p], x[:, p * size:(p + 1) * size])
                count[p] += np.bincount(entry[:, p], minlength=entries)
        part, at = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array(count[part, at]),
             pa.array(total[part, at].tolist(), pa.list_(pa.int64()))], ["part", "at", "n", "total"])

    partial = assigned.select("x", "entry").mapInArrow(add, "part int, at int, n long, total array<bigint>")
    merged = partial.groupBy("part", "at").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)]).collect()
    total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
    for r in merged:  # at most parts x entries rows
        count[r["part"], r["at"]] = r["n"]
        total[r["part"], r["at"]] = [r[f"t{i}"] for i in range(size)]
    return total, count


def encode(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """``id_col, label_col, code, error`` of every usable row, and the codebooks after ``rounds`` rounds.

    ``code`` has two hex digits a part (``entries`` is at most 256), ``error`` is
    the sum of the parts' squared distances. Rows whose vector is null or holds
    null or non-finite components are dropped. The first ``entries`` rows by id
    (nulls last, equal ids by their integers) start the codebooks; with fewer
    rows there are fewer entries, and with none the result is empty. The vectors'
    length is that of the first row whose length ``parts`` divides; rows of
    another length stay, with a null code and error. Repeated rows
    count one by one; other columns are not read. Integers beyond ``LARGEST`` raise.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vector = F.col(vector_col).cast("array<double>")
    ints = F.transform(vector, lambda x: F.floor(x * float(scale)).cast("long"))
    bound = F.exists("x", lambda v: (v > LARGEST) | (v < -LARGEST))
    kept = staged(rows.filter(usable(vector)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                                                     ints.alias("x")), "integers")
    if not kept.filter(bound).isEmpty():
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    by_id = (F.col("id").asc_nulls_last(), F.col("x"))
    first = kept.filter((F.size("x") > 0) & (F.size("x") % parts == 0)).orderBy(*by_id).select(F.size("x")).first()
    uncoded = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if first is None:
        return Codes(_named(uncoded, id_col, label_col), Codebooks(np.zeros((parts, 0, 0), np.int64)))
    width = first[0]
    fits = kept.filter(F.size("x") == width)
    start = fits.orderBy(*by_id).limit(entries).select("x").collect()
    books = np.array([r["x"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    state, moved = fits, np.ones(books.shape[:2], bool)
    for _ in range(rounds):
        state = staged(_assigned(state, books, moved), "assigned")
        total, count = _sums(state, books.shape)
        new = np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], books)
        moved = (new != books).any(axis=2)
        books = new
    final = staged(_assigned(state, books, moved), "assigned")
    code = F.concat_ws("", F.transform("entry", lambda e: F.lpad(F.lower(F.hex(e.cast("long"))), 2, "0")))
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda a, d: a + d)
    coded = final.select("id", "label", code.alias("code"), error.alias("error")).unionByName(
        uncoded.filter(F.size("x") != width))
    return Codes(_named(coded, id_col, label_col), Codebooks(books))


def _named(coded: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")


def label_errors(codes: Codes, label_col: str = "label") -> DataFrame:
    """``codes.vectors`` with ``label_error``: the error summed over rows of equal label, nulls together."""
    sums = staged(codes.vectors.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.vectors.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")


def decode(codes: DataFrame, codebooks: Codebooks, code_col: str = "code",
           scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``: the entries its code names, as numbers again (the middle of each integer's range).

    A null code gives a null vector.
    """
    size = codebooks.entries.shape[2]
    books = ((codebooks.entries + 0.5) / scale).reshape(len(codebooks.entries), -1).tolist()
    flat = F.array(*[F.array(*map(F.lit, b)) for b in books])  # parts x entries x components: fixed by the parameters
    entry = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.struct(
        p.alias("p"), F.conv(F.substring(F.col(code_col), 2 * p + 1, F.lit(2)), 16, 10).cast("int").alias("e")))
    return codes.withColumn("vector", F.flatten(F.transform(entry, lambda x: F.slice(
        F.element_at(flat, x["p"] + 1), x["e"] * size + 1, size))))
