"""Language identification with language-bitmask n-gram filters.

Every language's frequent n-grams are kept in one Bloom filter whose cells are
bitmasks, one bit per language (a bit-sliced filter): a lookup ANDs the masks at
an n-gram's positions and returns at once all languages that contain it. For a
text, the lookups are counted per language (popcounts), corrected for the
rate at which a language's slice passes n-grams it does not contain, and the
language with the largest corrected share wins.

Fitting uses a bounded sample of the labelled rows (``max_rows`` per language,
chosen by a hash of the id): Spark counts in how many sampled texts of each
language an n-gram occurs, and the ``max_ngrams`` most widespread of each
language are encoded. N-grams that most languages share cancel out in the
comparison. Prediction reads every whole text, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millbook.plans.lineage import staged

ORDERS = (3, 4)
MAX_ROWS = 1_000        # labelled rows per language that the filters are fitted on, about
MAX_NGRAMS = 20_000     # n-grams per language and order
HASHES = 3
BITS_PER_NGRAM = 8
LEAST = 3               # sampled texts of a language an n-gram must occur in; fewer for a language of under 40 rows
UNDETERMINED = "und"
_SLICE = 1 << 18        # characters whose n-grams are held at once
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters one space, spaces at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _is_letter()[points]
    if not alpha.any():
        return np.zeros(0, np.uint32)
    clean = np.where(alpha, points, np.uint32(32))
    keep = alpha | np.concatenate([[True], alpha[:-1]])  # the first of a run of spaces
    clean = clean[keep]
    return np.concatenate([[32] if clean[0] != 32 else [], clean, [32] if clean[-1] != 32 else []]).astype(np.uint32)


def ngrams(points: np.ndarray, order: int) -> np.ndarray:
    """A 63-bit hash of every n-gram of that order."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, np.uint64(order) * _M2, np.uint64)
    for k in range(order):
        out = (out ^ points[k:k + n].astype(np.uint64)) * _M1
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(1)).astype(np.int64)


def _cells(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Double hashing: one cell index per hash function; ``size`` is a power of two."""
    h, last = hashes.astype(np.uint64), np.uint64(size - 1)
    a, b = h * _M2 >> np.uint64(20), (h * _M1 >> np.uint64(20)) | np.uint64(1)
    for k in range(HASHES):
        yield (a + b * np.uint64(k)) & last


@dataclass
class LanguageFilters:
    """The languages, and per order a filter: rows of bytes, one bit per language."""

    languages: list[str]
    cells: dict[int, np.ndarray]

    def __post_init__(self):
        self.false_rate = {order: self._bits(table).mean(axis=0) ** HASHES for order, table in self.cells.items()}

    def _bits(self, masks: np.ndarray) -> np.ndarray:
        return np.unpackbits(masks, axis=1, bitorder="little")[:, :len(self.languages)]

    @classmethod
    def of(cls, languages: list[str], grams: dict[int, list[np.ndarray]]) -> LanguageFilters:
        """``grams[order][l]``: the hashes of language ``l``."""
        width = max(1, -(-len(languages) // 8))
        cells = {}
        for order, lists in grams.items():
            size = 1 << (max(64, BITS_PER_NGRAM * max((len(g) for g in lists), default=0)) - 1).bit_length()
            table = np.zeros((size, width), np.uint8)
            for i, hashes in enumerate(lists):
                for at in _cells(np.asarray(hashes, np.int64), size):
                    table[at, i // 8] |= np.uint8(1 << (i % 8))
            cells[order] = table
        return cls(languages, cells)

    def counts(self, points: np.ndarray, order: int) -> tuple[np.ndarray, int]:
        """How many of the text's n-grams pass each language's slice, and how many there are."""
        table = self.cells[order]
        total, n = np.zeros(8 * table.shape[1], np.int64), 0
        for at in range(0, max(len(points) - order + 1, 0), _SLICE):
            hashes = ngrams(points[at:at + _SLICE + order - 1], order)
            for byte in range(table.shape[1]):
                column, masks = table[:, byte], None
                for cell in _cells(hashes, len(table)):
                    masks = column[cell] if masks is None else masks & column[cell]
                # popcounts per language: how often each mask occurs, times its bits
                total[8 * byte:8 * byte + 8] += np.bincount(masks, minlength=256) @ _BITS
            n += len(hashes)
        return total[:len(self.languages)], n

    def predict(self, text: str | None) -> tuple[str, float]:
        """``(language, score)``: the score is the winner's corrected share of the text's n-grams."""
        points = letters(text or "")
        if not len(points) or not self.languages:
            return UNDETERMINED, 0.0
        shares, orders = np.zeros(len(self.languages)), 0
        for order in self.cells:
            passed, n = self.counts(points, order)
            if n:
                wrong = self.false_rate[order]
                shares += np.clip((passed / n - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)
                orders += 1
        best = int(shares.argmax())  # the first language on a tie
        return self.languages[best], float(shares[best] / max(orders, 1))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, order, gram`` of every distinct n-gram of every text."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            points = letters(text.as_py() or "")
            for order in ORDERS:
                found = np.unique(ngrams(points, order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), order, np.int32)),
                     pa.array(found)], ["lang", "ord", "gram"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_rows: int = MAX_ROWS, max_ngrams: int = MAX_NGRAMS) -> LanguageFilters:
    """Filters learnt from a sample of the rows of ``docs`` with a language.

    The driver receives at most ``max_ngrams`` hashes per language and order.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    total = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(total)
    if not languages:
        return LanguageFilters.of([], {n: [] for n in ORDERS})
    rates = known.sparkSession.createDataFrame(
        [(name, min(1.0, max_rows / n), min(LEAST, n // 20 + 1)) for name, n in total.items()],
        "lang string, rate double, least int")
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(rates), "lang").filter(draw < F.col("rate")).select("lang", "text")
    spread = sample.mapInArrow(_grams, "lang string, ord int, gram long").groupBy("lang", "ord", "gram").count()
    rank = F.row_number().over(Window.partitionBy("lang", "ord").orderBy(F.desc("count"), "gram"))
    top = staged(spread.join(F.broadcast(rates), "lang").filter(F.col("count") >= F.col("least"))
                 .withColumn("rank", rank).filter(F.col("rank") <= max_ngrams), "ngrams").toPandas()
    grams = {n: [top.loc[(top["ord"] == n) & (top["lang"] == lang), "gram"].to_numpy(np.int64) for lang in languages]
             for n in ORDERS}
    return LanguageFilters.of(languages, grams)


def identify(docs: DataFrame, filters: LanguageFilters, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols, lang_pred, score`` of every row; ``und`` with score 0 where the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # sized by languages and max_ngrams, not by the corpus

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(len(id_cols))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(id_cols)], pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())], [*id_cols, "lang_pred", "score"])

    schema = docs.select(*id_cols).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*id_cols, F.col(text_col).cast("string")).mapInArrow(predicted, schema)
