"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the openings of its longer words (so inflected
forms share a term). A term counts once as such and once with how dense it is
in the text (the power of two of words per occurrence); both are slots, hashed
to 45 bits. The machine scores ``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over
the slots of a text: the factors learn which terms are toxic only together (an
insult with a group mention), which additive weights cannot.

It is fitted on a bounded sample of the labelled rows (``max_rows`` per class,
chosen by a hash of the id). Spark counts the sample's slots; those that tell
the classes apart or are frequent reach the driver, where the machine is fitted. Scoring reads
every whole text, in tasks, in chunks of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millbook.plans.lineage import staged

FACTORS = 4
MAX_ROWS = 4_000      # labelled rows per class at most that the machine is fitted on
OPENINGS = (5, 7)     # letters of a word's opening that are terms of their own
LEAST, BEYOND = 5, 4.0
FREQUENT = 0.2        # of the sampled documents: slots that many have take part whatever they tell alone
_DENSITIES = 32
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts written without spaces between words: Thai to Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_CHUNK_CHARS = 1 << 21
_CACHE_WORDS = 1 << 18


def _terms(words: list[str]) -> np.ndarray:
    """40-bit hashes of each word's terms, one row per word, -1 where it has no such term."""
    out = np.full((len(words), 1 + len(OPENINGS)), -1, np.int64)
    digest = xxhash.xxh64_intdigest
    out[:, 0] = np.fromiter((digest(w.encode()) >> 24 for w in words), np.int64, len(words))
    for j, size in enumerate(OPENINGS, 1):
        out[:, j] = np.fromiter((digest(w[:size].encode(), size) >> 24 if len(w) > size else -1 for w in words),
                                np.int64, len(words))
    return out


def _density(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """1 for every word, 2 for every second one, and so on by powers of two."""
    return np.minimum(np.log2(np.maximum(words / times, 1)).astype(np.int64) + 1, _DENSITIES - 1)


def words_of(text: str) -> list[str]:
    """The words of a text; of a run in a script without spaces, its pairs and triples of letters."""
    words = _WORD.findall(text.lower())
    if _UNSPACED.search(text):
        runs, words = words, []
        for run in runs:
            if len(run) > 1 and _UNSPACED.search(run):
                words += [run[i:i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
            else:
                words.append(run)
    return words


def slots_of(text: str) -> np.ndarray:
    """The distinct slots of a text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    counts = Counter(words)
    terms = _terms(list(counts))
    times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), terms.shape[1])
    flat = terms.ravel()
    distinct, place = np.unique(flat[flat >= 0], return_inverse=True)
    total = np.bincount(place, times[flat >= 0]).astype(np.int64)
    return np.concatenate([distinct * _DENSITIES, distinct * _DENSITIES + _density(len(words), total)])


@dataclass
class FactorizationMachine:
    """A bias, and a weight and a vector for each of the sorted ``slots``; all others are zero."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    _cache: dict = field(default_factory=dict)

    def __post_init__(self):
        self._rows = np.unique(self.slots // _DENSITIES)
        self._at = np.full((len(self._rows), _DENSITIES), -1, np.int64)
        self._at[np.searchsorted(self._rows, self.slots // _DENSITIES), self.slots % _DENSITIES] = np.arange(
            len(self.slots))

    def __getstate__(self):
        return self.bias, self.slots, self.weights, self.factors

    def __setstate__(self, state):
        self.__init__(*state)

    def _known(self, words: set[str]) -> None:
        """Cache which of the machine's terms each word has (none for most)."""
        new = [w for w in words if w not in self._cache]
        if len(self._cache) + len(new) > _CACHE_WORDS:
            self._cache.clear()
            new = list(words)
        if not new or not len(self._rows):
            self._cache.update(dict.fromkeys(new))
            return
        terms = _terms(new)
        place = np.searchsorted(self._rows, terms).clip(max=len(self._rows) - 1)
        hit = self._rows[place] == terms
        self._cache.update(dict.fromkeys(new))
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            self._cache[new[i]] = place[i][hit[i]].tolist()

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        found = [words_of(t) for t in texts]
        self._known(set().union(*found))
        terms_of = self._cache.get
        for d, words in enumerate(found):
            hits = [r for w in words if (own := terms_of(w)) for r in own]
            if not hits:
                continue
            rows, times = np.unique(np.array(hits), return_counts=True)
            at = np.concatenate([self._at[rows, 0], self._at[rows, _density(len(words), times)]])
            at = at[at >= 0]
            v = self.factors[at]
            out[d] += self.weights[at].sum() + ((v.sum(axis=0) ** 2).sum() - (v * v).sum()) / 2
        return out


def fit(doc: np.ndarray, slot: np.ndarray, label: np.ndarray, seed: int = 7, epochs: int = 12, batch: int = 128,
        rate: float = 0.02, decay: float = 2e-4) -> FactorizationMachine:
    """Adam on the logistic loss; ``doc``, ``slot`` are the slots of documents ``0 .. len(label) - 1``."""
    rng = np.random.default_rng(seed)
    n = len(label)
    used, col = np.unique(slot, return_inverse=True)
    order = np.lexsort((col, doc))
    doc, col = doc[order], col[order]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    size = len(used)
    prior = (label.sum() + 1) / (n + 2)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(size), rng.normal(0, 0.01, (FACTORS, size))]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        shuffled = rng.permutation(n)
        for at in range(0, n, batch):
            rows = shuffled[at:at + batch]
            count = bounds[rows + 1] - bounds[rows]
            d = np.repeat(np.arange(len(rows)), count)
            c = col[np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(d))]
            out = np.full(len(rows), params[0][0]) + np.bincount(d, params[1][c], len(rows))
            sums = []
            for f in range(FACTORS):
                v = params[2][f][c]
                sums.append(np.bincount(d, v, len(rows)))
                out += (sums[f] ** 2 - np.bincount(d, v * v, len(rows))) / 2
            wrong = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[rows]) / len(rows)
            g = wrong[d]
            grads = [np.array([wrong.sum()]), np.bincount(c, g, size) + decay * params[1],
                     np.stack([np.bincount(c, g * (sums[f][d] - params[2][f][c]), size) for f in range(FACTORS)])
                     + decay * params[2]]
            t += 1
            step = rate * (1 - epoch / epochs)
            for p, m, s, x in zip(params, first, second, grads, strict=True):
                m += 0.1 * (x - m)
                s += 0.01 * (x * x - s)
                p -= step * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    return FactorizationMachine(float(params[0][0]), used, params[1], params[2].T.copy())


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded total length (a longer text is a run of its own)."""
    at, size, run = 0, 0, []
    for i, text in enumerate(texts):
        if run and size + len(text) > _CHUNK_CHARS:
            yield at, run
            at, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield at, run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, texts = (c.to_pylist() for c in batch.columns)
        for at, run in _chunks([t or "" for t in texts]):
            slots = [slots_of(t) for t in run]
            count = [len(s) for s in slots]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids[at:at + len(run)], np.int64), count)),
                 pa.array(np.repeat(np.array(labels[at:at + len(run)], np.int32), count)),
                 pa.array(np.concatenate(slots))], ["id", "label", "slot"])


def training_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``id, label`` of about ``max_rows`` labelled rows per class at most, chosen by a hash of the id.

    Rows with a null id or label teach nothing. A document labelled twice counts as toxic if either label says so.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = staged(known.groupBy("id").agg(F.max("label").alias("label")), "labels")
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # the classes
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("label") == 1, min(1.0, max_rows / total.get(1, 1))).otherwise(
        min(1.0, max_rows / total.get(0, 1)))
    return known.filter("label in (0, 1)").filter(draw < rate)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 7) -> FactorizationMachine:
    """The machine fitted on a sample of ``labels`` (see ``training_sample``).

    A slot takes part if at least ``LEAST`` sampled documents have it and its
    toxic share lies ``BEYOND`` standard deviations off the sample's, or if at least
    the share ``FREQUENT`` of the documents has it. Terms that matter only together
    show alone unless each is so frequent that its cases balance (toxic with both or
    neither of two terms is neutral in each only where each is in half the texts),
    so the factors miss none by this, and the many rare neutral slots of a long
    text add no noise. The sample is small by ``max_rows``, so it may be broadcast.
    Labels of one class leave frequent slots alone; without labels the machine
    scores every text one half. Repeated rows of ``docs`` teach once each.
    """
    sample = staged(training_sample(labels, id_col, label_col, max_rows), "sample")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), "id").select("id", "label", "text")
    pairs = staged(texts.mapInArrow(_pairs, "id long, label int, slot long"), "terms")
    rows = pairs.select("id", "label").distinct().toPandas().sort_values("id")
    share = float(rows["label"].mean()) if len(rows) else 0.0
    spread = share * (1 - share)
    tells = (F.col("n") >= LEAST) & F.lit(spread > 0) & (
        F.abs(F.col("k") - F.col("n") * share) >= BEYOND * F.sqrt(F.col("n") * spread))
    tells = pairs.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).filter(
        tells | (F.col("n") >= max(LEAST, FREQUENT * len(rows))))
    kept = pairs.join(tells, "slot").select("id", "slot").distinct().toPandas()
    doc = np.searchsorted(rows["id"].to_numpy(), kept["id"].to_numpy())
    return fit(doc, kept["slot"].to_numpy(np.int64), rows["label"].to_numpy(np.float64), seed)


def _logits(machine: FactorizationMachine, column: pa.Array) -> np.ndarray:
    texts = [t.as_py() or "" for t in column]
    return np.concatenate([np.zeros(0), *(machine.logits(run) for _, run in _chunks(texts))])


def score(docs: DataFrame, model: FactorizationMachine, id_cols: list[str], text_col: str = "text",
          name: str = "score") -> DataFrame:
    """``id_cols`` and ``name`` (0 to 1) of every row, repeated ones too; none of an empty table.

    A null text is an empty one and scores the bias alone. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample's slots that tell, not the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _logits(shared.value, batch.column(len(id_cols)))
            probability = pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(id_cols)], probability], [*id_cols, name])

    schema = docs.select(*id_cols).schema.add(name, "double")
    return docs.select(*id_cols, F.col(text_col).cast("string")).mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all their columns; one pass, no shuffle.

    Repeated rows all stay or all go; an empty table stays empty.
    """
    place, limit = docs.columns.index(text_col), float(np.log(least / (1 - least)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_logits(shared.value, batch.column(place)) < limit))

    return docs.mapInArrow(clean, docs.schema)
