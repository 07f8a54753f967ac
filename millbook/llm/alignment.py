"""Cross-tokenizer alignment: two tokenizers' tokens of a text linked where their byte ranges end together.

Every task works through its texts in chunks of bounded length, with Arrow's own
kernels: the chunk's token ids are two list arrays (one list a text), flattened
with their parent indices; a cumulative sum of token lengths, less what the
lists before hold, gives every token's end; an Acero hash join on (document,
end) gives the links, and ``Table.group_by`` counts each document's and each
chunk's linked id pairs. Spark merges the chunks' counts, and gives every chunk
the corpus-wide counts of its own pairs back, which a second Arrow step sums
per document. What moves is one row per (chunk, distinct pair) and each
document's distinct pairs; nothing is collected or broadcast.

A text whose tokens do not spell space+text byte by byte, on either side, is not
aligned: it has no tokens. So has a null or an empty one. Repeated rows are
counted one by one, a null id keeps its row, an empty table gives no rows, and
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millbook.llm.packing import Tokens
from millbook.plans.lineage import staged

#: Characters of the texts that are aligned together (one text at least): about 800,000 tokens a side.
CHUNK_CHARS = 1 << 21


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow 255 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Side:
    """A tokenizer's ids, and what bytes each id spells."""

    def __init__(self, spelled: list[bytes]):
        self.bytes = pa.array(spelled, pa.large_binary())
        self.sizes = pc.binary_length(self.bytes).cast(pa.int64())


class ByteLevel(_Side):
    """A byte-level BPE file of ``tokenizers``; special tokens' strings in a text are plain text."""

    def __init__(self, path: str):
        self.tokens = Tokens(path)
        tokenizer = self.tokens.tokenizer
        tokenizer.encode_special_tokens = True
        added = tokenizer.get_added_tokens_decoder()
        self.tokens.added = [t.content for t in added.values() if not t.special]
        with_spaces = json.loads(tokenizer.to_str())["pre_tokenizer"]
        if with_spaces.get("type") != "ByteLevel" or with_spaces.get("add_prefix_space"):
            raise ValueError(f"{path} is not a byte-level vocabulary without an added space")
        alphabet, spelled = byte_level_alphabet(), [b""] * (max(tokenizer.get_vocab().values()) + 1)
        for token, i in tokenizer.get_vocab().items():
            spelled[i] = (token.encode() if i in added else bytes(alphabet[c] for c in token))
        super().__init__(spelled)

    def encode(self, texts: list[str]) -> pa.ListArray:
        ids = list(self.tokens.ids([" " + t for t in texts]))
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


class Pieces(_Side):
    """A ``sentencepiece`` model, which puts a space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        super().__init__([self._bytes(i) for i in range(self.model.vocab_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.model.encode(texts, num_threads=1), pa.list_(pa.int32()))


@cache
def _side(path: str) -> _Side:
    """One per Python worker: a byte-level vocabulary (``.json``) or a piece model."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def spells(side: _Side, lists: pa.ListArray, texts: list[bytes]) -> np.ndarray:
    """Which lists' tokens are, joined, the text."""
    ends = pc.cumulative_sum(side.sizes.take(lists.flatten())).to_numpy()
    at = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
    joined = memoryview(side.bytes.take(lists.flatten()).buffers()[2] or b"").cast("B")
    return np.fromiter((joined[a:b] == t for a, b, t in zip(at, at[1:], texts, strict=False)), bool, len(texts))


def token_ends(side: _Side, lists: pa.ListArray) -> pa.Table:
    """``doc`` (the list's number), ``end`` (of the token's byte range in its text) and ``at`` (place in the chunk)."""
    ids, parent = lists.flatten(), pc.list_parent_indices(lists).cast(pa.int32())
    running = pc.cumulative_sum(side.sizes.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(lists.offsets[:-1])
    return pa.table({"doc": parent, "end": pc.subtract(running, before.take(parent)),
                     "at": pa.array(np.arange(len(ids), dtype=np.int32))})


def _cuts(ends: pa.Table, linked: np.ndarray) -> np.ndarray:
    """Places after which a group ends: the last of the tokens that share a linked end."""
    marked = np.zeros(len(ends), bool)
    marked[linked] = True
    doc, end = ends["doc"].to_numpy(), ends["end"].to_numpy()
    marked[:-1] &= (doc[1:] != doc[:-1]) | (end[1:] != end[:-1])
    return np.flatnonzero(marked)


def _joined(values: pa.Array, cuts: np.ndarray, by: str) -> pa.Array:
    """The runs of ``values`` up to each cut, as text."""
    offsets = pa.array(np.concatenate([[0], cuts + 1]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), pa.scalar(by, pa.large_string()))


def _per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` documents' rows begin in the sorted ``doc``, and the end."""
    return np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)


@dataclass
class Aligned:
    documents: pa.Table  # n_a, n_b, n_groups, n_links, groups, and pair, n: the distinct pairs linked and how often
    pairs: pa.Table      # a, b, links: what ``pair`` numbers


def align_texts(texts: list[str], a: _Side, b: _Side) -> Aligned:
    """One chunk's texts aligned; texts that cannot be have zeros and no groups."""
    some = np.array([i for i, t in enumerate(texts) if t], np.int64)
    own = [texts[i] for i in some]
    spelled = [b" " + t.encode() for t in own]
    lists = [side.encode(own) for side in (a, b)]
    good = spells(a, lists[0], spelled) & spells(b, lists[1], spelled)
    some, n = some[good], int(good.sum())
    lists = [x.filter(pa.array(good)) for x in lists]
    ends = [token_ends(side, x) for side, x in zip((a, b), lists, strict=True)]
    links = ends[0].rename_columns(["doc", "end", "at_a"]).join(
        ends[1].rename_columns(["doc", "end", "at_b"]), ["doc", "end"], join_type="inner", use_threads=False).combine_chunks()
    ids = [x.flatten() for x in lists]
    at = [links[c].to_numpy() for c in ("at_a", "at_b")]
    cuts = [_cuts(e, p) for e, p in zip(ends, at, strict=True)]
    sides = [_joined(_decimals(int(pc.max(x).as_py() or 0)).take(x), c, ",") for x, c in zip(ids, cuts, strict=True)]
    group_doc = ends[0]["doc"].to_numpy()[cuts[0]]
    group_at = _per_doc(group_doc, n)
    bar, semicolon = pa.scalar("|", pa.large_string()), pa.scalar(";", pa.large_string())
    groups = pc.binary_join(pa.ListArray.from_arrays(
        pa.array(group_at), pc.binary_join_element_wise(*sides, bar)), semicolon)
    # a document's distinct pairs, then the chunk's, numbered
    by_doc = pa.table({"doc": links["doc"], "a": ids[0].take(pa.array(at[0])), "b": ids[1].take(pa.array(at[1]))}).group_by(
        ["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
    pairs = by_doc.group_by(["a", "b"], use_threads=False).aggregate([("count_all", "sum")]).rename_columns(["a", "b", "links"])
    number = pc.index_in(_both(by_doc), _both(pairs))
    doc_at = _per_doc(by_doc["doc"].to_numpy(), n)

    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        out[some] = values
        return pa.array(out)

    def lists_of(values: pa.Array) -> pa.Array:
        offsets = np.zeros(len(texts) + 1, np.int32)
        offsets[some + 1] = np.diff(doc_at)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), values)

    n_links = np.bincount(links["doc"].to_numpy(), minlength=n)
    place = np.full(len(texts), -1)
    place[some] = np.arange(n)
    return Aligned(pa.table({
        **{name: spread(np.diff(x.offsets.to_numpy())) for name, x in zip(("n_a", "n_b"), lists, strict=True)},
        "n_groups": spread(np.diff(group_at)), "n_links": spread(n_links),
        "groups": groups.take(pa.array(place, mask=place < 0)),
        "pair": lists_of(number.cast(pa.int32())), "n": lists_of(by_doc["count_all"].combine_chunks().cast(pa.int32())),
    }), pairs)


def _both(pairs: pa.Table) -> pa.Array:
    """The id pair as one number."""
    a, b = (pairs[c].combine_chunks().cast(pa.int64()) for c in ("a", "b"))
    return pc.bit_wise_or(pc.shift_left(a, pa.scalar(32, pa.int64())), b)


@cache
def _decimals_to(n: int) -> pa.Array:
    return pa.array([str(i) for i in range(n)], pa.large_string())


def _decimals(most: int) -> pa.Array:
    """The numbers up to ``most`` as text (a power of two of them, so that few tables are made)."""
    return _decimals_to(1 << most.bit_length())


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts that reach ``CHUNK_CHARS`` together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _digest(groups: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if g.is_valid else "" for g in groups], pa.string())


@dataclass
class Alignment:
    documents: DataFrame  # id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups)
    pairs: DataFrame      # a, b, links: corpus-wide; best: no other pair of this b has more


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = False) -> Alignment:
    """Every row of ``docs`` aligned, and the corpus-wide counts of linked id pairs.

    ``tokenizer_a``, ``tokenizer_b`` are paths on every executor: a byte-level
    vocabulary (``.json``) or a piece model. Groups are the runs of tokens between
    byte offsets where tokens of both sides end, written ``a1,a2|b1;a3|b2,b3``;
    ``groups_sha256`` is that text's digest and ``''`` for a row without tokens.
    ``n_best``: the row's links whose pair has the highest count of its ``b`` id
    (ties all count); ``count_sum``: the pairs' corpus-wide counts, over the links.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups]
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
             "groups": pa.string(), "chunk": pa.int64(), "pair": pa.list_(pa.int32()), "n": pa.list_(pa.int32()),
             "number": pa.int32(), "a": pa.int32(), "b": pa.int32(), "links": pa.int64()}
    kinds = {c: kind for c, kind in kinds.items() if with_groups or c != "groups"}

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _side(tokenizer_a), _side(tokenizer_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), *kinds.items()])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in _chunks(texts):
                got = align_texts(texts[start:end], a, b)
                rows, pairs = got.documents, got.pairs
                columns = {"id": batch.column(0).slice(start, end - start),
                           **{c: rows[c] for c in ("n_a", "n_b", "n_groups", "n_links", "pair", "n")},
                           "groups_sha256": _digest(rows["groups"].combine_chunks()),
                           "chunk": pa.array(np.full(end - start, chunk))}
                if with_groups:
                    columns["groups"] = rows["groups"]
                yield from _filled(columns, end - start, schema)
                yield from _filled({"chunk": pa.array(np.full(len(pairs), chunk)), "links": pairs["links"],
                                    "number": pa.array(np.arange(len(pairs), dtype=np.int32)),
                                    "a": pairs["a"], "b": pairs["b"]}, len(pairs), schema)
                chunk += 1

    id_type = docs.schema[id_col].dataType.simpleString()
    selected = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = staged(selected.mapInArrow(of_batches, f"id {id_type}, {_ddl(kinds)}"), "aligned")
    own_pairs = parts.filter("number is not null").select("chunk", "number", "a", "b", "links")
    counts = staged(own_pairs.groupBy("a", "b").agg(F.sum("links").alias("links")), "pairs")
    most = counts.groupBy("b").agg(F.max("links").alias("_most"))
    pairs = staged(counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("_most")).alias("best")), "best-pairs")
    told = own_pairs.drop("links").join(pairs, ["a", "b"]).select(
        F.col("chunk").alias("of"), "number", "links", "best")
    rows = parts.filter("number is null").select("id", *names, "chunk", "pair", "n")
    out = f"id {id_type}, {_ddl({c: kinds[c] for c in names})}, n_best long, count_sum long"

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        best, sums = document_sums(left, right)
        return left.select(["id", *names]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(sums))

    documents = rows.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(summed, out)
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    return Alignment(documents.select(F.col("id").alias(id_col), *order), pairs)


def document_sums(rows: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a chunk: its links whose pair is a best one, and its links' corpus-wide counts summed."""
    links, best = (np.zeros(len(told), np.int64) for _ in range(2))
    number = told["number"].to_numpy()
    links[number], best[number] = told["links"].to_numpy(), told["best"].to_numpy()
    pair = rows["pair"].combine_chunks()
    at, ends = pair.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(pair).to_numpy())])
    n = rows["n"].combine_chunks().flatten().to_numpy().astype(np.int64)

    def sums(values: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(values)])
        return running[ends[1:]] - running[ends[:-1]]

    return sums(best[at] * n), sums(links[at] * n)


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    """Spark's names of the column types used here."""
    spark = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{c} {spark[kind]}" for c, kind in kinds.items())


def _filled(columns: dict, n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``columns`` in the schema's order, nulls for those not given."""
    arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
    yield from pa.Table.from_arrays(arrays, schema=schema).combine_chunks().to_batches()
