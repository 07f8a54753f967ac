"""Best-fit packing of token sequences, online and in bounded space.

A document's ids (its text's, then an end id) longer than a sequence are cut so
that all pieces but the first are whole sequences. Pieces arrive in an order
fixed by a hash; each goes into the open bin it fills best, found in a bitset
keyed by free space. If none fits, a new bin opens; with all bins in use, the
fullest closes first.

Pieces are dealt over partitions by hash and every partition packs its own, so
the packing is a stream with a fixed number of open bins per task; a partition
leaves at most those bins part-filled, so it is given many times as many pieces.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millbook.plans.lineage import staged

SEQUENCE, END_ID, OPEN_BINS = 1024, 2, 2048
PIECES_PER_PARTITION = 200_000
#: Characters whose class is the same in every Unicode version; texts with others go to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-ȳ‐-‧‰-⁞]*")
#: The byte-level vocabulary's word pattern (fixed value), its letter and number classes spelt out for those characters.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ȳ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s\x00{_LETTERS}{_NUMBERS}]+|\x00|"
                    r"\s+(?![^\s\x00])|\s+")
#: A space that does not begin a word: white space or the end of the text follows it.
_LOOSE_SPACE = re.compile(r" (?=\s|$)")
_END, _FIRST, _LOOSE = "\0", "\1", "\2"  # not among the plain characters
_CACHE_WORDS = 1 << 19
_CHUNK_CHARS = 1 << 21
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on.
_ALPHABET = {b: 0x100 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
del _ALPHABET[0]  # _END, which no word holds


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE merges within words only, and a word begins at every space
    with other characters after it. So texts are split at these spaces, the
    distinct parts of a chunk are cut into words, and each distinct word is
    encoded by the tokenizer's model once. Words are remembered in two
    generations: a full young one becomes the old one, so frequent words stay
    and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread per task
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # strings the tokenizer cuts out of a text before it looks at words
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, cut = self.tokenizer.model, self.tokenizer.pre_tokenizer
        # whether words are cut as here; otherwise texts go to the tokenizer whole
        self.by_words = (isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
                         and self.tokenizer.normalizer is None)
        self.young: dict[str, bytes] = {_END: b""}
        self.old: dict[str, bytes] = {}

    def _encode_text(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u4").tobytes()

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words: the vocabulary's merges of their bytes, spelt in its alphabet."""
        spelt = _END.join(words).encode().decode("latin-1").translate(_ALPHABET).split(_END) if words else []
        for ids in map(self.model.tokenize, spelt):
            yield struct.pack(f"<{len(ids)}I", *[t.id for t in ids])

    def _learn(self, new: set[str]) -> None:
        if len(self.young) + len(new) > _CACHE_WORDS:
            self.old, self.young = self.young, {_END: b""}
        unknown = [w for w in new if w not in self.old]
        self.young.update((w, self.old[w]) for w in new if w in self.old)
        self.young.update(zip(unknown, self._encode(unknown), strict=True))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, worked through in runs of bounded length."""
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= _CHUNK_CHARS:
                yield from self._ids(run)
                run, size = [], 0
        yield from self._ids(run)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self.by_words and bool(_PLAIN.fullmatch(t)) and not any(a in t for a in self.added) for t in texts]
        found = iter(self._plain_ids([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else [])
        for t, p in zip(texts, plain, strict=True):
            yield next(found) if p else self._encode_text(t)

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of plain characters."""
        marked = pa.array([_FIRST + _LOOSE_SPACE.sub(_LOOSE, t) for t in texts], pa.large_string())
        lists = pc.split_pattern(marked, " ")
        parts = lists.flatten().dictionary_encode()
        joined = self._part_ids(parts.dictionary).take(parts.indices)
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _part_ids(self, parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct parts, each a space (but for a text's first) and what follows up to the next part."""
        whole = pa.LargeListArray.from_arrays(pa.array([0, len(parts)], pa.int64()), parts)
        text = " " + pc.binary_join(whole, pa.scalar(_END + " ", pa.large_string()))[0].as_py() + _END
        words = _WORDS.findall(text.replace(" " + _FIRST, "").replace(_LOOSE, " "))
        found = list(map(self.young.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        self._learn({words[k] for k in missing})
        for k in missing:
            found[k] = self.young[words[k]]
        _, offsets, data = pa.array(found, pa.large_binary()).buffers()
        ends = np.array([0, *(k for k, w in enumerate(words) if w == _END)], np.int64)
        offsets = pa.py_buffer(np.frombuffer(offsets, np.int64)[ends])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, offsets, data])


@cache
def _tokens(path: str) -> Tokens:
    """One per Python worker, so that its words serve the worker's later tasks too."""
    return Tokens(path)


def pieces_of(ids: bytes, length: int = SEQUENCE) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: only the first may be shorter than ``length``."""
    n = len(ids) // 4
    first = (n - 1) % length + 1
    return [(0, first), *((at, length) for at in range(first, n, length))]


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
        end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` per piece of every row; ``ids`` (binary, 32-bit) on request.

    A null text is an empty one: its only id is ``end_id``. ``tokenizer`` is the
    path of the tokenizer's file on every executor.
    """
    end = end_id.to_bytes(4, "little")
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    id_type = docs.schema[id_col].dataType

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in batches:
            row, piece, start, size, crc, whole = [], [], [], [], [], []
            for r, ids in enumerate(tokens.ids([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for k, (at, n) in enumerate(pieces_of(ids, length)):
                    own = ids[4 * at:4 * (at + n)]
                    row.append(r), piece.append(k), start.append(at), size.append(n), crc.append(zlib.crc32(own))
                    if with_ids:
                        whole.append(own)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(whole, pa.binary())] * with_ids, names)

    schema = f"`{id_col}` {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long" + (
        ", ids binary" if with_ids else "")
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(of_batches, schema)


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins of ``capacity``."""

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f is set when some open bin has f places free
        self.bins: dict[int, list[int]] = {}  # free space -> open bins, the latest last
        self.open = self.next = 0

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        found = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """``(bin, offset)`` of an item."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1  # the least free space that is enough
            found = self._take(space)
        else:
            space, found = self.capacity, self.next
            self.next += 1
            if size < self.capacity and self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        left = space - size
        if left:
            self.bins.setdefault(left, []).append(found)
            self.free |= 1 << left
            self.open += 1
        return found, self.capacity - space


def pack(pieces: DataFrame, length: int = SEQUENCE, open_bins: int = OPEN_BINS,
         pieces_per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` needs a ``length`` column (at most ``length``); it is staged
    first, because the number of partitions follows from its rows. Rows are
    dealt and ordered by a hash of all their columns, so a rerun or a lost
    executor packs the same way; equal rows may swap.
    """
    rows = staged(pieces, "pieces")
    keys = [f.name for f in rows.schema.fields if f.dataType.typeName() != "binary"]
    partitions = max(1, -(-rows.count() // pieces_per_partition))
    dealt = rows.withColumn("_order", F.xxhash64(*keys)).repartition(partitions, "_order").sortWithinPartitions(
        "_order", *keys).withColumn("_part", F.spark_partition_id())
    at = rows.columns.index("length")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(length, open_bins)
        for batch in batches:
            base = batch.column(len(rows_names) + 1).to_numpy().astype(np.int64) << 40
            found = [bins.place(n) for n in batch.column(at).to_numpy().tolist()]
            sequence = base + np.fromiter((b for b, _ in found), np.int64, len(found))
            offset = np.fromiter((o for _, o in found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rows_names)], pa.array(sequence), pa.array(offset)],
                                             [*rows_names, "sequence_id", "offset"])

    rows_names = rows.columns
    return dealt.mapInArrow(packed, rows.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = SEQUENCE, with_ids: bool = False, **options) -> DataFrame:
    """Every row of ``docs`` tokenised, cut and packed: one row per piece. Empty input gives no rows."""
    return pack(cut(docs, tokenizer, id_col, text_col, length, with_ids=with_ids), length, **options)
