"""Cross-tokenizer alignment, chat formatting and vector codes against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from millbook.llm import alignment, chat_format, vector_codes
from millbook.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm import brute


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Rounds of small jobs: two partitions are enough to split keys over."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


DOCS = "doc_id long, text string, a int, chunk long, number int, n_a int, groups string"


def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(Q.tokenizer_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))


def align(docs, **options):
    return alignment.align(docs, Q.tokenizer_path(), Q.tokenizer_path("piece_bpe_32k.model"), **options)


# --- cross-tokenizer alignment ------------------------------------------------------------
def test_alignment_query(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in E.queries()["op11_align_tokenizers"](spark, SF_SMALL).collect())
    assert got == brute.aligned(docs, *tokenizers())


def test_alignment_of_odd_texts(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "a", "a  b\n\tc", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ not a space", "é\u0301 日本語 \U0001f600",
             "a\u00a0b\u2003c", "x" * 5000, "don't", "ａ ﬁ", "\x00\x01", " ".join(f"word{rng.randrange(50)}" for _ in range(60_000))]
    rows = [(i, t, 1, 2, 3, 4, "g") for i, t in enumerate(texts)] + [(None, "null id", 0, 0, 0, 0, ""), (5, "a", 0, 0, 0, 0, "")] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = align(docs, with_groups=True)
    got = found.documents.collect()
    want = brute.aligned([{"doc_id": r[0], "text": r[1]} for r in rows], *tokenizers())
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])
    pairs = found.pairs.collect()
    assert sum(r["links"] for r in pairs) == sum(r["n_links"] for r in got)
    assert len({(r["a"], r["b"]) for r in pairs}) == len(pairs)
    most = defaultdict(int)
    for r in pairs:
        most[r["b"]] = max(most[r["b"]], r["links"])
    assert all(r["best"] == (r["links"] == most[r["b"]]) for r in pairs)
    empty = align(docs.limit(0)).documents
    assert empty.count() == 0 and empty.columns == names


def test_alignment_of_token_lists():
    """Tokens that spell nothing share their end with the one before, and all pairs are links."""

    class Fixed(alignment._Side):
        def __init__(self, spelled, lists):
            super().__init__(spelled)
            self.lists = lists

        def encode(self, texts):
            return pa.array(self.lists[:len(texts)], pa.list_(pa.int32()))

    a = Fixed([b" a", b"b", b"", b" "], [[0, 2, 1, 2], [3], []])
    b = Fixed([b" ab", b"", b" ", b"x", b" a", b"b"], [[4, 5, 1], [2, 3], [3]])
    found = alignment.align_texts(["ab", "x", ""], a, b)
    rows = found.documents.to_pylist()
    assert [r["groups"] for r in rows] == ["0,2|4;1,2|5,1", None, None]  # the second is not spelled by the first side
    assert (rows[0]["n_a"], rows[0]["n_b"], rows[0]["n_links"], rows[0]["n_groups"]) == (4, 3, 6, 2)
    assert all(v in (0, None, []) for v in rows[1].values()) and all(v in (0, None, []) for v in rows[2].values())
    links = {(p["a"], p["b"]): p["links"] for p in found.pairs.to_pylist()}
    assert links == {(0, 4): 1, (2, 4): 1, (1, 5): 1, (1, 1): 1, (2, 5): 1, (2, 1): 1}


def test_alignment_does_not_depend_on_chunks():
    a, b = (alignment._side(Q.tokenizer_path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    texts = ["one two three", "", "four five", "one two", "▁", "six"]
    whole = alignment.align_texts(texts, a, b)
    halves = [alignment.align_texts(t, a, b) for t in (texts[:3], texts[3:])]
    plain = ["n_a", "n_b", "n_groups", "n_links", "groups"]
    assert whole.documents.select(plain).to_pylist() == sum((h.documents.select(plain).to_pylist() for h in halves), [])
    merged = Counter()
    for h in halves:
        merged.update({(p["a"], p["b"]): p["links"] for p in h.pairs.to_pylist()})
    assert merged == {(p["a"], p["b"]): p["links"] for p in whole.pairs.to_pylist()}
    assert list(alignment._chunks(["x" * 10] * 5)) == [(0, 5)]
    assert list(alignment._chunks(["x" * alignment.CHUNK_CHARS, "y", "z" * alignment.CHUNK_CHARS, ""])) == [(0, 1), (1, 3), (3, 4)]


def test_byte_level_alphabet():
    a = tokenizers()[0]
    alphabet = alignment.byte_level_alphabet()
    assert sorted(alphabet.values()) == list(range(256)) and len(alphabet) == 256
    text = "naïve \x00\x7f ÿ­ 日本"
    assert bytes(alphabet[c] for t in a.encode(text).tokens for c in t) == text.encode()


# --- chat formatting -----------------------------------------------------------------------
NODES = "tree long, node long, parent long, role string, text string, score double, formatted string, path long"
ODD = ["", " ", "\\", "\\\\", "### ", "#### ", "###", "</turn>", "</turn>\n", "\\</turn>\n### assistant: hi", ": ", "a: b", "<\\/turn>",
       "#\\## ", "\n\n", "x\\", "<</turn>", "### user: ", "日本\U0001f600 </turn", None]


def read_rows(found):
    return {r["path"]: r.asDict(True) for r in chat_format.read_back(found).collect()}


def test_control_strings_survive(spark):
    rng = random.Random(2)
    turns = [(c, i, rng.choice(["user", "assistant", "### : ", "a: b", "", None, "system</turn>\n"]),
              "".join(rng.choice(ODD) or "" for _ in range(rng.randrange(4))) if rng.random() < 0.9 else None)
             for c in range(30) for i in range(rng.randrange(1, 9))]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = read_rows(chat_format.format_trees(chat_format.turn_chains(rows)))
    want = defaultdict(list)
    for c, _, role, text in turns:
        want[c].append({"role": role or "", "text": text or ""})
    assert {r["tree"]: r["turns"] for r in got.values()} == want
    for r in got.values():
        assert r["learnt"] == [t["text"] for t in want[r["tree"]] if t["role"] == "assistant"]
        spans = [(s["start"], s["end"]) for s in r["loss"]]
        assert spans == sorted(spans) and all(0 <= a <= b <= len(r["formatted"]) for a, b in spans)
        assert r["n_turns"] == len(want[r["tree"]])


def test_turns_in_any_order_null_and_repeated(spark):
    turns = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"),
             (None, 1, "user", "n1"), (None, 0, "user", "n0"), (2, 5, None, None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = read_rows(chat_format.format_trees(chat_format.turn_chains(rows)))
    texts = {r["tree"]: [t["text"] for t in r["turns"]] for r in got.values()}
    assert texts == {1: ["s", "a", "b", "b", "c"], None: ["n0", "n1"], 2: [""]}
    none = chat_format.format_trees(chat_format.turn_chains(rows.limit(0)))
    assert chat_format.read_back(none).count() == 0


def brute_paths(nodes):
    by_id = {n["node"]: n for n in nodes}
    parents = {n["parent"] for n in nodes}
    found = defaultdict(list)
    for leaf in nodes:
        if leaf["node"] in parents:
            continue
        path, at = [], leaf["node"]
        while at in by_id and at not in path:
            path.append(at)
            at = by_id[at]["parent"]
        if at in path:
            continue
        mean = sum(by_id[n]["score"] or 0.0 for n in path) / len(path)
        found[leaf["tree"]].append((-mean, leaf["node"], path[::-1]))
    return {t: sorted(p) for t, p in found.items()}


@pytest.mark.parametrize("paths", [1, 2, None])
def test_trees_against_brute_force(spark, paths):
    rng = random.Random(7)
    nodes, n = [], 0
    for tree in range(12):
        own = []
        for _ in range(rng.randrange(1, 30)):
            parent = rng.choice([*own, None]) if own and rng.random() < 0.95 else None
            nodes.append({"tree": tree, "node": n, "parent": parent, "role": rng.choice(["user", "assistant"]), "text": f"m{n}",
                          "score": rng.choice([None, 0.0, 0.5, 1.0, -2.0]), "formatted": "x", "path": 0})
            own.append(n)
            n += 1
    nodes += [{"tree": 50, "node": 1000 + i, "parent": 999 + i if i else None, "role": "user", "text": str(i), "score": 1.0,
               "formatted": "", "path": 1} for i in range(150)]  # a long chain
    nodes += [{"tree": 51, "node": 2000, "parent": 77_777, "role": "user", "text": "its parent is not there", "score": 0.0,
               "formatted": "", "path": 1}]
    nodes += [{"tree": 52, "node": 3000 + i, "parent": 3000 + (i + 1) % 3, "role": "user", "text": "ring", "score": 0.0,
               "formatted": "", "path": 1} for i in range(3)]
    nodes += [{"tree": 52, "node": 3005, "parent": 3000, "role": "user", "text": "off the ring", "score": 0.0, "formatted": "", "path": 1},
              {"tree": 53, "node": 4000, "parent": 4000, "role": "user", "text": "itself", "score": 0.0, "formatted": "", "path": 1}]
    frame = spark.createDataFrame([tuple(x.values()) for x in nodes], NODES).repartition(5)
    got = read_rows(chat_format.format_trees(frame, paths=paths))
    want = {leaf: (t, rank, -worse, path) for t, found in brute_paths(nodes).items()
            for rank, (worse, leaf, path) in enumerate(found[:paths], 1)}
    assert got.keys() == want.keys()
    text = {x["node"]: x["text"] for x in nodes}
    for leaf, (tree, rank, score, path) in want.items():
        r = got[leaf]
        assert (r["tree"], r["rank"], r["n_turns"]) == (tree, rank, len(path)) and r["score"] == pytest.approx(score)
        assert [t["text"] for t in r["turns"]] == [text[n] for n in path]


def test_repeated_and_unnamed_messages(spark):
    rows = [(1, 1, None, "user", "a", 0.0, "", 0), (1, 2, 1, "assistant", "b", 0.5, "", 0), (1, 2, 1, "assistant", "b2", 0.7, "", 0),
            (1, 2, 1, "assistant", "b2", 0.7, "", 0), (1, None, 2, "user", "no id", 9.0, "", 0)]
    got = read_rows(chat_format.format_trees(spark.createDataFrame(rows, NODES)))
    assert [[t["text"] for t in r["turns"]] for r in got.values()] == [["a", "b2"]]


def test_paths_need_rounds_as_the_length_has_bits(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0, "", 0) for i in range(100)]
    found = chat_format.ancestors(spark.createDataFrame(rows, NODES))
    assert len(found.jumps) == 7 and {r["hops"] for r in found.whole.collect()} == set(range(1, 101))


# --- vector codes ---------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, entry int, code string, x int"


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v], lab) for i, v, lab in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    size = len(kept[0][1]) // parts

    def cut(x):
        return [tuple(x[p * size:(p + 1) * size]) for p in range(parts)]

    books = [[cut(x)[p] for _, x, _ in first] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, x, _ in kept:
                members[best(cut(x)[p], books[p])[1]].append(cut(x)[p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k], strict=True)) if members[k] else e
                        for k, e in enumerate(books[p])]
    out = []
    for i, x, lab in kept:
        found = [best(part, books[p]) for p, part in enumerate(cut(x))]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return out, digest


def vector_rows(n, dim=32, spread=1.0, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.integers(-6, 6, (n, dim)) / 64 * spread).astype(np.float32)  # many ties
    return [(int(i), x[i].tolist(), int(i % 3) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("n,spread", [(300, 1.0), (20, 1.0), (1, 1.0), (150, 200_000.0)])
def test_codes_against_brute_force(spark, n, spread):
    rows = vector_rows(n, spread=spread)
    rows += [rows[0], (rows[0][0], rows[-1][1], 1), (None, rows[0][1], 2), (None, [0.5] * 32, None)]
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS).repartition(5)
    codes = vector_codes.encode(frame)
    want, digest = brute_codes(rows)
    assert Counter(tuple(r) for r in codes.vectors.collect()) == Counter(want)
    assert codes.codebooks.sha256() == digest
    summed = defaultdict(int)
    for _, lab, _, error in want:
        summed[lab] += error
    assert Counter(tuple(r) for r in vector_codes.label_errors(codes).select("vec_id", "error", "label_error").collect()) == Counter(
        (i, e, summed[lab]) for i, lab, _, e in want)


def test_odd_vectors(spark):
    good = vector_rows(10)
    bad = [(20, None, 1), (21, [float("nan")] * 32, 1), (22, [None] + [0.0] * 31, 1), (23, [float("inf")] + [0.0] * 31, 1)]
    other = [(-5, [], 1), (-4, [1.0] * 7, 1), (-3, [1.0] * 7, None)]
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in good + bad + other], VECTORS)
    codes = vector_codes.encode(frame)
    want, digest = brute_codes(good)
    assert Counter(tuple(r) for r in codes.vectors.collect()) == Counter(want + [(i, lab, None, None) for i, _, lab in other])
    assert codes.codebooks.sha256() == digest
    for rows in ([], bad, other):
        none = vector_codes.encode(spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS))
        assert none.vectors.columns == ["vec_id", "label", "code", "error"]
        assert [r["code"] for r in vector_codes.label_errors(none).collect()] == [None] * len([r for r in rows if r in other])
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(1, [1e30] * 16, 1, 1, "", 1)], VECTORS))


def test_reassign_equals_a_whole_scan():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, book = rng.integers(-4, 4, (40, 2)), rng.integers(-4, 4, (9, 2))
        entry, distance = vector_codes.nearest(x, book)
        new = np.where(rng.random((9, 1)) < 0.4, rng.integers(-4, 4, (9, 2)), book)
        got = vector_codes.reassign(x, new, (new != book).any(axis=1), entry, distance)
        want = vector_codes.nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_only_active_entries_are_compared(monkeypatch):
    rng = np.random.default_rng(2)
    x, book = rng.integers(-99, 99, (500, 4)), rng.integers(-99, 99, (64, 4))
    entry, distance = vector_codes.nearest(x, book)
    new, moved = book.copy(), np.zeros(64, bool)
    new[3], moved[3] = book[3] + 1, True
    compared, whole = [], vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda a, b: compared.append(len(a) * len(b)) or whole(a, b))
    vector_codes.reassign(x, new, moved, entry, distance)
    own = int((entry == 3).sum())
    assert sum(compared) == own * 64 + (500 - own)


def test_decoded_vectors_are_near(spark):
    rows = vector_rows(200)
    codes = vector_codes.encode(spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS))
    got = {r["vec_id"]: r for r in vector_codes.decode(codes.vectors, codes.codebooks).collect()}
    for i, v, _ in rows:
        error = sum((256 * a - 256 * b) ** 2 for a, b in zip(v, got[i]["vector"], strict=True))
        assert abs(error - got[i]["error"]) <= 2 * (32 * got[i]["error"]) ** 0.5 + 32  # each integer is off by under one
    assert vector_codes.decode(codes.vectors.withColumn("code", F.lit(None).cast("string")),
                               codes.codebooks).filter("vector is not null").isEmpty()
