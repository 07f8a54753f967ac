"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns; and the general interfaces."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from millbook.llm import (
    components,
    embedding_dedup,
    exact_dedup,
    language_id,
    mixing,
    packing,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    url_filters,
)
from millbook.llm import queries as Q
from tests.llm import brute
from tests.llm.test_queries import check_mix, check_packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row_id long, blob string, fp long"
LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string, host string, keys string"
VECTORS = "vec_id long, embedding array<float>, label int, low int, cell int"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def documents():
    base = words(300, 1)
    texts = [None, "", " \t\n\x0b\f\r", "a b", "ab", "a  b ", "A B", "a\u00a0b", "one", "one two", "one two three",
             base, base, base.upper(), base.replace(" ", "\n"), base + " tail", words(30_000, 2), words(30_000, 2),
             words(30_000, 2)[:-1], "\U0001f600 password: hunter2hunter2x", "token=secret=abcdefghijklmnop",
             "password: token: abcdefghijklmnop", 'API_KEY = "x/y+z.0-1_2=3"', "AKIA" + "A" * 14, "AKIA" + "A" * 13,
             "0123456789abcdef" * 2 + " " + "f" * 15, "é" * 5000, "<|endoftext|> x <|endoftext|>",
             "x" * 4096, "x" * 4097, "x" * 8192, "日本語の文章 \u1680 \x1c\x85 test", "der die das und nicht ein"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s10", "s2", None, "", "é"][i % 6], 1, 2, 3, "b", 4)
            for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None, None, None, None, None), (None, None, "en", "s1", 0, 0, 0, "", 0)]
    rows += [rows[11], rows[11], rows[16]]  # wholly equal rows
    rows += [(500 + i, "copy of a hot text " * 5, "en", "hot", 1, 1, 1, "x", 1) for i in range(60)]
    return rows


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for j in range(8):
            rows.append([float(x) for x in (centre + rng.normal(size=16) * (0.02 if j < 5 else 0.15)).astype(np.float32)])
    out = [(i, v, i % 2, 1, 2) for i, v in enumerate(rows)]
    out += [(100, None, 1, 0, 0), (101, [0.0] * 16, 1, 0, 0), (102, rows[0], None, 0, 0), (103, [], 1, 0, 0),
            (104, [float("nan")] * 16, 1, 0, 0), (105, [None] + rows[0][1:], 0, 0, 0), (106, rows[0], 0, 0, 0),
            (107, [2 * x for x in rows[0]], 0, 0, 0), (108, [1.0, 2.0], 0, 0, 0), (109, [1.0, 2.1], 0, 0, 0),
            (110, [float("inf")] + rows[0][1:], 0, 0, 0), (106, rows[0], 0, 0, 0)]
    out += [(200 + i, rows[9], 1, 0, 0) for i in range(40)]
    return out


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.B.NET/x?y=/z#q", "http://xnet/",
        "http://example.net/en/", "http://a.example.net/en", "http://a.example.net/en/x#/de/", "ftp://example.com/de/",
        "http://example.com/de", "http://org/fr/x", "http://a.org/fr/", "http://a.org/x/fr/", "http://.net/",
        "http://a..net/", "x://y://net/", "http://É.NET/é", "http://net?/", "http://example.com\n/de/", "http://a.b.c.org/fr/"]


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("edge"))
    docs = documents()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(i % 7 == 3)) for i in range(0, 30)] + [(3, None, None), (None, 1, 1), (4, 0, 1), (999, 1, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{root}/labels.parquet")
    pages = [(i, u, "", "h", "k") for i, u in enumerate(URLS)] + [(None, "http://net/", "", "", ""), (5, URLS[5], "", "", "")]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame(vectors(), VECTORS).write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("pages", PAGES), ("embeddings", VECTORS)):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return root


def rows_of(spark, root, name):
    return [r.asDict() for r in spark.read.parquet(f"{root}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", [*Q.queries(), "pipeline"])
def test_empty_tables(spark, empty_dir, edge_dir, name):
    got = E.queries()[name](spark, empty_dir)
    assert got.collect() == []
    assert got.dtypes == E.queries()[name](spark, edge_dir).dtypes


@pytest.mark.parametrize("bits", [128, 3])
@pytest.mark.parametrize("block", [4096, 7])
def test_exact_dedup(spark, edge_dir, bits, block):
    """With 3-bit links blocks collide and the next seeds are tried; the result is the same."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    if block == 7:
        docs = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 3000)
    got = exact_dedup.exact_duplicates(docs, block_bytes=block, link_bits=bits).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == brute.exact_dedup([r.asDict() for r in docs.collect()])


def test_drop_exact_duplicates_keeps_columns(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = exact_dedup.drop_exact_duplicates(docs)
    want = Counter(i for (i, _, _, kept, _), n in brute.exact_dedup([r.asDict() for r in docs.collect()]).items()
                   if kept for _ in range(n))
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == want
    bare = docs.select("text")  # without ids: one row per text
    assert exact_dedup.drop_exact_duplicates(bare).count() == sum(want.values())


def test_drop_near_duplicates_keeps_one_row_a_group(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = simhash.drop_near_duplicates(docs)
    want = {c for _, _, c in brute.near_dedup([r.asDict() for r in docs.collect()])}
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == Counter(want)
    assert simhash.drop_near_duplicates(docs.select("text")).count() == len(want)


def test_mix(spark, edge_dir):
    check_mix(rows_of(spark, edge_dir, "documents"), Q.op2_mix_sources(spark, edge_dir).collect())


@pytest.mark.parametrize("share, cap", [(1.5, 2.0), (3.0, 2.0), (0.2, 1.0)])
def test_source_targets(spark, share, cap):
    rng = random.Random(share)
    docs = [{"source": s, "text": "w " * rng.randrange(0, 40)} for s in ["a", "b", "é", "z", None, "", "\U0001f600"]
            for _ in range(rng.randrange(1, 30))]
    sized = spark.createDataFrame([(d["source"], len(d["text"].split())) for d in docs], "source string, size long")
    size, target = brute.sizes_and_targets(docs, share, cap)
    got = {r["source"]: r for r in mixing.source_targets(sized, share, cap).collect()}
    assert {s: r["source_size"] for s, r in got.items()} == size
    assert all(got[s]["target"] == pytest.approx(target[s]) for s in size)


def test_mix_repeats_rows(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    whole = Counter(map(tuple, docs.collect()))
    assert all(n <= 2 * whole[r] for r, n in Counter(map(tuple, got.collect())).items())


def test_near_dedup(spark, edge_dir):
    got = Counter(tuple(r) for r in Q.op3_simhash_dedup(spark, edge_dir).collect())
    assert got == brute.near_dedup(rows_of(spark, edge_dir, "documents"))


@pytest.mark.parametrize("k, parts", [(0, 3), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4), (3, 3)])
def test_near_pairs_finds_every_link(spark, k, parts):
    rng = random.Random(k * 10 + parts)
    fps = set()
    for _ in range(40):  # clusters that crowd the parts, and loners
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 6])):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), k, parts).collect()
    pairs = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in got}
    assert pairs == {frozenset(p) for p in brute.linked_fingerprints(fps, k)[1]}


def test_crowded_fingerprints_probe_a_ball(spark):
    """A cluster larger than the ball: every part is crowded, and the search still finds all links."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    varying = rng.sample(range(64), 13)
    fps = {centre ^ sum(1 << b for b in varying if rng.random() < 0.5) for _ in range(12_000)}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)], "fp long")
    groups = [list(range(22)), list(range(22, 43)), list(range(43, 64))]
    planned = simhash.with_thresholds(frame, groups, np.full(64, 0.5), 2)
    assert planned.filter("plan is null").count() == 0
    links = simhash.near_pairs(frame).distinct()
    u = brute.Union()
    for r in links.collect():
        assert 1 <= bin((r["a"] ^ r["b"]) & ((1 << 64) - 1)).count("1") <= 2
        u.tie(r["a"], r["b"])
    mask = [1 << b for b in varying]
    want = brute.Union()
    for f in fps:
        want.find(f)
        for i, a in enumerate(mask):
            for b in [0, *mask[i + 1:]]:
                if f ^ a ^ b in fps:
                    want.tie(f, f ^ a ^ b)
    assert len({u.find(f - (1 << 64) if f >> 63 else f) for f in fps}) == len({want.find(f) for f in fps})


def test_thresholds_spend_the_budget():
    assert simhash.allocations([22, 21, 21], 2) and all(
        sum(t + 1 for t in a) == 3 for a in simhash.allocations([22, 21, 21], 2))
    assert (0, 0, 0) in simhash.allocations([22, 21, 21], 2) and (2, -1, -1) in simhash.allocations([22, 21, 21], 2)


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(0)
    bits = rng.random((500, 64)) < 0.5
    for a, b in ((3, 40), (10, 60), (20, 21)):
        bits[:, b] = bits[:, a]
    x = bits.astype(float)
    parts = simhash.correlated_parts((x.T @ x).astype(int), 500)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} <= {21, 22}
    assert any({3, 40} <= set(p) for p in parts)


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    edges = [*zip(ids, ids[1:], strict=False), (1000, 1001), (1001, 1000), (7000, 7000), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}


def test_toxicity_edges(spark, edge_dir):
    got = Q.op4_toxicity(spark, edge_dir).collect()
    docs = rows_of(spark, edge_dir, "documents")
    assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d in docs)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and brute.fold(r["doc_id"], 5) == 0) for r in got)


def test_machine_learns_an_interaction():
    """Toxic only where two terms meet: no additive weights can tell."""
    rng = np.random.default_rng(2)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    doc = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    slot = np.concatenate([np.full(a.sum(), 64), np.full(b.sum(), 128)])
    machine = toxicity.fit(doc, slot, (a & b).astype(float), epochs=30)
    both = machine.weights.sum() + (machine.factors[0] * machine.factors[1]).sum() + machine.bias
    assert both > 0 > max(machine.weights + machine.bias)
    assert abs((machine.factors[0] * machine.factors[1]).sum()) > 0.5


def test_scores_equal_the_formula():
    text = "Idiot idiot some other words " + "filler " * 40
    slots = np.sort(toxicity.slots_of(text))[::2]
    rng = np.random.default_rng(1)
    machine = toxicity.FactorizationMachine(0.3, slots, rng.normal(size=len(slots)), rng.normal(size=(len(slots), 4)))
    want = 0.3 + machine.weights.sum() + sum(
        machine.factors[i] @ machine.factors[j] for i in range(len(slots)) for j in range(i))
    assert machine.logits([text, "", "nothing"])[0] == pytest.approx(want)
    assert machine.logits(["", "nothing known"]).tolist() == [0.3, 0.3]


def test_url_filters(spark, edge_dir):
    got = Q.op5_url_filters(spark, edge_dir).collect()
    assert Counter(map(tuple, got)) == Counter(
        (p["page_id"], *brute.judge(p["url"])) for p in rows_of(spark, edge_dir, "pages"))


@pytest.mark.parametrize("max_bytes", [8 << 20, 256])
def test_url_filters_with_many_rules(spark, max_bytes):
    """Long lists over a universe of many more keys, in one shard and in several: always exact."""
    rng = random.Random(9)
    hosts = [f"h{i}.d{i % 97}.example" for i in range(1500)]
    urls = [(i, f"https://{rng.choice(hosts)}/p{rng.randrange(3)}/x{i % 7}") for i in range(4000)]
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h in
                  rng.sample(hosts, 300) + [f"d{i}.example" for i in range(20)] for p in ["/", "/p1/"]}.values())
    got = url_filters.filter_urls(spark.createDataFrame(urls, "id long, url string"),
                                  [url_filters.Rule(*r) for r in rules], ["id"], max_bytes=max_bytes).collect()
    want = {i: brute.judge(u, rules) for i, u in urls}
    assert {r["id"]: tuple(r)[1:] for r in got} == want


def test_url_filters_without_rules(spark):
    got = url_filters.filter_urls(spark.createDataFrame([(1, "http://a/b")], "id long, url string"), [], ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, "a", "/b", None, "allow")]


def test_cascade_has_levels_and_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    levels = url_filters.cascade(universe, "listed")
    assert len(levels) >= 2
    wrong = universe.filter(url_filters.is_listed(levels, F.col("key")) != F.col("listed"))
    assert wrong.count() == 0


def test_secret_scan(spark, edge_dir):
    docs = rows_of(spark, edge_dir, "documents")
    want = Counter()
    for d in docs:
        counts, joined, digest = brute.secrets(d["text"])
        want[(d["doc_id"], *counts, digest, joined)] += 1
    assert Counter(map(tuple, Q.op6_secret_scan(spark, edge_dir).collect())) == want


def test_secret_scan_query_keeps_a_ledger(spark, edge_dir, monkeypatch):
    made, ledger_of = [], secret_scan.BlobLedger
    monkeypatch.setattr(secret_scan, "BlobLedger", lambda *a: made.append(ledger_of(*a)) or made[-1])
    Q.op6_secret_scan(spark, edge_dir)
    blobs = [r["blob"] for r in made[0].entries().collect()]
    texts = spark.read.parquet(f"{edge_dir}/documents.parquet").select(F.coalesce("text", F.lit(""))).distinct()
    assert len(blobs) == len(set(blobs)) == texts.count()


def test_training_finds_terms_that_matter_only_together(spark):
    """Toxic with both or neither of two terms: each alone tells nothing."""
    rng = random.Random(11)
    rows = []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join([f"w{rng.randrange(400)}" for _ in range(12)] + ["grault"] * a + ["corge"] * b)
        rows.append((i, text, int(a == b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert sum(got[r[0]] == bool(r[2]) for r in rows) >= 0.98 * len(rows)


def test_labels_of_one_class_keep_few_slots(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "always " + words(30, i)) for i in range(60)], "doc_id long, text string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(i, toxic) for i in range(60)], "doc_id long, toxic int")
        model = toxicity.train(docs, labels)
        assert len(model.slots) < 40
        scores = [r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()]
        assert all((s >= 0.5) == bool(toxic) for s in scores)


def test_terms_inside_unspaced_runs(spark):
    assert toxicity.words_of("Die 天気は x") == ["die", "天気", "気は", "天気は", "x"]
    rng = random.Random(6)
    letters = [chr(0x4E00 + k) for k in range(300)]
    rows = [(i, "".join(rng.choice(letters) for _ in range(20)) + "愚者" * (i % 2) + "".join(rng.choice(letters) for _ in range(20)), i % 2)
            for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all(got[r[0]] == bool(r[2]) for r in rows)


def test_scan_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghijklmnop", 2, 3, "x"), (1, "token=abcdefghijklmnop", 2, 3, "x"), (2, None, 0, 0, "")],
                                 "doc_id long, text string, address int, _address int, spans string")
    found, _ = secret_scan.scan(docs)
    assert found.columns == [*docs.columns, "blob", "spans_"]
    assert sorted((r.doc_id, len(r.spans_)) for r in found.collect()) == [(1, 1), (1, 1), (2, 0)]
    none, new = secret_scan.scan(docs.limit(0))
    assert none.isEmpty() and new.isEmpty()


def test_ledger_scans_only_unseen_blobs(spark, edge_dir, tmp_path):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/ledger")
    first, new = secret_scan.scan(docs.filter("doc_id < 22"), ledger, "1")
    n = new.count()
    assert n == docs.filter("doc_id < 22").select(F.coalesce("text", F.lit(""))).distinct().count()
    second, new = secret_scan.scan(docs, ledger, "2")
    total = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert new.count() == total - n
    _, new = secret_scan.scan(docs, ledger, "3")
    assert new.count() == 0
    _, new = secret_scan.scan(docs, ledger, "4", rule_version="2")
    assert new.count() == total
    assert set(docs.columns) < set(second.columns) and "blob_" in second.columns  # docs has a column of that name
    fresh, _ = secret_scan.scan(docs)
    key = F.concat_ws("|", "doc_id", "text", secret_scan.joined_spans(F.col("spans")))
    assert Counter(r[0] for r in second.select(key).collect()) == Counter(r[0] for r in fresh.select(key).collect())


def test_sharding_edges(spark, edge_dir):
    got = Q.op7_sharding(spark, edge_dir).collect()
    docs = rows_of(spark, edge_dir, "documents")
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalancing_edits_the_map(spark, tmp_path):
    rng = random.Random(5)
    weights = {s: rng.randrange(1, 1000) for s in range(4096)}
    where = sharding.new_map(weights, 24)
    loads = sharding._loads(where, weights, 24)
    assert max(loads) - min(loads) <= max(weights.values())
    grown = sharding.rebalanced(where, weights, 25)
    moved = [s for s in range(4096) if grown[s] != where[s]]
    assert all(grown[s] == 24 for s in moved) and len(moved) < 4096 / 20
    assert max(sharding._loads(grown, weights, 25)) <= 1.011 * sum(weights.values()) / 25
    for s in range(50):
        weights[s] *= 20
    edited = sharding.rebalanced(grown, weights, 25)
    assert max(sharding._loads(edited, weights, 25)) < max(sharding._loads(grown, weights, 25))
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, where, path, 1)
    sharding.store_map(spark, grown, path, 2)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == where
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.store_map(spark, where, path, 2)


def test_sharding_reads_its_stored_map(spark, edge_dir, tmp_path):
    path = f"file://{tmp_path}/map"
    got = sharding.shard(spark.read.parquet(f"{edge_dir}/documents.parquet"), path=path).collect()
    where = sharding.load_map(spark, path)
    assert len(where) == sharding.SLOTS and got and all(r["shard"] == where[r["virtual_slot"]] for r in got)


@pytest.mark.parametrize("hot", [7, None])
def test_sharding_deals_out_a_hot_key(spark, hot):
    """A third of the rows with one id, or with none and one text: shards stay near equal, other ids stay whole."""
    rows = [(hot if i % 3 == 0 else 100 + i // 2, "equal text" if i % 3 == 0 else f"text {i % 7}") for i in range(30_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t) + 8) for i, t in rows)
    load, slots, places = Counter(), Counter(r["virtual_slot"] for r in got), {}
    for r in got:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["place"])
    assert len(load) == 24 and max(load.values()) < 1.02 * min(load.values()) and max(slots.values()) < 60
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    where = {(r["doc_id"], r["virtual_slot"]) for r in got if r["doc_id"] not in (None, 7)}
    assert len(where) == len({i for i, _ in where})


def test_language_edges(spark, edge_dir):
    docs = rows_of(spark, edge_dir, "documents")
    got = Q.op8_language_id(spark, edge_dir).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d in docs)
    text = {d["doc_id"]: d["text"] for d in docs if d["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or ""))
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("und", "en", "de")


def test_a_rare_language_leaves_the_others_filters(spark):
    """A few rows of one more language change neither what the others encode nor what is predicted of them."""
    rng = random.Random(8)
    heard = {lang: ["".join(rng.choice(abc) for _ in range(rng.randrange(3, 8))) for _ in range(120)]
             for lang, abc in (("en", "abcdefgh"), ("de", "ghijklmn"), ("xx", "opqr"))}
    rows = [(1000 * k + i, " ".join(rng.choices(heard[lang], k=12)), lang)
            for k, (lang, n) in enumerate((("en", 200), ("de", 200), ("xx", 5))) for i in range(n)]
    schema = "doc_id long, text string, lang string"
    without = language_id.train(spark.createDataFrame([r for r in rows if r[2] != "xx"], schema))
    rare = language_id.train(spark.createDataFrame(rows, schema))
    assert without.languages == ["de", "en"] and rare.languages == ["de", "en", "xx"]
    for order in language_id.ORDERS:
        assert np.array_equal(without.cells[order] & 3, rare.cells[order] & 3)
    assert all(without.predict(t) == rare.predict(t) for _, t, lang in rows if lang != "xx")
    assert all(rare.predict(t)[0] == "xx" for _, t, lang in rows if lang == "xx")


def test_bitmask_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    grams = [rng.integers(0, 1 << 62, 500) for _ in range(70)]  # more languages than a word has bits
    filters = language_id.LanguageFilters.of([f"l{i:02d}" for i in range(70)], {3: grams})
    for i, own in enumerate(grams):
        mask = None
        for cell in language_id._cells(own, len(filters.cells[3])):
            mask = filters.cells[3][cell] if mask is None else mask & filters.cells[3][cell]
        assert (mask[:, i // 8] >> (i % 8) & 1).all()
    assert all(0 < r < 0.05 for r in filters.false_rate[3])


def test_letters():
    def shown(t):
        return "".join(map(chr, language_id.letters(t).tolist()))
    assert shown("  Hé!!LLO 12 wörld") == " hé llo wörld " and shown("123 ..") == "" and shown("") == ""
    assert shown("a") == " a "


def test_embedding_dedup(spark, edge_dir):
    want = brute.near_vectors(rows_of(spark, edge_dir, "embeddings"))
    assert Counter(map(tuple, Q.op9_embedding_dedup(spark, edge_dir).collect())) == want


@pytest.mark.parametrize("per_cell, block", [(20, 8), (1000, 16), (30, 1024)])
def test_embedding_cells_and_blocks(spark, per_cell, block):
    """Recall against brute force with many small cells, and exact counts for what blocks find."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 24))
    rows = [(i, [float(x) for x in centres[i % 60] + rng.normal(size=24) * 0.1], i % 2) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(frame, per_cell=per_cell, block=block).collect()}
    want = {i: (n, c, k) for (i, n, c, k) in brute.near_vectors(
        [dict(zip(("vec_id", "embedding", "label"), r, strict=True)) for r in rows])}
    found, all_ = sum(r["n_links"] for r in got.values()), sum(n for n, _, _ in want.values())
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert found >= (0.97 if per_cell < 1000 else 1.0) * all_ > 0
    assert sum(got[i]["component_id"] == want[i][1] for i in want) >= 0.97 * len(want)


def test_embedding_cells_lose_no_link(spark):
    """A label of over ten thousand vectors with one dense group: the cells answer as all with all would."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12_000, 3)) @ rng.normal(size=(3, 24)) + rng.normal(size=(12_000, 24)) * 0.3
    x[:3000] = rng.normal(size=24) * 3 + rng.normal(size=(3000, 24)) * 0.55
    frame = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)],
                                  "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = [np.flatnonzero(unit @ v >= embedding_dedup.LEAST) for v in unit]
    assert [got[i]["n_links"] for i in range(len(x))] == [len(n) - 1 for n in linked]
    low = np.full(len(x), -1)
    for i in range(len(x)):
        reached = [i] if low[i] < 0 else []
        while reached:
            at = reached.pop()
            if low[at] < 0:
                low[at] = i
                reached += linked[at][low[linked[at]] < 0].tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()


def test_a_word_is_encoded_once_whatever_follows_it():
    """Marks beside a word make no new strings to encode."""
    tokens = packing.Tokens(Q.tokenizer_path())
    words, marks = ["alpha", "beta", "gamma", "délta"], [",", ".", ";", ":", "!", "?", "\n", ""]
    texts = [f"{a}{m} {b}{n}" for a in words for b in words for m in marks for n in marks]
    asked, encode = [], tokens._encode
    tokens._encode = lambda strings: asked.extend(strings) or encode(strings)
    got = list(tokens.ids(texts))
    assert len(asked) == len(set(asked)) <= 2 * len(words) + len(marks) + 2
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_reach_the_model_alone(monkeypatch):
    """Texts of plain characters cost no run of the whole tokenizer, and equal parts of a chunk are cut into words once."""
    tokens = packing.Tokens(Q.tokenizer_path())
    texts = [" a  b\n c's,  ", "", " ", "x\t \ny 12é", " a  b\n c's,  ", "\n", "don't  stop \r\n", "a" * 300] * 50
    want = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    cut = []

    class Words:
        def findall(self, text):
            cut.append(text)
            return words_of(text)

    words_of = packing._WORDS.findall
    monkeypatch.setattr(packing, "_WORDS", Words())
    tokens.tokenizer = None
    assert list(tokens.ids(texts)) == want
    assert sum(map(len, cut)) < 2 * sum(map(len, texts[:8]))


def test_other_vocabularies_take_texts_whole(tmp_path):
    """A tokenizer that changes texts or cuts them otherwise is asked for whole texts."""
    from tokenizers import Tokenizer, normalizers

    changed = Tokenizer.from_file(Q.tokenizer_path())
    changed.normalizer = normalizers.Lowercase()
    changed.save(str(tmp_path / "lower.json"))
    texts = ["Alpha BETA", "alpha beta"]
    a, b = packing.Tokens(str(tmp_path / "lower.json")).ids(texts)
    assert a == b == next(packing.Tokens(Q.tokenizer_path()).ids(texts[1:]))


def test_packing_edges(spark, edge_dir):
    check_packing(rows_of(spark, edge_dir, "documents"), Q.op10_pack_sequences(spark, edge_dir).collect())


def test_packing_over_partitions_and_with_ids(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = packing.pack_documents(docs, Q.tokenizer_path(), with_ids=True, open_bins=2, pieces_per_partition=20).collect()
    check_packing([r.asDict() for r in docs.collect()], got)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)


def test_best_fit_bins():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.open == 0 and bins.place(10) == (2, 0)
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1, the fullest, has closed
    assert bins.place(3) == (0, 6)
    rng = random.Random(1)
    sizes = [rng.randrange(1, 1025) for _ in range(20_000)]
    bins = packing.BestFit()
    for n in sizes:
        bins.place(n)
    assert bins.open <= packing.OPEN_BINS and bins.next <= 1.04 * sum(sizes) / 1024


def test_word_cache_equals_the_tokenizer(monkeypatch):
    tokens = packing.Tokens(Q.tokenizer_path())
    rng = random.Random(3)
    alphabet = "ab  \n\t'sStrevél12.,$ßñ\u00a0\u2019-_\u2028\u3000\x1c日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    monkeypatch.setattr(packing, "_CACHE_WORDS", 50)  # generations change often
    monkeypatch.setattr(packing, "_CHUNK_CHARS", 100)
    for text, ids in zip(texts, tokens.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(tokens.young) + len(tokens.old) < 400


def test_classes_of_the_word_pattern():
    """For the characters taken apart here, letters and numbers are Unicode's, and the pattern cuts as the tokenizer does."""
    import re
    import unicodedata

    tokens = packing.Tokens(Q.tokenizer_path())
    for c in map(chr, range(0x2100)):
        if packing._PLAIN.fullmatch(c):
            kind = unicodedata.category(c)[0]
            assert bool(re.fullmatch(f"[{packing._LETTERS}]", c)) == (kind == "L"), hex(ord(c))
            assert bool(re.fullmatch(f"[{packing._NUMBERS}]", c)) == (kind == "N"), hex(ord(c))
    cut = tokens.tokenizer.pre_tokenizer.pre_tokenize_str
    for c in map(chr, range(0x2100)):
        text = f"a{c}1 {c}{c} ."
        if packing._PLAIN.fullmatch(text):
            assert [text[s:e] for _, (s, e) in cut(text)] == packing._WORDS.findall(text), hex(ord(c))


def test_pipeline_on_edges(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, edge_dir)
        assert docs.columns == columns and docs.count() > 0
    check_packing([r.asDict() for r in docs.collect()],
                  corpus_pipeline.STAGES[-1][1](spark, docs, edge_dir).collect())
