"""The registered queries over whole tables against brute force, SQL, or held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from millbook.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm import brute
from tools.oracle_check import frame_hash

SF = "/root/testdata/sf0.01"


def rows_of(spark, name, sf=SF):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def answer(spark, name, sf=SF):
    return E.queries()[name](spark, sf).collect()


def test_all_operators_are_registered():
    names = set(E.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing",
                                                       "best-fit packing"]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck_small, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck_small.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert frame_hash(got)[0] == frame_hash(want)[0]


def test_exact_dedup(spark):
    got = Counter(tuple(r) for r in answer(spark, "op1_exact_dedup"))
    assert got == brute.exact_dedup(rows_of(spark, "documents"))


def check_mix(docs, got):
    size, target = brute.sizes_and_targets(docs)
    by_source = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2)
        by_source[r["source"]] += r["taken"]
    longest = Counter()
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in size:
        assert abs(by_source[s] - target[s]) <= longest[s]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(
        (d["doc_id"], len(brute.WORD.findall(d["text"] or ""))) for d in docs)


def test_mix(spark):
    got = answer(spark, "op2_mix_sources")
    check_mix(rows_of(spark, "documents"), got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, answer(spark, "op2_mix_sources")))


def test_near_dedup(spark):
    got = Counter(tuple(r) for r in answer(spark, "op3_simhash_dedup"))
    assert got == brute.near_dedup(rows_of(spark, "documents"))


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    p = label.sum()
    return (rank[label].sum() - p * (p - 1) / 2) / (p * (len(label) - p))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in answer(spark, "op4_toxicity", sf)}
    docs, labels = rows_of(spark, "documents", sf), {r["doc_id"]: r["toxic"] for r in rows_of(spark, "labels", sf)}
    assert set(got) == {d["doc_id"] for d in docs}
    for i, r in got.items():
        assert r["held_out"] == (brute.fold(i, 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [i for i in labels if i in got and got[i]["held_out"]]
    score, label = np.array([got[i]["score"] for i in held]), np.array([labels[i] == 1 for i in held])
    assert auc(score, label) > 0.95
    assert (score[~label] >= 0.5).mean() < 0.02 and (score[label] >= 0.5).mean() > 0.8


def test_url_filters(spark):
    for r, p in zip(sorted(answer(spark, "op5_url_filters")), sorted(rows_of(spark, "pages"), key=lambda p: p["page_id"]),
                    strict=True):
        assert tuple(r) == (p["page_id"], *brute.judge(p["url"]))


def test_secret_scan(spark):
    docs = {d["doc_id"]: d["text"] for d in rows_of(spark, "documents")}
    for r in answer(spark, "op6_secret_scan"):
        counts, joined, digest = brute.secrets(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["spans"] == joined and r["base_sha256"] == digest


def test_sharding(spark):
    docs = {d["doc_id"]: d["text"] for d in rows_of(spark, "documents")}
    got = answer(spark, "op7_sharding")
    assert len(got) == len(docs)
    load, places = Counter(), {}
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(load) == list(range(24)) and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, answer(spark, "op7_sharding")))


def test_language_on_held_out_rows(spark):
    docs = {d["doc_id"]: d for d in rows_of(spark, "documents")}
    got = answer(spark, "op8_language_id")
    assert len(got) == len(docs)
    right = []
    for r in got:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (brute.fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"]:
            right.append(r["lang_pred"] == d["lang"])
    assert np.mean(right) > 0.95


def test_embedding_dedup(spark):
    assert Counter(map(tuple, answer(spark, "op9_embedding_dedup"))) == brute.near_vectors(rows_of(spark, "embeddings"))


def check_packing(docs, got):
    """``got`` holds every piece of every document, whole and in sequences without overlap."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    want, total = Counter(), 0
    for d in docs:
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            own = np.array(ids[at:first] if k == 0 else ids[at:at + 1024], "<u4").tobytes()
            want[d["doc_id"], k, at, len(own) // 4, zlib.crc32(own)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), -(-total // 1024)


def test_packing(spark):
    used, least = check_packing(rows_of(spark, "documents"), answer(spark, "op10_pack_sequences"))
    assert used <= 1.03 * least


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    clean = stages["toxicity"](spark, docs, SF_SMALL)
    model = Q.toxicity_model(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    want = Counter(tuple(r) for r in docs.collect() if model.logits([r["text"] or ""])[0] < 0)
    assert clean.columns == columns and Counter(map(tuple, clean.collect())) == want
    exact = stages["exact dedup"](spark, docs, SF_SMALL)
    kept = {r["doc_id"] for r in answer(spark, "op1_exact_dedup", SF_SMALL) if r["kept"]}
    assert exact.columns == columns and sorted(r["doc_id"] for r in exact.collect()) == sorted(kept)
    near = stages["SimHash near-dedup"](spark, exact, SF_SMALL)
    kept = {c for _, _, c in brute.near_dedup([r.asDict() for r in exact.collect()])}
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == sorted(kept)
    mixed = stages["mixing"](spark, near, SF_SMALL)
    near_docs = [r.asDict() for r in near.collect()]
    _, target = brute.sizes_and_targets(near_docs)
    taken, copies = Counter(), Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(brute.WORD.findall(r["text"]))
        copies[r["doc_id"]] += 1
    assert mixed.columns == columns and max(copies.values()) <= 2
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.25)
    mixed_docs = [r.asDict() for r in mixed.collect()]
    check_packing(mixed_docs, stages["best-fit packing"](spark, mixed, SF_SMALL).collect())


def test_pipeline_runs(spark):
    assert E.queries()["pipeline"](spark, SF_SMALL).count() > 0
