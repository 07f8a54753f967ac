"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millbook.llm import (
    alignment,
    chat_format,
    embedding_dedup,
    exact_dedup,
    language_id,
    mixing,
    oracle,
    packing,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    url_filters,
    vector_codes,
)
from millbook.plans.lineage import shared_dir
from millbook.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    found = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes from it."""
    plan = mixing.plan_mix(read(spark, sf_dir, "documents"), ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                       "source", "copies")


def hex64(c: str) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id reachable over near copies."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, by ``divisor``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(-1))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.FactorizationMachine:
    return toxicity.train(docs, labels.filter(remainder("doc_id", 5) > 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The contract's rules.
URL_RULES = (url_filters.Rule("block", "net", "/"), url_filters.Rule("allow", "example.net", "/en/"),
             url_filters.Rule("block", "example.com", "/de/"), url_filters.Rule("allow", "org", "/fr/"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filters.filter_urls(read(spark, sf_dir, "pages"), URL_RULES, ["page_id"])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets by kind, and where they are.

    The corpus is scanned in two versions through one ledger: the second, whose
    blobs the first has met, scans nothing and joins the findings from the ledger.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.BlobLedger(spark, f"{shared_dir(spark)}/blob-ledgers/{uuid.uuid4().hex}")
    secret_scan.scan(docs, ledger, "first")
    found, _new = secret_scan.scan(docs, ledger, "second")
    joined = secret_scan.joined_spans(F.col("spans"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, near equal in bytes, and its place there."""
    placed = sharding.shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         "virtual_slot")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the documents outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    fold = remainder("doc_id", 4)
    filters = language_id.train(docs.filter((fold != 2) & (fold >= 0)))
    return language_id.identify(docs, filters, ["doc_id"]).select(
        "doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links, component and whether it stays."""
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they lie."""
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, linked where they end together."""
    found = alignment.align(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return found.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: Fixed value: the contract's added conversation, whose texts hold control strings.
CONTROL_TURNS = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op12_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text with its loss mask, read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    written = chat_format.format_trees(chat_format.turn_chains(rows.unionByName(added)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learnt = F.concat_ws("", "learnt")
    return chat_format.read_back(written).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error, its label's error and the codebooks' digest."""
    codes = vector_codes.encode(read(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(codes.codebooks.sha256()).alias("codebooks_sha256"))


_QUERIES = [op1_exact_dedup, op2_mix_sources, op3_simhash_dedup, op4_toxicity, op5_url_filters, op6_secret_scan,
            op7_sharding, op8_language_id, op9_embedding_dedup, op10_pack_sequences, op11_align_tokenizers,
            op12_format_chats, op13_vector_codes]


def queries() -> dict[str, QueryFn]:
    def bound(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run
    return {fn.__name__: bound(fn) for fn in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others hold a model, a graph search or a draw; they are tested against brute force."""
    return {"op1_exact_dedup": oracle.EXACT_DEDUP, "op5_url_filters": oracle.URL_FILTERS,
            "op6_secret_scan": oracle.SECRET_SCAN, "op12_format_chats": oracle.FORMAT_CHATS,
            "op13_vector_codes": oracle.VECTOR_CODES}
