"""The training-data pipeline over ``documents``: the stages in order, each one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millbook.llm import exact_dedup, mixing, packing, queries, simhash, toxicity
from millbook.plans.lineage import staged
from millbook.session import ship_package


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    ship_package(spark)
    model = queries.toxicity_model(docs, queries.read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one that stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest id."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus mixed to the source weights; a document may be left out or occur twice."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces and where they lie; a document that the mix repeats is packed as often."""
    ship_package(spark)
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [("toxicity", clean), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixed),
          ("best-fit packing", packed)]

#: SQL can express neither the trained model nor the graph search nor the online packer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
