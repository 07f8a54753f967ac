"""Shared text pieces: the six ASCII white-space characters, row keys and row ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.plans.lineage import staged

#: space, \t \n \v \f \r (fixed value: the class [\x20\x09-\x0D])
WHITESPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(df: DataFrame, text_col: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text_col).cast(T.StringType()), F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until no column in ``taken`` has it (case ignored)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def row_key(docs: DataFrame, text_col: str, id_col: str = "doc_id") -> Column:
    """SHA-256 of a row's id (where ``docs`` has that column) and text: it names the row across reads.

    Rows equal in both share it. Nothing is written for it, and it does not
    depend on how a table is split, as ids given at a scan would.
    """
    text = F.col(text_col).cast(T.StringType())
    own = F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), text))
    if id_col in docs.columns:
        own = F.concat(F.coalesce(F.col(id_col).cast(T.StringType()), F.lit("null")), own)
    return F.sha2(own, 256)


def rows_of(docs: DataFrame, keys: DataFrame, text_col: str, once: bool) -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys`` (column ``key``); of rows that share a key only one with ``once``."""
    name = fresh("row_key", docs.columns)
    kept = docs.withColumn(name, row_key(docs, text_col)).join(
        keys.select(F.col("key").alias(name)), name, "left_semi")
    return (kept.dropDuplicates([name]) if once else kept).drop(name)


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` staged with a unique row id, and that column's name.

    Ids that only exist in a plan change when it is evaluated again over other
    splits; staged ones do not, and they also tell repeated rows apart.
    """
    rid = fresh("row_id", docs.columns)
    return staged(docs.withColumn(rid, F.monotonically_increasing_id()), "rows"), rid
