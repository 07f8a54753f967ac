"""Secret scans over an incremental blob ledger.

A text is a blob, addressed by its content (SHA-256); the rows that hold it are
its paths. The ledger records which (blob, rule version) pairs have been
scanned and what was found in them. A scan groups the rows into distinct blobs
(one text per blob, combined map-side), drops the pairs the ledger knows, runs
the rules on the rest, appends to the ledger and joins all findings back to
every path. A copy is scanned once, a rescan of old versions costs no regular
expression, and a new rule version scans every blob anew.

Spans are found with built-in expressions: the pieces between matches and the
matches alternate, so a running sum of their lengths gives every start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millbook.llm.text import fresh, text_of
from millbook.plans.lineage import staged


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost non-overlapping matches whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


#: The kinds, their patterns and least lengths.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones need no match
)
RULE_VERSION = "1"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def address(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` of every row of ``blobs`` (``blob, text``); spans are ``(start, kind, end)``, sorted.

    ``kind`` is the rule's place in ``rules``; positions are code points, the
    end exclusive. One regular-expression pass finds the texts with a match;
    only those are cut, of the others the address alone goes on. The running sum is a window per blob and kind, over
    lengths alone.
    """
    def cut(i: int, r: Rule) -> Column:
        pattern = F.lit(r.pattern)
        return F.when(F.regexp_like("text", pattern), F.struct(
            F.lit(i).alias("kind"),
            F.transform(F.split("text", r.pattern, -1), F.char_length).alias("gaps"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.char_length).alias("lengths"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(r.group)), F.char_length).alias("values")))

    found = blobs.select("blob", F.explode_outer(F.array_compact(F.array(*[cut(i, r) for i, r in enumerate(rules)]))).alias("k"))
    matches = found.select("blob", F.col("k.kind").alias("kind"), F.posexplode_outer(
        F.arrays_zip(F.slice(F.col("k.gaps"), F.lit(1), F.size("k.lengths")).alias("gap"),
                     F.col("k.lengths").alias("length"), F.col("k.values").alias("value"))).alias("i", "m"))
    matches = matches.select("blob", "kind", "i", "m.gap", "m.length", "m.value")
    so_far = F.sum(F.col("gap") + F.col("length")).over(
        Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    placed = matches.withColumn("end", so_far).select("blob", F.when(F.col("value") >= least, F.struct(
        (F.col("end") - F.col("length")).alias("start"), "kind", "end")).alias("span"))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list("span")).cast(_SPAN).alias("spans"))


class BlobLedger:
    """Scanned (blob, rule version) pairs with their findings: a table at ``path``, one folder per scan.

    A scan's folder is written once under its ``batch`` name; running the same
    batch again after a failure replaces it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame | None:
        """All entries, or None for a ledger without a path."""
        if self.path is None:
            return None
        empty = self.spark.createDataFrame([], f"blob string, rule_version string, spans {_SPAN}")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/batch=*")

    def append(self, entries: DataFrame, batch: str) -> DataFrame:
        """Write a scan's entries; returns a reader over them."""
        if self.path is None:
            return staged(entries, "ledger")
        target = f"{self.path}/batch={batch}"
        entries.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(entries.schema).parquet(target)


def scan(docs: DataFrame, ledger: BlobLedger | None = None, batch: str = "0", text_col: str = "text",
         rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """``docs`` with columns ``blob`` and ``spans`` (empty if none) beside their own, and the new ledger entries.

    Without a ledger every blob is new. A null text is an empty one; repeated rows
    each get their blob's spans; an empty table gives no rows and no entries. If
    ``docs`` has columns of those names, underscores are appended to the new ones.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    text = text_of(docs, text_col)
    rows, known = docs.select(address(text).alias("blob"), text.alias("text")), ledger.entries()
    if known is not None:
        known = known.filter(F.col("rule_version") == rule_version).select("blob", "spans")
        if known.isEmpty():
            known = None
        else:  # addresses alone meet the ledger; only texts it does not know move
            unseen = staged(rows.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"), "unseen")
            rows = rows.limit(0) if unseen.isEmpty() else rows.join(unseen, "blob", "left_semi")
    entries = scan_blobs(rows.groupBy("blob").agg(F.any_value("text").alias("text")), rules)
    if ledger.path is None:  # nothing will be looked up again: the entries without findings need not be kept
        entries = entries.filter(F.size("spans") > 0)
    new = ledger.append(entries.withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "spans"), batch)
    findings = new.select("blob", "spans").filter(F.size("spans") > 0)
    if known is not None:  # a blob that two scans met at once has an entry of each; the table is written so that
        # shuffles alone feed the join with the paths, and a blob of very many paths can be split
        both = findings.unionByName(known.filter(F.size("spans") > 0)).groupBy("blob").agg(F.max("spans").alias("spans"))
        findings = staged(both, "findings")
    blob, spans, own = (fresh(n, docs.columns) for n in ("blob", "spans", "address"))
    paths = docs.withColumn(blob, address(text))
    found = findings.select(F.col("blob").alias(own), F.col("spans").alias(spans))
    joined = paths.join(found, F.col(blob) == F.col(own), "left").drop(own)
    return joined.withColumn(spans, F.coalesce(spans, F.array().cast(_SPAN))), new


def joined_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
