"""Case-insensitive substring search on large tables: trigram postings instead of a scan.

``ILIKE '%text%'`` has no prefix a sorted file could use, so a listing's search
reads the whole table. A posting table holds, for every row and searched column,
the distinct three-letter runs of the lower-cased value, sorted by trigram within
a fixed number of folders. A search looks up the rarest trigrams of the pattern's
literal runs, keeps the rows that have all of them, and verifies these with the
same ``ILIKE``, so the result is that of the scan, whatever the postings also hold.

Patterns without a literal run of three letters, and those whose rarest trigram
is in a large share of the rows, are scanned. Postings are only ever added:
:meth:`TrigramIndex.add` takes new and changed rows; postings of values a row no
longer has cost a verification and nothing else.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millbook.functions.filters import any_contains

SLOTS = 64          # folders of the posting table
PROBED = 4          # trigrams looked up per column, the rarest of the pattern's
SCAN_SHARE = 0.1    # of the rows: beyond it reading the table is cheaper
FILE_ROWS = 1 << 20  # rows whose postings share one file of a folder
PUSHED_KEYS = 2_000  # candidates passed to the scan as literals; more go through a semi-join


def trigrams(text: Column) -> Column:
    """Distinct three-letter runs of the lower-cased text (code points), in no order; null has none."""
    letters = F.split(F.lower(text.cast("string")), "")
    count = F.greatest(F.size(letters) - 2, F.lit(0))
    # three slices side by side: a lambda that names ``letters`` would split the text again for every run
    first, second, third = (F.slice(letters, at, count) for at in (1, 2, 3))
    runs = F.zip_with(F.zip_with(first, second, lambda a, b: F.concat(a, b)), third, lambda ab, c: F.concat(ab, c))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def literal_runs(pattern: str) -> list[str] | None:
    """What a value must contain to match ``%pattern%``: its runs without live wildcards; None if it is no valid pattern."""
    if re.search(r"(?<!\\)(?:\\\\)*\\(?![\\%_])", pattern):
        return None
    runs = re.split(r"[%_]", re.sub(r"\\([\\%_])", lambda m: {"\\": "\0", "%": "\1", "_": "\2"}[m[1]], pattern))
    return [r.replace("\0", "\\").replace("\1", "%").replace("\2", "_") for r in runs if r]


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


@dataclass
class TrigramIndex:
    """Postings of ``columns`` of one table under ``path``; ``key`` is its long id column."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    key: str = "id"

    def add(self, rows: DataFrame) -> None:
        """Postings of ``rows``: the whole table at first, later new and changed rows.

        The rows are dealt by hash before they are taken apart, so a small file of
        many rows is work for every task. A folder's postings are dealt by key over
        a file per ``FILE_ROWS`` rows, each sorted by trigram, so a trigram of every
        row is spread over as many files as it needs.
        """
        count = rows.count()
        files = max(1, -(-count // FILE_ROWS))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(F.col(self.key).cast("long").alias("key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(self.columns)])
        dealt = dealt.repartition(max(tasks, 4 * files), *dealt.columns)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), trigrams(F.col(f"_c{i}")).alias("grams"))
                                   for i, c in enumerate(self.columns)]))
        grams = dealt.select("key", each.alias("x")).select("key", "x.column", F.explode("x.grams").alias("gram"))
        batch = uuid.uuid4().hex
        file = F.pmod(F.xxhash64("key"), F.lit(files))
        (grams.withColumn("slot", _slot(F.col("gram"))).repartition(max(tasks, 16 * files), "slot", file)
         .sortWithinPartitions("slot", "gram", "key").write.partitionBy("slot").parquet(f"{self.path}/postings/batch={batch}"))
        (self._read(f"{self.path}/postings", f"{self.path}/postings/batch={batch}").groupBy("slot", "column", "gram").count()
         .write.parquet(f"{self.path}/counts/batch={batch}"))
        self.spark.createDataFrame([(count,)], "rows long").coalesce(1).write.parquet(f"{self.path}/rows/batch={batch}")

    def _read(self, base: str, *paths: str) -> DataFrame:
        return self.spark.read.schema("key long, column string, gram string, batch string, slot int").option(
            "basePath", base).parquet(*(paths or (base,)))

    def _rarest(self, runs: list[str]) -> dict[str, list[tuple[str, int]]] | None:
        """Column -> the trigrams of ``runs`` to look up, if it has all of them; None: scan."""
        every = F.array_distinct(F.flatten(F.array(*[trigrams(F.lit(r)) for r in runs])))
        grams = self.spark.range(1).select(F.explode(every).alias("gram")).select(
            "gram", _slot(F.col("gram")).alias("slot")).collect()
        slot_of = {r["gram"]: r["slot"] for r in grams}
        wanted, slots = list(slot_of), sorted(set(slot_of.values()))
        counts = self.spark.read.schema("slot int, column string, gram string, count long").parquet(f"{self.path}/counts")
        found = counts.filter(F.col("slot").isin(slots) & F.col("gram").isin(wanted)).groupBy("column", "gram").agg(
            F.sum("count").alias("n")).collect()  # at most the pattern's trigrams times the columns
        total = self.spark.read.schema("rows long").parquet(f"{self.path}/rows").agg(F.sum("rows")).head()[0] or 0
        probes = {}
        for column in self.columns:
            own = {r["gram"]: r["n"] for r in found if r["column"] == column}
            if len(own) < len(wanted):
                continue  # some trigram is in no value of this column
            rare = sorted(own, key=lambda g: (own[g], g))[:PROBED]
            if own[rare[0]] > SCAN_SHARE * total:
                return None
            probes[column] = [(g, slot_of[g]) for g in rare]
        return probes

    def candidates(self, text: str) -> DataFrame | None:
        """``key`` of the rows that may match ``text`` in some column (all that do are there); None: scan."""
        lowered = self.spark.sql("select lower(:t) as t", args={"t": text}).head()["t"]  # as ILIKE lowers it
        runs = [r for r in literal_runs(lowered) or () if len(r) >= 3]
        probes = self._rarest(runs) if runs else None
        if probes is None:
            return None
        found = self.spark.createDataFrame([], "key long")
        for column, chosen in probes.items():
            grams, slots = [g for g, _ in chosen], sorted({s for _, s in chosen})
            hits = self._read(f"{self.path}/postings").filter(
                F.col("slot").isin(slots) & F.col("gram").isin(grams) & (F.col("column") == column))
            found = found.unionByName(hits.groupBy("key").agg(F.countDistinct("gram").alias("n"))
                                      .filter(F.col("n") == len(grams)).select("key"))
        return found.distinct()


def indexed_search(df: DataFrame, columns: list[str], text: str, indexes: list[tuple[str, TrigramIndex]]) -> DataFrame:
    """``df`` where some of ``columns`` contains ``text``, as ``any_contains`` would filter it.

    ``indexes`` pairs a key column of ``df`` with the index of the table it comes
    from; together they cover ``columns``. Few candidates reach the scan as
    literals on those key columns, more as semi-joins; if an index wants a scan,
    all is scanned.
    """
    verify = any_contains(columns, text)
    found = [(key, index.candidates(text)) for key, index in indexes]
    if any(keys is None for _, keys in found):
        return df.filter(verify)
    literals = []
    for key, keys in found:
        some = [r["key"] for r in keys.limit(PUSHED_KEYS + 1).collect()]  # bounded by PUSHED_KEYS
        if len(some) > PUSHED_KEYS:
            break
        literals.append(F.col(key).isin(some))
    else:
        hit = literals[0]
        for more in literals[1:]:
            hit = hit | more
        return df.filter(hit).filter(verify)
    flagged = df
    for i, (key, keys) in enumerate(found):
        flagged = flagged.join(keys.select(F.col("key").alias(f"_key{i}")), F.col(key) == F.col(f"_key{i}"), "left")
    marks = [F.col(f"_key{i}").isNotNull() for i in range(len(found))]
    hit = marks[0]
    for more in marks[1:]:
        hit = hit | more
    return flagged.filter(hit).select(*df.columns).filter(verify)
