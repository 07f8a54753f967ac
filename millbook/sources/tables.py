"""The ``Tables`` bundle every operator reads from, and loaders for it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from millbook.sources.schemas import ERP_SCHEMAS


class Tables(Mapping):
    """Name -> DataFrame, built lazily.

    Entries are either DataFrames or zero-argument factories; a factory runs
    once on first access (planning only, no Spark job).
    """

    def __init__(self, entries: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self._entries: dict[str, DataFrame | Callable[[], DataFrame]] = dict(entries or {})
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._entries:
                raise KeyError(f"table {name!r} is not in this bundle")
            entry = self._entries[name]
            self._built[name] = entry if isinstance(entry, DataFrame) else entry()
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    def __iter__(self):
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def replace(self, **frames: DataFrame) -> "Tables":
        """A new bundle with some tables swapped (e.g. a new snapshot)."""
        merged: dict = {n: (self._built.get(n) or e) for n, e in self._entries.items()}
        merged.update(frames)
        return Tables(merged)


def load_tables(spark: SparkSession, directory: str, names: Iterable[str] | None = None,
                fmt: str = "parquet", skip_batch: str | None = None) -> Tables:
    """ERP tables stored as ``{directory}/{name}`` (parquet by default).

    A table that ``write_snapshot`` wrote is read at its current version, one
    that ``append_rows`` wrote with all its batches but ``skip_batch`` (what a
    failed attempt of the batch that is about to run may have left). Read with
    the explicit schema (no inference); column pruning and filter pushdown are
    left to Catalyst.
    """
    from millbook.sinks.writers import batch_paths, current_snapshot

    names = tuple(names or ERP_SCHEMAS)

    def reader(name: str) -> Callable[[], DataFrame]:
        def build() -> DataFrame:
            path = f"{directory}/{name}"
            return (spark.read.schema(ERP_SCHEMAS[name]).option("recursiveFileLookup", True).format(fmt)
                    .load(current_snapshot(spark, path) or batch_paths(spark, path, skip_batch)))
        return build

    return Tables({n: reader(n) for n in names})


def load_tables_jdbc(spark: SparkSession, url: str, properties: dict,
                     names: Iterable[str] | None = None, ranges: Mapping[str, Mapping] | None = None) -> Tables:
    """The same bundle read from a relational database through JDBC.

    ``ranges`` gives, per table, ``column``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``: the table is then read in that many slices of the
    column. The bounds only place the slices; no row is left out. A table
    without them is read in one task.
    """
    names = tuple(names or ERP_SCHEMAS)

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.jdbc(url=url, table=name, properties=properties, **dict((ranges or {}).get(name, {})))

    return Tables({n: reader(n) for n in names})
