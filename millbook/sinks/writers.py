"""Sinks: report output, appended rows, and versioned table snapshots.

Plain parquet has no MERGE, so a changed table is written whole to a new
version folder. A pointer per version, written once after the folder is
complete, names it; the current version is the latest pointer. Nothing that
a pointer names is ever written again, and no moment is without a pointer.

A table kept in buckets of a key's hash is rewritten in part: a version's
pointer lists one folder per bucket, and a batch writes folders for the buckets
its keys fall into only; the others are carried over from the version before.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTERS = "_pointers"


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A report result, replacing what was at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", batch_id: str | None = None) -> None:
    """Rows added to a table folder (the INSERT of W1, W12-W14, W16).

    With ``batch_id`` the rows go to ``{path}/load_id=<id>``, replaced when the
    same batch is written again, so rerunning a failed job adds nothing
    twice. Without it, a plain append. ``load_tables`` reads both.
    """
    if batch_id is None:
        df.write.mode("append").format(fmt).save(path)
    else:
        df.write.mode("overwrite").format(fmt).save(os.path.join(path, f"load_id={batch_id}"))


def _children(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """What ``pattern`` captures in the names below ``folder``; a folder that is confirmed absent has none.

    Every other failure raises: an unreadable pointer is not an absent one.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return [m[1] for n in names if (m := re.fullmatch(pattern, n))]


def batch_paths(spark: SparkSession, path: str, skip: str | None) -> str | list[str]:
    """What to read of an appended table: all of it, or all but the batch ``skip``."""
    own = f"load_id={skip}"
    names = _children(spark, path, r"([^_.].*)") if skip is not None else []
    return [os.path.join(path, n) for n in names if n != own] if own in names else path


def _done(spark: SparkSession, folder: str) -> bool:
    return bool(_children(spark, folder, "(_SUCCESS)"))


def _pointed(spark: SparkSession, root: str) -> list[int]:
    """Versions with a complete pointer, oldest first."""
    found = sorted(int(v) for v in _children(spark, os.path.join(root, _POINTERS), r"p=(\d+)"))
    return [v for v in found if _done(spark, os.path.join(root, _POINTERS, f"p={v}"))]


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version of a snapshot table, or None where no version was ever published."""
    versions = _pointed(spark, root)
    return os.path.join(root, f"v={versions[-1]}") if versions else None


def published(spark: SparkSession, root: str, batch_id: str) -> str | None:
    """Folder of the version that ``batch_id`` published, or None."""
    versions = _pointed(spark, root)
    if not versions:
        return None
    rows = (spark.read.schema("batch_id string, p int").option("basePath", os.path.join(root, _POINTERS))
            .json([os.path.join(root, _POINTERS, f"p={v}") for v in versions]))
    hit = rows.filter(rows["batch_id"] == batch_id).select("p").head()
    return os.path.join(root, f"v={hit[0]}") if hit else None


def _next_version(spark: SparkSession, root: str) -> int:
    """A number above every version folder there is."""
    return max([int(v) for v in _children(spark, root, r"v=(\d+)")] + [0]) + 1


def write_snapshot(df: DataFrame, root: str, fmt: str = "parquet", batch_id: str | None = None) -> str:
    """Write ``df`` as the next version under ``root`` and publish it.

    The version is numbered after every version folder there is, so what a
    failed attempt left is never reused and never read. ``batch_id`` is
    recorded in the pointer (see :func:`published`). Old versions stay until
    they are removed explicitly. One writer at a time: two that race for a
    number fail instead of overwriting.
    """
    spark = df.sparkSession
    version = _next_version(spark, root)
    target = os.path.join(root, f"v={version}")
    df.write.mode("errorifexists").format(fmt).save(target)
    (spark.createDataFrame([(batch_id,)], "batch_id string").coalesce(1).write.mode("errorifexists")
     .json(os.path.join(root, _POINTERS, f"p={version}")))
    return target


def read_snapshot(spark: SparkSession, root: str, schema=None, fmt: str = "parquet") -> DataFrame:
    path = current_snapshot(spark, root)
    if path is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


# --- buckets: versions that rewrite only what changed --------------------------------------
BUCKETS = 64
_MANIFEST = "batch_id string, bucket int, buckets int, folder string"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str) -> list:
    """The current version's rows: one per bucket that holds rows, at least one row; empty without a version."""
    versions = _pointed(spark, root)
    if not versions:
        return []
    path = os.path.join(root, _POINTERS, f"p={versions[-1]}")
    return spark.read.schema(_MANIFEST).json(path).collect()  # at most one row per bucket


def write_buckets(df: DataFrame, root: str, key: str, buckets: int = BUCKETS, batch_id: str | None = None,
                  only: list[int] | None = None, files: int = 1) -> list[int]:
    """Write ``df`` as the next version of a bucketed table and publish it; returns the buckets written.

    Without ``only`` ``df`` is the whole table. With it ``df`` holds all rows of
    those buckets (see :func:`touched_buckets`) and the others are carried over,
    so a batch costs what its buckets hold. A reader of an older version keeps
    its folders, and an attempt that failed left folders nothing points at.
    ``files``: into how many files, and so tasks, a bucket is written.
    """
    spark, before = df.sparkSession, _manifest(df.sparkSession, root)
    if only is not None:
        buckets = before[0]["buckets"]
    version = _next_version(spark, root)
    target = os.path.join(root, f"v={version}")
    name = "_bucket"
    salt = F.pmod(F.xxhash64(F.col(key), F.lit(files)), F.lit(files))
    (df.withColumn(name, bucket_of(key, buckets)).repartition(name, salt).write.mode("errorifexists").partitionBy(name).parquet(target))
    written = sorted(int(b) for b in _children(spark, target, rf"{name}=(\d+)"))
    if only is not None and not set(written) <= set(only):
        raise ValueError(f"rows of buckets {sorted(set(written) - set(only))}, which were not to be replaced")
    rows = [(batch_id, b, buckets, os.path.join(f"v={version}", f"{name}={b}")) for b in written]
    if only is not None:
        rows += [(batch_id, r["bucket"], buckets, r["folder"]) for r in before if r["folder"] and r["bucket"] not in set(only)]
    (spark.createDataFrame(rows or [(batch_id, None, buckets, None)], _MANIFEST).coalesce(1).write.mode("errorifexists")
     .json(os.path.join(root, _POINTERS, f"p={version}")))
    return written


def touched_buckets(changes: DataFrame, key: str, root: str) -> list[int]:
    """The buckets of the table at ``root`` that the keys of ``changes`` fall into."""
    buckets = _manifest(changes.sparkSession, root)[0]["buckets"]
    found = changes.select(bucket_of(key, buckets).alias("b")).distinct().collect()  # at most one row per bucket
    return sorted(r["b"] for r in found)


def read_buckets(spark: SparkSession, root: str, schema, only: list[int] | None = None) -> DataFrame:
    """The current version of a bucketed table, or of some of its buckets."""
    rows = _manifest(spark, root)
    if not rows:
        raise FileNotFoundError(f"no version under {root}")
    folders = [os.path.join(root, r["folder"]) for r in rows if r["folder"] and (only is None or r["bucket"] in set(only))]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
