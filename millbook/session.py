"""Spark session settings used by tests, the bench and the examples.

Cluster runs bring their own session; the library only reads settings from it.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job of this library assumes.
#  - UTC session zone: date_trunc / timestamp casts agree with the SQL oracle.
#  - AQE: runtime coalescing, skew-join splitting and broadcast conversion
#    (a side is broadcast only when its measured size is under the threshold;
#    otherwise the sort-merge plan stays).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "millbook", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("MILLBOOK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_PACKAGE_ZIP: str | None = None
_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``millbook`` importable in the Python workers of this SparkContext.

    The stock folds run library functions inside tasks (``mapInPandas``,
    ``applyInPandasWithState``); executors import them from the zip that
    ``addPyFile`` distributes. Done once per process and context; a cluster
    that installs the package on its executors does not need it.
    """
    global _PACKAGE_ZIP
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    if _PACKAGE_ZIP is None:
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        fd, path = tempfile.mkstemp(prefix="millbook-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
            for folder, _dirs, files in os.walk(pkg_dir):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        zf.write(full, os.path.relpath(full, root))
        _PACKAGE_ZIP = path
    sc.addPyFile(_PACKAGE_ZIP)
    _SHIPPED.add(key)


def checkpoint_dir_of(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""
    value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not value:
        value = spark.sparkContext.getCheckpointDir()
    return value or None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Point ``SparkContext`` at ``spark.checkpoint.dir``.

    The session setting wins. ``fallback`` is used only when the setting is
    unset (tests pass a scratch folder); with neither, nothing is set and the
    caller keeps plain lineage, which is deterministic and recomputable.
    """
    target = checkpoint_dir_of(spark) or fallback
    if target:
        spark.sparkContext.setCheckpointDir(target)
    return target
