"""Lineage control: staged tables in the shared folder.

They are written into the folder the cluster names in ``spark.checkpoint.dir``, which
every executor can read, so losing an executor later never loses the data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from millbook.session import checkpoint_dir_of, ensure_checkpoint_dir

_STAGE_FOLDER = "millbook-stage"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    ``spark.checkpoint.dir`` wins. A session on a local master without one
    gets a scratch folder of its own (driver and tasks are one process there);
    on a cluster a missing setting is an error, because a machine-local folder
    would be invisible to the other executors.
    """
    target = checkpoint_dir_of(spark)
    if not target:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        target = tempfile.mkdtemp(prefix="millbook-ckpt-")
    ensure_checkpoint_dir(spark, fallback=target)
    return target.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back: staged as a compact table.

    A checkpoint of rows keeps a second, serialised copy in the executors' stores
    while it is written, both several times as large, and every reader reads all columns.
    """
    return staged(df, "decided")


def staged(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader over it.

    Like a checkpoint, but compact (columnar, compressed) and readable by
    column; a reader keeps no partitioning of the writer, so a later join
    shuffles both sides itself and AQE can split a hot key on either. ``by``: a
    column to make folders of, so that a filter on it reads only those.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_STAGE_FOLDER}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table below the session's shared folder.

    For the end of a job, when all results that read them have been written.
    """
    target = checkpoint_dir_of(spark)
    if target:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{_STAGE_FOLDER}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
