"""Tables written to the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it
back.  The folder is the one the cluster names in ``spark.checkpoint.dir``.
Only where that is unset and everything runs in one process (tests, a laptop) a
folder of our own is set; on a cluster its parts would lie on many disks, so
there an unset folder is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="loomgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    staged = spark.read.schema(df.schema).parquet(path)
    staged._loomgrid_path = path
    return staged


def release_at_exit(spark: SparkSession, path: str) -> None:
    """A folder written by other means, deleted with the staged tables."""
    _written[path] = spark


def release(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_loomgrid_path", None)
    if path in _written:
        _delete(_written.pop(path), path)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is already gone, and its folder with it
            pass
