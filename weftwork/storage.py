"""Reading tables and placing intermediate results where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only on a local master, as in tests, a temporary folder is made
    where that is unset and becomes the checkpoint folder of the session; any other master is refused, since its
    executors would not see that folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(held: DataFrame) -> None:
    """Delete the files of a table from ``cut``, once everything that reads it is itself written."""
    file = held._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        remove_path(held.sparkSession, file.get())


@contextmanager
def short_shuffles(spark: SparkSession):
    """Within it the shuffle files of a job go when the job ends, not when the driver happens to collect its garbage.

    For eager steps (``cut``, ``count``) of an operator whose shuffles together are larger than its input.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table written by an operator."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by an operator, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_file(uri: str) -> pa.Table:
    """One Parquet file of the shared folder, read in a task; partition columns of its path are left out."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    with system.open_input_file(path) as f:
        return pq.read_table(f)
