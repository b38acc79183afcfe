"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir. A local session that names none
    gets a temporary folder of its own; a cluster session must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="capture-tables-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        folder = f"file://{_own['dir']}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already; the folder then stays
        return


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: what is numbered or dealt by ranges
    stays as it is, and a lost executor costs nothing that was finished. An application's folder
    goes when its driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _stored:
        _stored[app] = shared_path(spark, "tables")
        atexit.register(_remove, spark, _stored[app])
    path = f"{_stored[app]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of Parquet input for a partition of a shuffle, at most; of a shuffle's bytes for a task that
#: takes several; and of a file for a task.
PART_BYTES, TASK_BYTES, SPLIT_BYTES = 2 << 20, 8 << 20, 32 << 20


def deal_finely(spark: SparkSession, path: str) -> None:
    """Let shuffles have as many partitions as the input at `path` asks for, so that a task's memory stays as
    it is while the input grows: several sorts and hash tables of one stage are held at once. Counts
    are raised and sizes lowered in the session, never the other way; AQE joins what is small."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    parts = -(-size // PART_BYTES)
    if parts <= spark.sparkContext.defaultParallelism:
        return
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < parts:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
