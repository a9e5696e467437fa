"""Where intermediate tables go, and the session settings the package assumes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Settings for a cluster session; none is required for right results.
RECOMMENDED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

_scratch: dict[str, list[str]] = {}


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with the recommended settings; settings made afterwards take precedence."""
    return builder.config(map=dict(RECOMMENDED_SETTINGS))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    A local folder is taken only where the setting is missing and driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="courtside-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/courtside-{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch path of this session; to be called when its results are no longer read."""
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        files, folder = hadoop_path(spark, path)
        files.delete(folder, True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a location, by the session's own configuration."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file unless it is there already; False if another writer was first."""
    files, file = hadoop_path(spark, path)
    files.mkdirs(file.getParent())
    try:
        stream = files.create(file, False)
    except Py4JJavaError as error:
        if files.exists(file):
            return False
        raise error
    stream.write(bytearray(content.encode()))
    stream.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    files, file = hadoop_path(spark, path)
    stream = files.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    files, folder = hadoop_path(spark, path)
    if not files.exists(folder):
        return []
    return [status.getPath().getName() for status in files.listStatus(folder)]


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block, then as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and fixes the row placement."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint(eager=True)


def staged(rows: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, for results used several times."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
