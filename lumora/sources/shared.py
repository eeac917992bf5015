"""Results written into the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where the session names none and runs on one machine, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumora-"))
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read again; drop() deletes the files once nothing reads them any more."""
    path = f"{shared_dir(df.sparkSession)}/lumora-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 1 << 20):
    """What is run meanwhile hands rows to Python in Arrow batches that end at some size bytes: a row more may be in one, so that wide rows come one by one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drop(*frames: DataFrame) -> None:
    """Deletes what kept() wrote for these frames."""
    for df in frames:
        delete(df.sparkSession, df.kept_path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder of the shared file system, whichever that is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The size of the files that df reads."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
