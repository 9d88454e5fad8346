"""Where intermediate tables live: the folder every executor can reach."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where that is unset and all tasks run here (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keelsieve-")
        spark.conf.set("spark.checkpoint.dir", found)
        _MADE.append((spark, found))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _file(spark, path)
    return system.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    p, system = _file(spark, path)
    return [f.getPath().getName() for f in system.listStatus(p) if f.isDirectory()]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the driver's, whole."""
    p, system = _file(spark, path)
    stream = system.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's: written beside and moved, so that a reader finds the old or the new one."""
    p, system = _file(spark, path)
    beside, _ = _file(spark, path + ".new")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    system.delete(p, False)
    if not system.rename(beside, p):
        raise OSError(f"cannot write {path}")


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: cuts the lineage and survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, new_path(df.sparkSession, name))


def input_splits(df: DataFrame) -> int:
    """Input splits of a scan, known from its plan without running it."""
    return max(1, df.rdd.getNumPartitions())


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than there are cores, as small files do; else as it is.

    Worth a small shuffle before work that is heavy per row. Large tables are never touched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if input_splits(df) < cores else df


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass
