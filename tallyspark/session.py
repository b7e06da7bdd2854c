"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for written tables; a folder of our own only in local runs."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a shared folder before running on a cluster")
        folder = tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    A written table carries its size, so later joins can choose their strategy from it. All tables of an application lie in
    one folder, which is removed when the application ends; ``discard`` removes one that is no longer read.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joins with it shuffle and sort, whatever sizes Spark measured.

    Files of keys and repeated texts are a small part of their rows in memory, and a broadcast gathers these in the driver.
    """
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``cut``; whatever still reads them fails from now on."""
    for df in tables:
        remove(df.sparkSession, df._cut_path)


_FOLDERS: set[str] = set()


def _run_folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/cut-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_at_end, spark, path)
    return path


def _at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def run_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for something that lasts as long as the application, and goes with it."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it, wherever Spark can reach it."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def folders(spark: SparkSession, path: str, complete: bool = False) -> list[str]:
    """Names of the folders in a folder, none if it does not exist; ``complete``: those that Spark finished writing."""
    target, system = _file_system(spark, path)
    if not system.exists(target):
        return []
    inner = [status.getPath() for status in system.listStatus(target) if status.isDirectory()]
    marked = [p for p in inner if not complete or system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [p.getName() for p in marked]


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
