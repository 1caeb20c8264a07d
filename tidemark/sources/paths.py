"""The folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: For local masters only (tests, a laptop); a cluster names its folder in spark.checkpoint.dir.
LOCAL_SHARED = "/tmp/checkpoints/tidemark"


def shared_folder(spark: SparkSession) -> str:
    """As spark.checkpoint.dir of the session names it; a local one for a local master where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet under the shared folder and read again.

    Cuts the lineage: a lost executor costs the reading of a file, not the job that made it. `clear` removes what an
    application has written.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *jobs: Callable[[], T]) -> list[T]:
    """Runs jobs that do not wait for each other at the same time; their results, once all have ended."""
    if len(jobs) == 1:
        return [jobs[0]()]
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [r.result() for r in running]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes the folder `path` and all that is in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; call it when no result is read any more."""
    delete(spark, scratch(spark))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with its file system: as the driver means it, wherever it is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(where).toString()


def publish(spark: SparkSession, new: str, path: str) -> bool:
    """Puts the folder `new` at `path` by one rename, if nothing is there; whether it did."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(path).getParent())
    return not fs.exists(jvm.Path(path)) and fs.rename(jvm.Path(new), jvm.Path(path))


def folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The folders `depth` levels below `path`, by their names from there; none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName()[:1] not in "._"]
    return names if depth == 1 else [f"{n}/{below}" for n in names for below in folders(spark, f"{path}/{n}", depth - 1)]
