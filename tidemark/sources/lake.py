"""The lake: Parquet by table, day and hour; scans that prune by time; listing, counts and backfill."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import paths
from tidemark.sources.snapshots import Store
from tidemark.sources.tables import ROWS, insert_ignore


def _as_lake(rows: DataFrame, ts: str) -> DataFrame:
    floats = [F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes]
    return rows.select(*floats, F.to_date(ts).alias("dt"), F.date_format(ts, "HH").alias("hour"))


def write_hourly(rows: DataFrame, root: str, table: str, now: datetime, catch_up_hours: int = 25, ts: str = "ingested_at") -> None:
    """The completed hours of the last `catch_up_hours` that the lake lacks, by ingestion time.

    Hours are written aside, a large one by several tasks in several files, and each is put in its place whole by one
    rename: what the lake has of an hour is all of it, and an hour that failed midway is written again next time.
    """
    end = now.replace(minute=0, second=0, microsecond=0)
    done = rows.where((F.col(ts) < F.lit(end)) & (F.col(ts) >= F.lit(end) - F.make_dt_interval(hours=F.lit(catch_up_hours))))
    have = slots(rows.sparkSession, root, table)
    new = _as_lake(done, ts)
    if have is not None:
        near = have.where(F.col("dt") >= F.lit((end - timedelta(hours=catch_up_hours)).date()))  # catch_up_hours slots and a day at most
        new = new.join(F.broadcast(near), ["dt", "hour"], "left_anti")
    spark, aside = rows.sparkSession, f"{root}/_staged/{table}-{uuid.uuid4().hex}"
    try:
        new.hint("rebalance", "dt", "hour").write.option("compression", "snappy").partitionBy("dt", "hour").parquet(aside)
        for hour in paths.folders(spark, aside, 2):  # catch_up_hours at most
            paths.publish(spark, f"{aside}/{hour}", f"{root}/raw/{table}/{hour}")
    finally:
        paths.delete(spark, aside)


def slots(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """dt, hour of what the lake has of a table."""
    files = listing(spark, f"{root}/raw/{table}")
    if files is None:
        return None
    return files.select(*path_parts(F.col("path"))[1:]).distinct()


def path_parts(path: Column) -> list[Column]:
    """table, dt and hour of an object's key."""
    found = lambda i: F.regexp_extract(path, r"/([a-z_]+)/dt=(\d{4}-\d{2}-\d{2})/hour=(\d{2})/", i)
    return [found(1).alias("table"), F.to_date(F.nullif(found(2), F.lit(""))).alias("dt"), found(3).alias("hour")]


def listing(spark: SparkSession, root: str) -> DataFrame | None:
    """path and bytes of the objects under a root, listed without reading them; None if there are none."""
    if not paths.exists(spark, root):
        return None
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path", F.col("length").alias("bytes"))


def scan(spark: SparkSession, root: str, table: str, start: datetime | None = None, end: datetime | None = None, schema: StructType | None = None) -> DataFrame:
    """The table's rows; with bounds, only the partitions of their hours are read.

    Columns that a file lacks are null with a `schema`; without one, the footers of all files are read to unite theirs.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    rows = reader.parquet(f"{root}/raw/{table}")
    slot = F.concat(F.col("dt").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0"))
    if start is not None:
        rows = rows.where((F.col("dt") >= F.lit(start.date())) & (slot >= start.strftime("%Y-%m-%d%H")))
    if end is not None:
        rows = rows.where((F.col("dt") <= F.lit(end.date())) & (slot <= end.strftime("%Y-%m-%d%H")))
    return rows


def counts(rows: DataFrame) -> DataFrame:
    """Rows and first and last ingestion by city, most first."""
    return rows.groupBy("city").agg(F.count("*").alias("n"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at")).orderBy(F.desc("n"), "city")


def backfill(spark: SparkSession, root: str, table: str, path: str, start: date, end: date, key: str = "event_id", dry_run: bool = False) -> tuple[int, int]:
    """Puts the lake's rows of a range of days into a stored table, once each; how many were tried and added. NaN becomes null."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/raw/{table}").where(F.col("dt").between(F.lit(start), F.lit(end))).drop("dt", "hour")
    rows = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])
    tried = rows.count()
    if dry_run:
        return tried, 0
    store = Store(spark, path)
    before = store.count(ROWS)
    insert_ignore(rows, path, key)
    return tried, store.count(ROWS) - before


def write_monthly(mart: DataFrame, path: str) -> None:
    """The replica for wide scans: by month, sorted by city and hour within files."""
    rows = mart.withColumn("month", F.date_format("hour_ts", "yyyyMM"))
    rows.repartition("month", "city").sortWithinPartitions("month", "city", "hour_ts").write.mode("overwrite").partitionBy("month").parquet(path)
