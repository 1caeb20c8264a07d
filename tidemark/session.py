"""Session settings that the feature jobs rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; `more` are settings with underscores for dots."""
    builder = SparkSession.builder.appName("tidemark")
    builder = builder.master(master) if master else builder
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def in_utc(spark: SparkSession) -> SparkSession:
    """Pins the session to UTC: truncating and extracting from timestamps depend on it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def stateful(spark: SparkSession) -> SparkSession:
    """Pins the session to the state store that stateful streams need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key) != SETTINGS[key]:
        spark.conf.set(key, SETTINGS[key])
    return spark


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Within, queries of this session are not planned anew as they run: for those of few rows and without shuffles, where that takes longer than the tasks."""
    key = "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)
