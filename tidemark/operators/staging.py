"""Staging: ingest windows, de-duplication, reject logging and hourly aggregates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from tidemark.functions.scalar import failed_checks, hour_of


def ingest_window(now: datetime, days: int = 30) -> tuple[datetime, datetime]:
    """The last `days` up to the start of the current hour."""
    end = now.replace(minute=0, second=0, microsecond=0)
    return end - timedelta(days=days), end


def ingested(rows: DataFrame, start: datetime, end: datetime, column: str = "ingested_at") -> DataFrame:
    """Rows with start <= column < end; the filter reaches the scan."""
    return rows.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def dedup(rows: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("ingested_at", "id"), keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key. All null keys count as one, unless `keep_null_keys`.

    A minimum of (order, row) by key rather than a window: it combines on the map side, so a key with many rows
    (as the null key may be) is no burden for one task.
    """
    rank = F.struct(*order)
    pick = lambda part: part.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), rank).alias("row")).select("row.*")
    if not keep_null_keys:
        return pick(rows)
    return pick(rows.where(F.col(key).isNotNull())).unionByName(rows.where(F.col(key).isNull()))


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(order)).alias("row")).select("row.*")


def classify_demand(rows: DataFrame) -> DataFrame:
    """`rows` with reject_reason, null for clean ones."""
    return rows.withColumn("reject_reason", failed_checks({f"null_{c}": F.col(c).isNull() for c in ("city", "event_type", "sim_ts", "quantity")}))


def classify_weather(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reject_reason", failed_checks({f"null_{c}": F.col(c).isNull() for c in ("city", "polled_at")}))


def rejects(classified: DataFrame, source_table: str) -> DataFrame:
    """The reject log of classified rows."""
    return classified.where(F.col("reject_reason").isNotNull()).select(F.lit(source_table).alias("source_table"), F.col("id").alias("source_id"), "event_id", "reject_reason")


def demand_hourly(classified: DataFrame) -> DataFrame:
    """city, hour_ts, total_demand, event_count, avg_temp_c of the clean rows."""
    return (
        classified.where(F.col("reject_reason").isNull())
        .groupBy("city", hour_of(F.col("sim_ts")).alias("hour_ts"))
        .agg(F.sum("quantity").alias("total_demand"), F.count("*").cast("int").alias("event_count"), F.avg("temperature_c").alias("avg_temp_c"))
    )


def weather_hourly(classified: DataFrame) -> DataFrame:
    """city, hour_ts, means of temperature and humidity, sum of precipitation."""
    return (
        classified.where(F.col("reject_reason").isNull())
        .groupBy("city", hour_of(F.col("polled_at")).alias("hour_ts"))
        .agg(F.avg("temperature_c").alias("temperature_c"), F.avg("humidity_pct").alias("humidity_pct"), F.sum("precip_mm").alias("precip_mm"))
    )


def stage_demand(raw: DataFrame, start: datetime, end: datetime) -> tuple[DataFrame, DataFrame]:
    """Hourly demand and the reject log of what was ingested in a window."""
    classified = classify_demand(dedup(ingested(raw, start, end)))
    return demand_hourly(classified), rejects(classified, "demand_events")


def stage_weather(raw: DataFrame, start: datetime, end: datetime) -> tuple[DataFrame, DataFrame]:
    classified = classify_weather(dedup(ingested(raw, start, end)))
    return weather_hourly(classified), rejects(classified, "weather_readings")


def as_stored(df: DataFrame, ddl: str) -> DataFrame:
    """`df` with the columns and types of a stored table; decimals round half up."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in DataType.fromDDL(ddl)])


def duplicate_groups(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Non-null keys that occur more than once, with their number."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_row_number(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows that are first in their key's order, by a window; for small keys."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")
