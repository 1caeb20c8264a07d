"""Domain views over the driver's `events` table: demand events, weather readings and what the marts make of them."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import holiday_table
from tidemark.operators import marts, staging
from tidemark.session import in_utc
from tidemark.sources.paths import written

CITIES = ("london", "new_york", "tokyo", "sydney", "dubai")
TYPES = {"view": "search", "purchase": "booking", "error": "cancellation"}
#: Later days than this act as the future.
FEATURE_DATE = date(2024, 1, 20)


class Domain:
    """The views of one folder of tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = in_utc(spark), sf_dir

    @cached_property
    def events(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.dir}/events.parquet")
        return rows.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))

    def _city(self):
        return F.element_at(F.array(*[F.lit(c) for c in CITIES]), (F.col("user_id") % 5 + 1).cast("int"))

    @cached_property
    def demand_events(self) -> DataFrame:
        kind = F.col("event_type")
        for old, new in TYPES.items():
            kind = F.when(F.col("event_type") == old, new).otherwise(kind)
        n = F.col("event_id")
        return self.events.select(
            n.alias("id"),
            F.when(n % 97 != 0, n.cast("string")).alias("event_id"),
            F.when(n % 53 != 0, self._city()).alias("city"),
            kind.alias("event_type"),
            F.col("ts").alias("sim_ts"),
            F.when(n % 61 != 0, F.col("value")).alias("quantity"),
            (F.col("k") * 0.5 - 10).alias("temperature_c"),
            F.expr("timestampadd(MINUTE, k - 5, ts)").alias("ingested_at"),
        )

    @cached_property
    def weather_readings(self) -> DataFrame:
        rows = self.events.where(F.col("event_type").isin("click", "signup"))
        return rows.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("event_id"),
            self._city().alias("city"),
            F.col("ts").alias("polled_at"),
            (F.col("k") * 0.5 - 10).alias("temperature_c"),
            (20 + F.col("k") % 80).alias("humidity_pct"),
            F.when(F.col("k") < 30, F.col("value") / 100).otherwise(0.0).alias("precip_mm"),
            F.when(F.col("k") < 30, "RAIN").when(F.col("k") < 60, "CLOUDY").otherwise("CLEAR_DAY").alias("condition"),
            F.expr("timestampadd(MINUTE, 1, ts)").alias("ingested_at"),
        )

    @cached_property
    def demand_dup(self) -> DataFrame:
        again = self.demand_events.where("id % 10 = 0").withColumns({"id": F.col("id") + 10_000_000, "ingested_at": F.expr("timestampadd(MINUTE, 1, ingested_at)")})
        return self.demand_events.unionByName(again)

    @cached_property
    def demand_hourly(self) -> DataFrame:
        return staging.demand_hourly(staging.classify_demand(staging.dedup(self.demand_events)))

    @cached_property
    def weather_hourly(self) -> DataFrame:
        return staging.weather_hourly(staging.classify_weather(staging.dedup(self.weather_readings)))

    @cached_property
    def holidays(self) -> DataFrame:
        return holiday_table(self.spark, 2023, 2026)

    @cached_property
    def mart(self) -> DataFrame:
        return marts.city_hour_features(self.demand_hourly, self.weather_hourly, self.holidays)

    @cached_property
    def stored_mart(self) -> DataFrame:
        """The mart written and read again, for jobs that read it several times."""
        return written(self.mart, "mart")

    @cached_property
    def prediction_features(self) -> DataFrame:
        """What serving would have logged, with stale rows, overrides and defects put in by rule."""
        m = self.mart
        n, h = F.col("event_count"), F.hour("hour_ts")
        return m.select(
            "city",
            F.when(n % 7 == 0, F.expr("timestampadd(DAY, 365, hour_ts)")).otherwise(F.expr("timestampadd(MINUTE, 20, hour_ts)")).alias("requested_at"),
            F.when(h % 11 == 0, F.expr("timestampadd(HOUR, -1, hour_ts)")).otherwise(F.col("hour_ts")).alias("mart_hour_ts"),
            n.cast("double").alias("event_count"),
            (F.col("demand_lag_1h") + F.when(n % 5 == 0, 5.0).otherwise(0.0)).alias("demand_lag_1h"),
            "demand_lag_24h",
            "demand_lag_168h",
            "demand_roll_3h",
            "demand_roll_24h",
            "humidity_pct",
            F.col("is_holiday").cast("int").cast("double").alias("is_holiday"),
            (F.col("temperature_c") + F.when(n % 3 == 0, 3.0).otherwise(0.0)).alias("temperature_c"),
            "precip_mm",
        )
