"""Rows for measurements, responses made flat, and faults: column expressions whose noise is hashed, so equal inputs give equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import cyclic_time

#: Cities of measured marts.
CITIES = ("london", "new_york", "tokyo", "sydney", "dubai", "nairobi", "moscow", "singapore", "reykjavik", "cape_town")


def uniform(*parts: Column) -> Column:
    """In (0, 1), by a hash of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)) + 0.5) / float(2**52)


def mart_rows(spark: SparkSession, n: int, cities: tuple[str, ...] = CITIES) -> DataFrame:
    """n rows of the hourly mart with uniform values, a hundredth of lags and a twentieth of readings missing: for measurements."""
    i, k = F.col("id"), len(cities)
    ts = F.expr(f"timestampadd(HOUR, CAST(id div {k} AS int), TIMESTAMP_NTZ '2000-01-01 00:00:00')")
    between = lambda name, lo, hi: lo + (hi - lo) * uniform(F.lit(name), i)
    some = lambda name, lo, hi, lost: F.when(uniform(F.lit("lost"), F.lit(name), i) >= lost, between(name, lo, hi)).alias(name)
    lags = [some(c, 50, 2000, 0.01) for c in ("demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_3h", "demand_roll_24h")]
    readings = [some(c, lo, hi, 0.05) for c, lo, hi in (("temperature_c", -15, 42), ("humidity_pct", 10, 99), ("precip_mm", 0, 30))]
    city = F.element_at(F.array(*[F.lit(c) for c in cities]), (i % k + 1).cast("int"))
    return spark.range(n).select(city.alias("city"), ts.alias("hour_ts"), between("total_demand", 50, 2000).alias("total_demand"), F.floor(between("event_count", 0, 200)).cast("int").alias("event_count"), *lags, *cyclic_time(ts), *readings, (uniform(F.lit("holiday"), i) < 0.5).alias("is_holiday"))


#: Nested fields of a weather response and the flat columns they become.
FLAT = {
    "temperature.degrees": "temperature_c",
    "feelsLikeTemperature.degrees": "feels_like_c",
    "dewPoint.degrees": "dew_point_c",
    "relativeHumidity": "humidity_pct",
    "wind.speed.value": "wind_kph",
    "wind.direction.degrees": "wind_direction_deg",
    "cloudCover": "cloud_cover_pct",
    "precipitation.probability.percent": "precip_probability_pct",
    "precipitation.qpf.quantity": "precip_mm",
    "weatherCondition.type": "condition",
}


def flattened(responses: DataFrame) -> DataFrame:
    """city, polled_at and ten flat columns of nested responses."""
    return responses.select("city", "polled_at", *[F.col(f"response.{p}").alias(n) for p, n in FLAT.items()])


def with_faults(rows: DataFrame, null_rate: float = 0.0, rename: tuple[str, str] | None = None) -> DataFrame:
    """Test fixture: values lost at a rate, by hashes, and a column renamed as a drifting producer would."""
    lost = lambda c: F.when(uniform(F.lit(c), *[F.col(x).cast("string") for x in rows.columns]) >= null_rate, F.col(c)).alias(c)
    out = rows.select(*[lost(c) for c in rows.columns])
    return out.withColumnRenamed(*rename) if rename else out
