"""The hourly feature mart, its quality checks, and the daily route features."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import cyclic_time, iso_weekday, safe_div

LAGS = (1, 24, 168)
TRAILING = (3, 24)
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def with_lags(hourly: DataFrame) -> DataFrame:
    """Lags and trailing means by rows of the same city: a missing hour shifts them, as in the stored mart.

    All expressions share one exchange and sort by (city, hour_ts).
    """
    w = Window.partitionBy("city").orderBy("hour_ts")
    return hourly.select(
        "*",
        *[F.lag("total_demand", n).over(w).alias(f"demand_lag_{n}h") for n in LAGS],
        *[F.avg("total_demand").over(w.rowsBetween(-n, -1)).alias(f"demand_roll_{n}h") for n in TRAILING],
    )


def with_weather(hourly: DataFrame, weather: DataFrame) -> DataFrame:
    """Every demand hour, with its weather where there is some."""
    return hourly.join(weather, ["city", "hour_ts"], "left")


def with_holidays(rows: DataFrame, holidays: DataFrame, ts: str = "hour_ts") -> DataFrame:
    """is_holiday: the UTC date is in the city's calendar; cities without one have none. The calendar is broadcast."""
    days = F.broadcast(holidays.select(F.col("city").alias("h_city"), "holiday").distinct())  # some twenty rows a city and year
    found = rows.join(days, (F.col("city") == F.col("h_city")) & (F.to_date(ts) == F.col("holiday")), "left")
    return found.withColumn("is_holiday", F.col("holiday").isNotNull()).drop("h_city", "holiday")


def city_hour_features(demand: DataFrame, weather: DataFrame, holidays: DataFrame) -> DataFrame:
    """The hourly mart: demand with lags and trailing means, cyclic time, weather and holidays."""
    lagged = with_lags(demand.select("city", "hour_ts", "total_demand", "event_count"))
    timed = lagged.select("*", *cyclic_time(F.col("hour_ts")))
    return with_holidays(with_weather(timed, weather), holidays)


NEVER_NULL = ("city", "hour_ts", "total_demand", "event_count", "hour_sin", "hour_cos", "is_holiday")


def null_profile(mart: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and the number of nulls of each column, in one pass."""
    return mart.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def quality_report(mart: DataFrame, staged: DataFrame) -> tuple[list[str], list[str]]:
    """Errors (all that hold) and warnings about a mart and the staged hours it was made of: two one-row aggregates."""
    soft = {"demand_lag_1h": 0.5, "temperature_c": 0.9}
    r = null_profile(mart, [*NEVER_NULL, *soft]).first()
    staged_rows = staged.count()
    errors = [] if r["n_rows"] else ["the mart has no rows"]
    errors += [f"the mart has {r['n_rows']} rows, staging {staged_rows}"] * (r["n_rows"] != staged_rows)
    errors += [f"{c} is null in {r[f'null_{c}']} rows" for c in NEVER_NULL if r[f"null_{c}"]]
    warnings = [f"{c} is null in more than {s:.0%} of rows" for c, s in soft.items() if r["n_rows"] and r[f"null_{c}"] / r["n_rows"] > s]
    return errors, warnings


def check_quality(mart: DataFrame, staged: DataFrame) -> list[str]:
    """The warnings; raises with all errors if there are some."""
    errors, warnings = quality_report(mart, staged)
    if errors:
        raise ValueError("; ".join(errors))
    return warnings


# Daily route features, as of a date. Bounds use event time; lower ones are exclusive, so `days` days are covered.


def daily(mart: DataFrame, as_of: date) -> DataFrame:
    """city, day, daily_demand, daily_bookings up to a date."""
    rows = mart.where(F.col("total_demand").isNotNull() & (F.col("hour_ts") < _midnight(as_of, 1)))
    return rows.groupBy("city", F.to_date("hour_ts").alias("day")).agg(F.sum("total_demand").alias("daily_demand"), F.sum("event_count").alias("daily_bookings"))


def _midnight(day: date, later: int):
    """The start of a day, some days later: a plain literal, so that comparing a column with it reaches the files."""
    return F.lit(datetime.combine(day, time()) + timedelta(days=later)).cast("timestamp_ntz")


def _since(column, as_of: date, days: int):
    """The last `days` days up to and with `as_of`; for dates and times."""
    return (F.col(column) >= _midnight(as_of, 1 - days)) & (F.col(column) < _midnight(as_of, 1))


def booking_level(days: DataFrame, as_of: date, n: int = 90) -> DataFrame:
    """Mean of daily bookings over the days with data among the last n."""
    return days.where(_since("day", as_of, n)).groupBy("city").agg(F.avg("daily_bookings").alias("avg_bookings_90d"))


def seasonality(days: DataFrame) -> DataFrame:
    """Each weekday's mean bookings over the mean of all days; one pass with conditional means."""
    dow = iso_weekday(F.col("day"))
    whole = F.avg("daily_bookings")
    return days.groupBy("city").agg(*[safe_div(F.avg(F.when(dow == i + 1, F.col("daily_bookings"))), whole).alias(f"seasonality_{d}") for i, d in enumerate(DAYS)])


def lead_times(events: DataFrame, as_of: date, n: int = 90) -> DataFrame:
    """Exact interpolated quantiles of hours from event to ingestion, negative ones left out.

    Leads are whole minutes here, so the value counts that the exact quantile keeps stay bounded.
    """
    hours = (F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("sim_ts").cast("timestamp"))) / 3.6e9
    rows = events.where(_since("sim_ts", as_of, n) & F.col("city").isNotNull()).withColumn("lead", hours).where("lead >= 0")
    return rows.groupBy("city").agg(F.percentile("lead", F.lit(0.5)).alias("lead_time_p50"), F.percentile("lead", F.lit(0.9)).alias("lead_time_p90"))


def cancellation_rate(events: DataFrame, as_of: date, n: int = 180) -> DataFrame:
    """Cancellations over all events."""
    rows = events.where(_since("sim_ts", as_of, n) & F.col("city").isNotNull())
    return rows.groupBy("city").agg((F.count_if(F.col("event_type") == "cancellation") / F.count("*")).alias("cancellation_rate_180d"))


def elasticity(mart: DataFrame, as_of: date) -> DataFrame:
    """Correlation of temperature and demand; null where one of them is constant or there are fewer than two rows."""
    rows = mart.where((F.col("hour_ts") < _midnight(as_of, 1)) & F.col("temperature_c").isNotNull() & F.col("total_demand").isNotNull())
    spread = F.stddev_pop("temperature_c") * F.stddev_pop("total_demand")
    return rows.groupBy("city").agg(F.when(spread > 0, F.try_divide(F.covar_pop("temperature_c", "total_demand"), spread)).alias("elasticity_estimate"))


def route_features(mart: DataFrame, events: DataFrame, as_of: date) -> DataFrame:
    """The daily mart as of a date, a row for each city with bookings in the last 90 days."""
    days = daily(mart, as_of)
    level = booking_level(days, as_of)
    out = level
    for more in (seasonality(days), lead_times(events, as_of), cancellation_rate(events, as_of), elasticity(mart, as_of)):
        out = out.join(more, "city", "left")
    return out.select(
        F.col("city").alias("route_id"),
        F.lit(as_of).alias("feature_date"),
        "avg_bookings_90d",
        *[f"seasonality_{d}" for d in DAYS],
        "lead_time_p50",
        "lead_time_p90",
        F.coalesce("cancellation_rate_180d", F.lit(0.0)).alias("cancellation_rate_180d"),
        "elasticity_estimate",
    )
