"""Scalar expressions of the marts and the weather model."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hour_of(ts: Column) -> Column:
    """Start of the hour, without a zone."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def iso_weekday(ts: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(ts) + 1


def epoch(ts: Column) -> Column:
    """Seconds with fraction since 1970, in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def cyclic(part: Column, period: int, name: str) -> list[Column]:
    angle = part * (2 * math.pi / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def cyclic_time(ts: Column) -> list[Column]:
    """hour_sin, hour_cos, dow_sin, dow_cos."""
    return cyclic(F.hour(ts), 24, "hour") + cyclic(F.weekday(ts), 7, "dow")


def safe_div(x: Column, y: Column) -> Column:
    """Null where the divisor is zero."""
    return x / F.nullif(y, F.lit(0))


def failed_checks(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, joined by commas; null if none does."""
    return F.nullif(F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in checks.items()]), F.lit(""))


def compass(degrees: Column) -> Column:
    """One of 16 points; halves go to the even point."""
    points = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    return F.element_at(F.array(*[F.lit(p) for p in points]), (F.bround(degrees / 22.5, 0).cast("int") % 16) + 1)


def uv_index(hour: Column, cloud_pct: Column) -> Column:
    """0 at night, highest at noon, less under cloud (fixed values)."""
    sun = F.sin((hour - 6) * (math.pi / 14)) * 10 * (1 - cloud_pct / 150)
    return F.when((hour < 6) | (hour > 20), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(11), F.bround(sun, 0).cast("int"))))


def visibility_km(humidity: Column, cloud_pct: Column) -> Column:
    """Less in damp and cloudy air (fixed values)."""
    km = F.greatest(F.lit(1.0), F.least(F.lit(20.0), 20.0 - (humidity - 50) * 0.1 - cloud_pct * 0.05))
    return F.round(F.round(km, 6), 1)  # first off the last binary digits


def condition(cloud_pct: Column, precip_pct: Column) -> Column:
    """The first label whose least value is reached: rain first, then clouds (fixed values)."""
    out = None
    for value, ladder in (
        (precip_pct, ((70, "HEAVY_RAIN"), (40, "RAIN"), (20, "DRIZZLE"))),
        (cloud_pct, ((90, "CLOUDY"), (70, "MOSTLY_CLOUDY"), (40, "PARTLY_CLOUDY_DAY"), (20, "MOSTLY_CLEAR"))),
    ):
        for least, label in ladder:
            out = F.when(value >= least, label) if out is None else out.when(value >= least, label)
    return out.otherwise("CLEAR_DAY")


def snapshot_hash(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """hash16: 16 hexadecimal digits that change with any row's keys or value.

    A tree of digests: rows are grouped by their digest's first six digits, sorted within, and hashed together; then
    those by three digits, then all. Groups stay small up to some ten thousand million rows; no task holds all rows.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys, value]])
    rows = df.select(F.sha2(line, 256).alias("digest")).withColumn("at", F.substring("digest", 1, 6))
    whole = F.sha2(F.concat_ws("", F.array_sort(F.collect_list("digest"))), 256).alias("digest")
    sixes = rows.groupBy("at").agg(whole).withColumn("at", F.substring("at", 1, 3))
    return sixes.groupBy("at").agg(whole).agg(F.substring(whole, 1, 16).alias("hash16"))


# Holidays: a small dimension from rules.

CITY_COUNTRY = {"london": "GB", "new_york": "US", "tokyo": "JP", "sydney": "AU"}


def _easter(year: int) -> date:
    """Sunday of Western Easter (the anonymous Gregorian computus)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (0 = Monday) of a month; n = -1 for the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def holidays(first_year: int, last_year: int) -> list[tuple[str, date]]:
    """(country, date) of national holidays by rule."""
    out = set()
    for y in range(first_year, last_year + 1):
        e = _easter(y)
        fixed = {
            "GB": [(1, 1), (12, 25), (12, 26)],
            "US": [(1, 1), (6, 19), (7, 4), (11, 11), (12, 25)],
            "JP": [(1, 1), (2, 11), (2, 23), (4, 29), (5, 3), (5, 4), (5, 5), (8, 11), (11, 3), (11, 23)],
            "AU": [(1, 1), (1, 26), (4, 25), (12, 25), (12, 26)],
        }
        moving = {
            "GB": [e - timedelta(2), e + timedelta(1), _nth(y, 5, 0, 1), _nth(y, 5, 0, -1), _nth(y, 8, 0, -1)],
            "US": [_nth(y, 1, 0, 3), _nth(y, 2, 0, 3), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 10, 0, 2), _nth(y, 11, 3, 4)],
            "JP": [_nth(y, 1, 0, 2), _nth(y, 7, 0, 3), _nth(y, 9, 0, 3), _nth(y, 10, 0, 2)],
            "AU": [e - timedelta(2), e - timedelta(1), e + timedelta(1)],
        }
        for c in fixed:
            out |= {(c, date(y, *md)) for md in fixed[c]} | {(c, d) for d in moving[c]}
    return sorted(out)


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """city, holiday: some twenty rows a city and year, for a broadcast join."""
    cities = {c: city for city, c in CITY_COUNTRY.items()}
    return spark.createDataFrame([(cities[c], d) for c, d in holidays(first_year, last_year)], "city string, holiday date")
