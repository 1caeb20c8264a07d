"""Drift from stored counts: a state a day that adds up, reports over any windows of days, and what they found.

A day's state is how often each feature has each value. States of days add up, so a report over any reference and
current window of days is a sum of them and reads no rows again; it equals `quality.drift_report` over the rows.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.sources.paths import written
from tidemark.sources.snapshots import Store

STATES, REPORTS = "drift_days", "drift_reports"
#: The feature under which a day's state has its number of rows.
ALL = "*"
DIGITS = 6


def day_counts(rows: DataFrame, ts: str = "hour_ts", features: tuple[str, ...] = quality.DRIFT_FEATURES) -> DataFrame:
    """day, feature, v, n of the rows of each day; nulls and NaN are no values.

    Values are taken to DIGITS digits, more than the mart's columns have: sums in another order are then the same value.
    """
    each = F.array(F.struct(F.lit(ALL).alias("feature"), F.lit(0.0).alias("v")), *[F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), DIGITS).alias("v")) for c in features])
    long = rows.select(F.to_date(ts).alias("day"), F.inline(each))
    return long.where("v IS NOT NULL AND NOT isnan(v)").groupBy("day", "feature", "v").agg(F.count("*").alias("n"))


def keep_days(store: Store, counts: DataFrame) -> int:
    """Puts states in the place of those of the same days, which are replaced whole."""
    day = written(counts.select("day", "feature", "v", "n"), "drift-states")
    return store.replace_parts(STATES, day, F.col("day"))


def reports(counts: DataFrame, windows: list[tuple[datetime, date, date, date, date]], features: tuple[str, ...] = quality.DRIFT_FEATURES, threshold: float = 0.2, least_rows: int = 20) -> DataFrame:
    """checked_at, feature_name, drift_score (psi), ks, drift_detected and both counts, for each window and feature.

    A window is when it is checked, first and last day of the reference and of the current rows. Features that have no value
    in either have a score of 0.
    """
    spark = counts.sparkSession
    asked = spark.createDataFrame([(str(i), *w) for i, w in enumerate(windows)], "w string, checked_at timestamp_ntz, ref_from date, ref_to date, cur_from date, cur_to date")
    days = counts.join(F.broadcast(asked), F.col("day").between(F.col("ref_from"), F.col("ref_to")) | F.col("day").between(F.col("cur_from"), F.col("cur_to")))  # a row a window
    part = lambda a, b: F.sum(F.when(F.col("day").between(F.col(a), F.col(b)), F.col("n")).otherwise(0))
    sums = written(days.groupBy("w", "feature", "v").agg(part("ref_from", "ref_to").alias("r"), part("cur_from", "cur_to").alias("c")), "drift-sums")
    totals = sums.where(F.col("feature") == ALL).groupBy("w").agg(F.sum("r").alias("reference_count"), F.sum("c").alias("current_count"))
    keyed = sums.where(F.col("feature") != ALL).select(F.concat_ws("|", "w", "feature").alias("feature"), "v", "r", "c")
    ranks = quality.ranks_of(keyed)
    found = quality.psi_of(ranks, tuple(f"{i}|{n}" for i in range(len(windows)) for n in features)).join(quality.ks_of(ranks), "feature", "left")
    split = found.select(F.substring_index("feature", "|", 1).alias("w"), F.substring_index("feature", "|", -1).alias("feature_name"), "psi", "ks")
    rows = split.join(F.broadcast(asked.select("w", "checked_at").join(totals, "w")), "w")  # a row a window
    detected = (F.col("psi") > threshold) & (F.col("current_count") >= least_rows)
    return rows.select("checked_at", "feature_name", F.round("psi", 6).alias("drift_score"), F.round("ks", 6).alias("ks"), detected.alias("drift_detected"), "reference_count", "current_count")


def daily_windows(first: date, last: date, reference_days: int, current_days: int = 1) -> list[tuple[datetime, date, date, date, date]]:
    """A check at the start of each day: the days before it, against as many as asked before those."""
    out = []
    for k in range((last - first).days + 1):
        day = first + timedelta(days=k)
        cur = day - timedelta(days=current_days)
        out.append((datetime(day.year, day.month, day.day), cur - timedelta(days=reference_days), cur - timedelta(days=1), cur, day - timedelta(days=1)))
    return out


def keep_reports(store: Store, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Appends reports."""
    return store.append({REPORTS: written(rows, "drift-reports")}, batch=batch)


def hits(reports: DataFrame, n: int = 20) -> DataFrame:
    """The last detected rows of the kept reports."""
    return reports.where("drift_detected").orderBy(F.desc("checked_at"), "feature_name").limit(n)
