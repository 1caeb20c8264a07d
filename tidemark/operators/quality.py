"""Training and serving skew, population stability, drift, and alert rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import hour_of
from tidemark.sources.paths import written

OFFLINE = {
    "event_count": "event_count",
    "demand_lag_1h": "lag_1h",
    "demand_lag_24h": "lag_24h",
    "demand_lag_168h": "lag_168h",
    "demand_roll_3h": "roll_3h",
    "demand_roll_24h": "roll_24h",
    "humidity_pct": "humidity_pct",
    "is_holiday": "is_holiday",
}
ONLINE = {"temperature_c": "temp", "precip_mm": "precip"}
TOLERANCE = 1e-2
EPS = 0.5


def joined(serving: DataFrame, mart: DataFrame) -> DataFrame:
    """Each served row with its warehouse hour, if any, is_stale, and the absolute difference d_* of each feature."""
    s = serving.withColumn("serving_hour", hour_of(F.col("requested_at"))).alias("s")
    names = [*OFFLINE, *ONLINE]
    w = mart.select(F.col("city").alias("w_city"), F.col("hour_ts").alias("wh_hour"), *[F.col(c).cast("double" if c != "is_holiday" else "int").cast("double").alias(f"w_{c}") for c in names])
    rows = s.join(w, (F.col("city") == F.col("w_city")) & (F.col("serving_hour") == F.col("wh_hour")), "left")
    stale = F.col("mart_hour_ts").isNotNull() & (F.col("mart_hour_ts") != F.col("serving_hour"))
    gap = lambda c: F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.coalesce(f"w_{c}", F.lit(0.0)))
    return rows.select("city", "serving_hour", "wh_hour", stale.alias("is_stale"), *[gap(c).alias(f"d_{c}") for c in names])


def skew_summary(rows: DataFrame, tolerance: float = TOLERANCE, guarded: bool = False) -> DataFrame:
    """22 counts in one pass. Unmatched rows are compared with zero and count, as they always have; `guarded` leaves them out."""
    there = F.col("wh_hour").isNotNull()
    off = lambda c: (F.col(f"d_{c}") > tolerance) & (there if guarded else F.lit(True))
    return rows.agg(
        F.count("*").alias("total"),
        F.count("wh_hour").alias("matched"),
        (F.count("*") - F.count("wh_hour")).alias("unmatched"),
        F.count_if("is_stale").alias("stale_mart"),
        *[F.count_if(off(c)).alias(f"bug_{n}") for c, n in OFFLINE.items()],
        *[F.count_if(~F.col("is_stale") & off(c)).alias(f"true_bug_{n}") for c, n in OFFLINE.items()],
        *[F.count_if(off(c)).alias(f"online_{n}") for c, n in ONLINE.items()],
    )


def unpivoted(rows: DataFrame) -> DataFrame:
    """feat, delta, is_online, has_wh: a row for each feature of each served row."""
    each = F.array(*[F.struct(F.lit(c).alias("feat"), F.col(f"d_{c}").alias("delta"), F.lit(c in ONLINE).alias("is_online")) for c in [*OFFLINE, *ONLINE]])
    return rows.select(F.explode(each).alias("x"), F.col("wh_hour").isNotNull().alias("has_wh")).select("x.*", "has_wh")


def skew_by_feature(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Mismatches of matched rows by feature, with their mean and greatest difference."""
    off = F.when(F.col("has_wh") & (F.col("delta") > tolerance), F.col("delta"))
    out = unpivoted(rows).groupBy("feat", "is_online").agg(F.count(off).alias("mismatches"), F.round(F.avg(off), 4).alias("avg_delta"), F.round(F.max(off), 4).alias("max_delta"))
    return out.orderBy("is_online", F.desc_nulls_last("mismatches"), "feat")


def skew_verdicts(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """feat, verdict: override of an online feature, code_bug (on fresh rows), stale_drift (only on stale ones) or clean."""
    each = F.array(*[F.struct(F.lit(c).alias("feat"), F.col(f"d_{c}").alias("delta"), F.lit(c in ONLINE).alias("is_online")) for c in [*OFFLINE, *ONLINE]])
    long = rows.select(F.explode(each).alias("x"), "is_stale").select("x.*", "is_stale")
    off = F.col("delta") > tolerance
    counts = long.groupBy("feat", "is_online").agg(F.count_if(off).alias("n"), F.count_if(off & ~F.col("is_stale")).alias("fresh"))
    verdict = F.when(F.col("n") == 0, "clean").when(F.col("is_online"), "online_override").when(F.col("fresh") > 0, "code_bug").otherwise("stale_drift")
    return counts.select("feat", "n", "fresh", verdict.alias("verdict"))


# Population stability


def ranked(reference: DataFrame, current: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """feature, v, r, c (how often in the reference and current rows), through_r, through_c (with all lower values), n_r, n_c.

    All columns in one pass: counts by value, range-partitioned and sorted; each part is summed by itself and its
    start added, so that no task holds all values of a column.
    """
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = reference.select(F.inline(each)).withColumns({"r": F.lit(1), "c": F.lit(0)}).unionByName(current.select(F.inline(each)).withColumns({"r": F.lit(0), "c": F.lit(1)}))
    return ranks_of(long.where("v IS NOT NULL AND NOT isnan(v)").groupBy("feature", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c")))


def ranks_of(counts: DataFrame) -> DataFrame:
    """What `ranked` returns, of values that are counted already (feature, v, r, c)."""
    parts = written(counts.repartitionByRange("feature", "v").withColumn("part", F.spark_partition_id()), "ranked-values")
    sums = parts.groupBy("feature", "part").agg(F.sum("r").alias("sr"), F.sum("c").alias("sc"))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    whole = Window.partitionBy("feature")
    zero = F.lit(0).cast("long")
    starts = sums.select("feature", "part", F.coalesce(F.sum("sr").over(before), zero).alias("br"), F.coalesce(F.sum("sc").over(before), zero).alias("bc"), F.sum("sr").over(whole).alias("n_r"), F.sum("sc").over(whole).alias("n_c"))
    within = Window.partitionBy("feature", "part").orderBy("v")
    return parts.join(F.broadcast(starts), ["feature", "part"]).select(
        "feature", "v", "r", "c", (F.col("br") + F.sum("r").over(within)).alias("through_r"), (F.col("bc") + F.sum("c").over(within)).alias("through_c"), "n_r", "n_c"
    )


def quantiles(ranks: DataFrame, parts: int) -> DataFrame:
    """feature, quantiles: the exact interpolated 0, 1/parts, ... 1 quantiles of the reference, from the values at the ranks around each."""
    at = lambda i: F.floor(i * (F.col("n_r") - 1) / parts)
    steps = F.sequence(F.lit(0), F.lit(parts))
    wanted = F.array_distinct(F.flatten(F.transform(steps, lambda i: F.array(at(i), F.least(at(i) + 1, F.col("n_r") - 1)))))
    here = F.filter(wanted, lambda k: (k >= F.col("through_r") - F.col("r")) & (k < F.col("through_r")))
    known = ranks.where("r > 0").select("feature", "v", "n_r", here.alias("ks")).where(F.size("ks") > 0).select("feature", "v", "n_r", F.explode("ks").alias("k"))
    by_rank = known.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("of"), F.first("n_r").alias("n_r"))  # two values a quantile

    def quantile(i: Column) -> Column:
        low, high = F.col("of")[at(i)], F.col("of")[F.least(at(i) + 1, F.col("n_r") - 1)]
        return low + (high - low) * (i * (F.col("n_r") - 1) / parts - at(i))

    return by_rank.select("feature", F.transform(steps, quantile).alias("quantiles"))


def medians(rows: DataFrame, *columns: str) -> dict[str, float | None]:
    """The exact median of each column, None without values; no task holds all values of a column."""
    found = quantiles(ranked(rows, rows.limit(0), columns), 2).select("feature", F.col("quantiles")[1].alias("m"))
    return dict.fromkeys(columns) | {r["feature"]: r["m"] for r in found.collect()}  # a row a column


def psi_of(ranks: DataFrame, columns: tuple[str, ...], bins: int = 10) -> DataFrame:
    """feature, psi: bins by exact quantiles of the reference; values outside count in the total only.

    0 when the reference has fewer than 10 values, the current rows fewer than 5, or fewer than two bins are left.
    """
    edges = quantiles(ranks, bins).select("feature", F.array_sort(F.array_distinct("quantiles")).alias("edges"))
    n, last, v = F.size("edges"), F.element_at("edges", -1), F.col("v")
    # The number of edges at or below a value is its bin; the last bin is closed.
    place = F.when(v == last, n - 1).when((v < F.element_at("edges", 1)) | (v > last), 0).otherwise(F.size(F.filter("edges", lambda e: e <= v)))
    placed = ranks.join(F.broadcast(edges), "feature").where(n >= 3).select("feature", place.alias("bin"), (n - 1).alias("k"), "r", "c", "n_r", "n_c")  # a row a feature
    counts = placed.groupBy("feature", "bin", "k", "n_r", "n_c").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    whole = counts.groupBy("feature", "k", "n_r", "n_c").agg(F.collect_list(F.struct("bin", "r", "c")).alias("found"))  # a row a bin
    share = lambda x, total: (x + EPS) / (F.col(total) + EPS * F.col("k"))
    each = F.transform(
        F.sequence(F.lit(1), F.col("k")),
        lambda b: F.coalesce(F.get(F.filter("found", lambda f: f["bin"] == b), F.lit(0)), F.struct(b.alias("bin"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"))),
    )
    term = lambda x: (share(x["c"], "n_c") - share(x["r"], "n_r")) * F.log(share(x["c"], "n_c") / share(x["r"], "n_r"))
    psi = F.aggregate(F.transform(each, term), F.lit(0.0), lambda a, x: a + x)
    found = whole.where("n_r >= 10 AND n_c >= 5").select("feature", psi.alias("psi"))
    asked = ranks.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return asked.join(found, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi_numeric(reference: DataFrame, current: DataFrame, *columns: str, bins: int = 10) -> DataFrame:
    """feature, psi of the columns (`psi_of`)."""
    return psi_of(ranked(reference, current, columns), columns, bins)


def psi_categorical(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """psi over the union of the categories (null is one); 0 when either side is empty."""
    both = reference.select(F.col(column).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select(F.col(column).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    counts = both.groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    totals = counts.agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"), F.count("*").alias("k"))
    share = lambda x, total: (F.col(x) + EPS) / (F.col(total) + EPS * F.col("k"))
    r, c = share("r", "n_r"), share("c", "n_c")
    rows = counts.join(F.broadcast(totals), F.lit(True)).where("n_r > 0 AND n_c > 0")  # one row
    return rows.agg(F.coalesce(F.sum((c - r) * F.log(c / r)), F.lit(0.0)).alias("psi")).select(F.lit(column).alias("feature"), "psi")


def ks_of(ranks: DataFrame) -> DataFrame:
    """feature, ks: the greatest distance of the two distribution functions."""
    gap = F.abs(F.try_divide("through_r", "n_r") - F.try_divide("through_c", "n_c"))
    return ranks.groupBy("feature").agg(F.max(gap).alias("ks"))


def ks_statistic(reference: DataFrame, current: DataFrame, *columns: str) -> DataFrame:
    """feature, ks of the columns; none where one side has no values."""
    return ks_of(ranked(reference, current, columns)).where("ks IS NOT NULL")


#: What is watched. Cyclic time features would differ in any short window.
DRIFT_FEATURES = ("event_count", "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_3h", "demand_roll_24h", "temperature_c", "humidity_pct", "precip_mm", "is_holiday")


def drift_report(reference: DataFrame, current: DataFrame, features: tuple[str, ...] = DRIFT_FEATURES, threshold: float = 0.2, least_rows: int = 20) -> DataFrame:
    """feature_name, drift_score (psi), ks, drift_detected and both counts; none is detected on fewer current rows than `least_rows`.

    Both scores are higher the more the distributions differ.
    """
    ranks = ranked(reference, current, features)
    psi, ks = psi_of(ranks, features), ks_of(ranks)
    n = reference.agg(F.count("*").alias("reference_count")).join(F.broadcast(current.agg(F.count("*").alias("current_count"))), F.lit(True))  # one row each
    rows = psi.join(ks, "feature", "left").join(F.broadcast(n), F.lit(True))
    return rows.select(
        F.col("feature").alias("feature_name"),
        F.round("psi", 6).alias("drift_score"),
        F.round("ks", 6).alias("ks"),
        ((F.col("psi") > threshold) & (F.col("current_count") >= least_rows)).alias("drift_detected"),
        "reference_count",
        "current_count",
    )


def worst(scores: DataFrame, name: str, score: str, limit: float) -> DataFrame:
    """The greatest score, its feature, and how many are above the limit."""
    return scores.agg(F.max(score).alias("worst_score"), F.max_by(name, F.struct(score, name)).alias("worst_feature"), F.count_if(F.col(score) > limit).alias("above"))


def alerts(metrics: DataFrame) -> DataFrame:
    """metric, value and firing of one-row-a-metric measurements, by fixed limits; an absent training time fires."""
    limits = {"consumer_lag": 1000.0, "drift_score": 0.2, "predict_p99_seconds": 0.5, "training_age_seconds": 172_800.0}
    over = reduce(lambda a, kv: a | ((F.col("metric") == kv[0]) & (F.col("value") > kv[1])), limits.items(), F.lit(False))
    return metrics.select("metric", "value", (over | ((F.col("metric") == "training_age_seconds") & F.col("value").isNull())).alias("firing"))


def mean_abs_difference(left: Column, right: Column) -> Column:
    """Of two equally long arrays."""
    gaps = F.zip_with(left, right, lambda a, b: F.abs(a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps)
