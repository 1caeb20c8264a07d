"""Time series of metrics: rates of counters, quantiles of histograms, range queries and alerts that last.

A series is a set of labels; `t` is in seconds. Windows are found by equal steps, never by a join over ranges: each sample
goes to the steps whose window it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds for which a sample stands where a newer one is missing.
LOOKBACK = 300
#: Windows of a series that are put in order at a time.
SLOT_WINDOWS = 64


def increases(samples: DataFrame, labels: list[str], window: int, step: int) -> DataFrame:
    """labels, t, increase and rate (a second) of the counters `samples` (labels, t, v) over the `window` seconds up to each step.

    A value lower than the one before is a counter that began again, so what it had is added. What the window's ends lack is
    made up by the mean distance of samples: to the end itself if that is at most 1.1 of the distance away, half a distance
    otherwise, and never further back than where the counter was zero. Steps with fewer than two samples in (t - window, t] have none.
    """
    width = SLOT_WINDOWS * window
    slot = F.floor(F.col("t") / width)
    halo = F.when(F.col("t") >= (slot + 1) * width - window, F.array(slot, slot + 1)).otherwise(F.array(slot))
    by = Window.partitionBy(*labels, "slot").orderBy("t")
    known = samples.select(*labels, "t", "v", F.explode(halo).alias("slot"), slot.alias("own"))
    known = known.select("*", F.lag("t").over(by).alias("prev_t"), F.lag("v").over(by).alias("prev_v")).where("slot = own")
    steps = F.sequence(F.ceil(F.col("t") / step), F.ceil((F.col("t") + window) / step) - 1)
    some = F.ceil((F.col("t") + window) / step) - 1 >= F.ceil(F.col("t") / step)
    at = known.withColumn("at", F.explode(F.when(some, steps))).withColumn("at", F.col("at") * step)
    reset = F.when((F.col("prev_t") > F.col("at") - window) & (F.col("v") < F.col("prev_v")), F.col("prev_v")).otherwise(0.0)
    g = at.groupBy(*labels, "at").agg(
        F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("v", "t").alias("v0"), F.max_by("v", "t").alias("v1"), F.sum(reset).alias("resets")
    )
    g = g.where("n > 1").withColumn("delta", F.col("v1") - F.col("v0") + F.col("resets"))
    g = g.withColumns({"span": F.col("t1") - F.col("t0"), "mean": (F.col("t1") - F.col("t0")) / (F.col("n") - 1)})
    reach = lambda gap: F.when(gap >= F.col("mean") * 1.1, F.col("mean") / 2).otherwise(gap)
    start, end = reach(F.col("t0") - (F.col("at") - window)), reach(F.col("at") - F.col("t1"))
    zero = F.when((F.col("delta") > 0) & (F.col("v0") >= 0), F.col("span") * F.col("v0") / F.col("delta"))
    total = F.col("delta") * (F.col("span") + F.least(start, F.coalesce(zero, start)) + end) / F.col("span")
    return g.select(*labels, F.col("at").alias("t"), total.alias("increase"), (total / window).alias("rate"))


def histogram_quantile(rates: DataFrame, labels: list[str], q: float, le: str = "le", value: str = "rate") -> DataFrame:
    """labels, t and the quantile by interpolation within cumulative buckets (`le`: upper bound, infinity for the last).

    In the last bucket it is the bound below; without observations null. The first bucket begins at 0.
    """
    rows = rates.groupBy(*labels, "t").agg(F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(value).alias("c")))).alias("b"))  # a row a bucket
    rank = F.lit(q) * F.element_at("b", -1)["c"]
    found = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.get("b", i)["c"] >= rank)
    rows = rows.withColumns({"i": F.element_at(found, 1), "rank": rank})
    here, low = F.get("b", F.col("i")), F.get("b", F.col("i") - 1)
    below, bound = F.coalesce(low["c"], F.lit(0.0)), F.coalesce(low["le"], F.lit(0.0))
    inside = bound + (here["le"] - bound) * F.try_divide(F.col("rank") - below, here["c"] - below)
    out = F.when(here["le"] == float("inf"), low["le"]).otherwise(inside)
    return rows.select(*labels, "t", F.when(F.element_at("b", -1)["c"] > 0, out).alias("value"))


def on_grid(samples: DataFrame, labels: list[str], start: int, end: int, step: int, lookback: int | None = LOOKBACK, known: DataFrame | None = None) -> DataFrame:
    """labels, t and v at start, start + step, ... end: of each series the last value less than `lookback` seconds old (None: however old), or null.

    Samples and steps are put in one order and the last value is carried on; no samples are joined over ranges. The series are those
    with samples in the range, or the labels in `known`.
    """
    first = start - (lookback if lookback is not None else start)
    near = samples.where(F.col("t").between(first, end)).select(*labels, "t", "v", F.lit(0).alias("asks"))
    names = near.select(*labels).distinct() if known is None else known
    grid = names.select("*", F.explode(F.sequence(*[F.lit(x).cast("long") for x in (start, end, step)])).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("asks"))
    by = Window.partitionBy(*labels).orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    both = near.unionByName(grid).select(*labels, "t", "asks", F.last(F.when(F.col("asks") == 0, F.struct("t", "v")), ignorenulls=True).over(by).alias("x"))
    fresh = F.lit(True) if lookback is None else F.col("t") - F.col("x.t") < lookback
    return both.where("asks = 1").select(*labels, "t", F.when(fresh, F.col("x.v")).alias("v"))


def history(samples: DataFrame, labels: list[str], now: int, window_hours: int, step: int) -> DataFrame:
    """The finite values of the last hours (1 to 72) at each step, rounded."""
    hours = max(1, min(72, window_hours))
    rows = on_grid(samples, labels, now - hours * 3600, now, step)
    return rows.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')").select(*labels, "t", F.round("v", 6).alias("score"))


def alert_states(evaluated: DataFrame, labels: list[str], holds: Column, step: int, lasting: int) -> DataFrame:
    """labels, state, t_from, t_to of a rule whose condition is evaluated every `step` seconds: runs of rows in which it holds.

    A run is pending until it has lasted `lasting` seconds, then firing, and resolved where it has ended. A shorter run is pending
    only. t_to is the first step at which the state is over; null if it is not over at the last step.
    """
    by = Window.partitionBy(*labels).orderBy("t")
    on = evaluated.select(*labels, "t", F.coalesce(holds, F.lit(False)).alias("on"))
    last = on.groupBy(*labels).agg(F.max("t").alias("last"))
    runs = on.where("on").withColumn("run", F.col("t") - step * F.row_number().over(by))  # the same within a run
    runs = runs.groupBy(*labels, "run").agg(F.min("t").alias("a"), F.max("t").alias("z")).join(last, labels)
    over = F.when(F.col("z") < F.col("last"), F.col("z") + step)
    fires, began = F.col("z") - F.col("a") >= lasting, F.col("a") + lasting
    states = F.array_compact(
        F.array(
            F.when(F.lit(lasting > 0), F.struct(F.lit("pending").alias("state"), F.col("a").alias("t_from"), F.when(fires, began).otherwise(over).alias("t_to"))),
            F.when(fires, F.struct(F.lit("firing").alias("state"), began.alias("t_from"), over.alias("t_to"))),
            F.when(fires & over.isNotNull(), F.struct(F.lit("resolved").alias("state"), over.alias("t_from"), F.lit(None).cast("long").alias("t_to"))),
        )
    )
    return runs.select(*labels, F.explode(states).alias("x")).select(*labels, "x.*")
