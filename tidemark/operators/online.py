"""Event-time sliding features, their replay from the lake, latest weather and the serving overlay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import cyclic_time, epoch
from tidemark.registry import REGISTRY

#: Seconds; both ends of a window count.
SHORT, MIDDLE, LONG = 300, 900, 3600
#: Hours of a route that a window task holds.
SLOT = 6


#: What is counted, of which events, over how many seconds.
WINDOWS = (("searches_5m", "search", SHORT), ("bookings_15m", "booking", MIDDLE), ("searches_1h", "search", LONG), ("bookings_1h", "booking", LONG))
MICRO = 1_000_000


def with_slots(rows: DataFrame) -> DataFrame:
    """`rows` (t, in microseconds) with `slot`, of SLOT hours, and `own`: those of a slot's last hour also stand in the next one, not as its own."""
    width = SLOT * LONG * MICRO
    slot = F.floor(F.col("t") / width)
    late = F.col("t") >= (slot + 1) * width - LONG * MICRO
    at = rows.select("*", F.explode(F.when(late, F.array(slot, slot + 1)).otherwise(F.array(slot))).alias("slot"), slot.alias("at"))
    return at.withColumn("own", F.col("slot") == F.col("at")).drop("at")


def _counted(rows: DataFrame, windows: tuple[tuple[str, str | None, int], ...]) -> DataFrame:
    """Of `rows` (route_id, slot, t, kind, member, event, asked, others) those that ask, with the counts of `windows` at their times.

    An id is in a window from its event on until the window has left the event behind or the id comes again, so that it
    counts once. At that time a row stands that takes it out, and every count is a running sum: a row costs the same
    however many events a window has. A window of kind None counts all events. All of it is one exchange by (route, slot).
    """
    after = Window.partitionBy("route_id", "slot", "kind", "member").orderBy("t")
    placed = rows.repartition("route_id", "slot").withColumn("next", F.when(F.col("kind").isNotNull(), F.lead("t").over(after)))
    inside = [F.coalesce(F.col("event") if k is None else F.col("kind") == k, F.lit(False)) for _, k, _ in windows]
    count = lambda by: [by(i).cast("int").alias(f"n{i}") for i in range(len(windows))]
    steps = [F.struct("t", "asked", *count(lambda i: inside[i]))]
    for j, (_, k, w) in enumerate(windows):
        end = F.col("t") + w * MICRO + 1
        out = F.struct((end if k is None else F.least(end, F.col("next"))).alias("t"), F.lit(False).alias("asked"), *count(lambda i: F.lit(-1 if i == j else 0)))  # noqa: B023
        steps.append(F.when(inside[j], out))
    others = [c for c in rows.columns if c not in ("t", "kind", "member", "event", "asked")]
    marked = placed.select(*others, F.explode(F.array_compact(F.array(*steps))).alias("x")).select(*others, "x.*")
    so_far = Window.partitionBy("route_id", "slot").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.select(*others, "asked", *[F.sum(f"n{i}").over(so_far).alias(name) for i, (name, _, _) in enumerate(windows)])
    return counted.where("asked").drop("asked", "slot").withColumn("look_to_book_1h", look_to_book("bookings_1h", "searches_1h"))


def _timed(events: DataFrame, *also: str) -> DataFrame:
    """The events that have a route and a time, in slots: t, and kind and member (the id) of those that count in a window."""
    member = F.col("event_type").isin("search", "booking") & F.col("event_id").isNotNull()
    clean = events.where(F.col("city").isNotNull() & F.col("sim_ts").isNotNull())
    return with_slots(clean.select(F.col("city").alias("route_id"), *also, F.when(member, F.col("event_type")).alias("kind"), F.when(member, F.col("event_id")).alias("member"), micros("sim_ts").alias("t"), F.lit(True).alias("event")))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_features(events: DataFrame) -> DataFrame:
    """For every event how many searches and bookings of its route are in the windows that end at it, and their ratio.

    An id counts once in a window, however often it is in it; events without id get windows but count in none, as in a
    replay. The events of a slot's last hour also stand before the next one's, so that a route is cut into as many tasks
    as it has slots.
    """
    return _counted(_timed(events, "id", "sim_ts").withColumnRenamed("own", "asked"), WINDOWS)


def look_to_book(bookings: str, searches: str) -> Column:
    return F.round(F.col(bookings) / F.greatest(F.col(searches), F.lit(1)), 6)


def reconstruct(events: DataFrame, asks: DataFrame) -> DataFrame:
    """The windows as they stood at (route_id, at) of each row of `asks`, from the events alone.

    Asks stand among the events of their slot and its hour before, so that any number of them, however many events their
    windows hold, is one sorted union. Slots without an ask are left out before. An ask without events gets no row.
    """
    blank = lambda kind: F.lit(None).cast(kind)
    asked = asks.select("route_id", "at", micros("at").alias("t")).where("t IS NOT NULL").distinct()
    asked = asked.withColumns({"slot": F.floor(F.col("t") / (SLOT * LONG * MICRO)), "kind": blank("string"), "member": blank("string"), "event": F.lit(False), "asked": F.lit(True)})
    rows = _timed(events).drop("own").join(asked.select("route_id", "slot").distinct(), ["route_id", "slot"], "left_semi")
    rows = rows.withColumns({"at": blank(asks.schema["at"].dataType), "asked": F.lit(False)})
    return _counted(rows.unionByName(asked), (*WINDOWS, ("rows_scanned", None, LONG))).where("rows_scanned > 0")


def verify(rebuilt: DataFrame, served: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-3) -> DataFrame:
    """keys, column, rebuilt, served and ok for each compared value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r.{c}").cast("double").alias("rebuilt"), F.col(f"s.{c}").cast("double").alias("served")) for c in columns])
    on = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in keys]
    rows = rebuilt.alias("r").join(served.alias("s"), on).select(*[F.col(f"r.{k}") for k in keys], F.explode(pairs).alias("x")).select(*keys, "x.*")
    return rows.withColumn("ok", F.abs(F.col("rebuilt") - F.col("served")) < tolerance)


def latest_weather(readings: DataFrame) -> DataFrame:
    """The last non-null value of each field by route, as texts; and when the last reading was."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("polled_at", "id")))
    return readings.groupBy(F.col("city").alias("route_id")).agg(
        last("temperature_c").alias("weather_temp_c"), last("precip_mm").alias("weather_precip_mm"), last("condition").alias("weather_condition"), F.max("polled_at").alias("stream_computed_at")
    )


def as_hash(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fields: a map of texts, null fields left out."""
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))) for c in fields]))
    return rows.select(key, F.map_from_entries(pairs).alias("fields"))


def online_overlay(base: DataFrame, store: DataFrame, as_of: datetime, key: str = "route_id") -> DataFrame:
    """`base` with the registered online fields of `store` (key, fields), and which are missing, stale and degraded.

    A field that is absent or that cannot be read takes its default and is listed as missing; one older than its
    limit is served and listed as stale.
    """
    out = base.join(store, key, "left")
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6 - epoch(F.expr("try_cast(fields['stream_computed_at'] AS timestamp_ntz)"))
    out = out.withColumn("age_seconds", age)
    missing, stale = [], []
    for f in REGISTRY.of("stream"):
        raw = F.expr(f"try_cast(fields['{f.name}'] AS {f.dtype})")
        if f.dtype == "double":
            raw = F.when(~F.isnan(raw), raw)
        out = out.withColumn(f.name, F.coalesce(raw, F.lit(f.default).cast(f.dtype)))
        missing.append(F.when(raw.isNull(), F.lit(f.name)))
        stale.append(F.when(raw.isNotNull() & (F.col("age_seconds") > f.sla_seconds), F.lit(f.name)))
    out = out.withColumns({"missing": F.array_compact(F.array(*missing)), "stale": F.array_compact(F.array(*stale))})
    return out.withColumn("degraded", (F.size("missing") > 0) | (F.size("stale") > 0)).drop("fields")


def horizon_rows(base: DataFrame, horizon: int, as_of: datetime) -> DataFrame:
    """A row for each hour of the horizon (1 to 168): time features anew, all else as in `base`."""
    if not 1 <= horizon <= 168:
        raise ValueError("the horizon is 1 to 168 hours")
    steps = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    steps = steps.withColumn("forecast_ts", F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("step")))
    keep = [c for c in base.columns if c not in ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "event_count", "is_holiday")]
    return steps.select(*keep, "step", "forecast_ts", *cyclic_time(F.col("forecast_ts")), F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce(F.col("is_holiday").cast("int"), F.lit(0)).alias("is_holiday"))


def sync_status(batch_ts: Column, synced_ts: Column) -> Column:
    """How a route's batch stands to the last completed sync."""
    return F.when(synced_ts.isNull() | batch_ts.isNull(), "unknown").when(batch_ts == synced_ts, "current").when(batch_ts > synced_ts, "ahead").otherwise("behind")
