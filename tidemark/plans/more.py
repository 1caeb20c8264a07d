"""Further queries of the feature jobs: sources, sinks, streams, training and serving."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import marts, online, quality
from tidemark.operators.staging import latest_by
from tidemark.plans import training
from tidemark.plans.catalog import CYCLES, MART_SQL, ORACLE_PSI_CITY, ROUTE_FEATURES, WEATHER, _psi_sql, r, rs
from tidemark.plans.catalog import ORACLES as ORACLES_OF
from tidemark.plans.views_sql import VIEWS
from tidemark.registry import REGISTRY, registered
from tidemark.sources import envelope, generate, lake, tables
from tidemark.sources.domain import FEATURE_DATE, Domain
from tidemark.sources.paths import delete, fresh, qualified
from tidemark.sources.snapshots import Store
from tidemark.streaming import features as streams

_AS_OF = datetime(2024, 1, 30, 23, 30)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = VIEWS + sql
        return build

    return register


class Live(Domain):
    """The same views over a stream of the events file."""

    @cached_property
    def events(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.dir}/events.parquet").schema
        rows = self.spark.readStream.schema(schema).parquet(f"{self.dir}/events*.parquet")
        return rows.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


# Topic messages


def messages(d: Domain, events: DataFrame | None = None) -> DataFrame:
    """The demand events as envelopes; some of a later version, some without quantity, some no JSON."""
    events = d.demand_events if events is None else events
    also = [c for c in events.columns if c == "timestamp"]
    payload = ["city", "event_type", "sim_ts", "quantity", "temperature_c"]
    version = F.when(F.col("id") % 19 == 0, 99).otherwise(1)
    whole, short = envelope.envelope_json(payload, version), envelope.envelope_json([c for c in payload if c != "quantity"], version)
    value = F.when(F.col("id") % 29 == 0, F.lit("not json").cast("binary")).when(F.col("id") % 23 == 0, short).otherwise(whole)
    return events.select(F.col("city").cast("binary").alias("key"), value.alias("value"), *also)


_REASON = "CASE WHEN id % 29 = 0 OR id % 97 = 0 THEN 'malformed envelope' WHEN id % 19 = 0 THEN 'unknown schema_version 99' WHEN id % 23 = 0 THEN 'missing quantity' END"


@query("src_envelope", f"SELECT event_id, 1 AS schema_version, city, event_type, sim_ts, quantity, temperature_c FROM demand_events WHERE ({_REASON}) IS NULL")
def _(d):
    valid, _dead = envelope.split(messages(d), "demand")
    return envelope.demand_rows(valid).drop("condition")


@query("src_validate", f"SELECT coalesce({_REASON}, 'valid') AS reason, count(*) AS n FROM demand_events GROUP BY 1")
def _(d):
    rows = envelope.decode(messages(d)).withColumn("reason", F.coalesce(envelope.reject_reason("demand"), F.lit("valid")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("src_dlq", f"SELECT city AS key, {_REASON} AS reason, count(*) AS n FROM demand_events WHERE ({_REASON}) IS NOT NULL GROUP BY 1, 2")
def _(d):
    _valid, dead = envelope.split(messages(d), "demand")
    return dead.select(F.col("key").cast("string").alias("key"), F.col("headers")[0]["value"].cast("string").alias("reason")).groupBy("key", "reason").agg(F.count("*").alias("n"))


@query("src_microbatch", f"SELECT event_id, city, event_type, sim_ts FROM demand_events WHERE ({_REASON}) IS NULL")
def _(d):
    """From a topic of files, 2 000 messages a micro-batch."""
    topic, all_, per_file = fresh(d.spark, "topic"), messages(d), 2_000
    envelope.topic_files(all_, topic, per_file)
    return ingested(d, envelope.from_files(d.spark, topic, all_.schema), at_most=per_file).read("demand").select("event_id", "city", "event_type", "sim_ts")


def ingested(d: Domain, stream: DataFrame, path: str | None = None, at_most: int | None = None) -> Store:
    """The store that a stream of messages has been written to."""
    store = path or fresh(d.spark, "store")
    streams.ingest(stream, "demand", store, fresh(d.spark, "point"), at_most=at_most).awaitTermination()
    return Store(d.spark, store)


# Stored tables


@query("snk_insert_ignore", "SELECT id, event_id FROM demand_dup WHERE event_id IS NULL UNION ALL SELECT min(id), event_id FROM demand_dup WHERE event_id IS NOT NULL GROUP BY event_id")
def _(d):
    path = fresh(d.spark, "raw")
    rows = d.demand_dup.select("id", "event_id", "ingested_at")
    tables.insert_ignore(rows.where("id < 10000000"), path)
    tables.insert_ignore(rows.where("id >= 10000000"), path)
    return tables.stored(d.spark, path).select("id", "event_id")


@query("snk_upsert", "SELECT city, hour_ts, CASE WHEN hour(hour_ts) < 6 THEN -1.0::double ELSE round(total_demand, 6) END AS total_demand FROM demand_hourly")
def _(d):
    """By day: the second upsert touches the days that it has rows of."""
    path = fresh(d.spark, "hourly")
    rows = d.demand_hourly.select("city", "hour_ts", *r("total_demand"), F.date_format("hour_ts", "yyyyMMdd").alias("day"))
    tables.upsert(rows, path, ["city", "hour_ts"], by="day")
    tables.upsert(rows.where(F.hour("hour_ts") < 6).withColumn("total_demand", F.lit(-1.0)), path, ["city", "hour_ts"], by="day")
    return tables.stored(d.spark, path).drop("day")


@query("snk_upsert_partial", "SELECT city, hour_ts, CASE WHEN hour(hour_ts) < 6 THEN 0 ELSE event_count END AS event_count, is_holiday FROM mart")
def _(d):
    path = fresh(d.spark, "mart")
    rows = d.mart.select("city", "hour_ts", "event_count", "is_holiday")
    tables.upsert(rows, path, ["city", "hour_ts"])
    new = rows.where(F.hour("hour_ts") < 6).withColumns({"event_count": F.lit(0), "is_holiday": F.lit(None).cast("boolean")})
    tables.upsert(new, path, ["city", "hour_ts"], untouched=["is_holiday"])
    return tables.stored(d.spark, path)


# The lake

_LAKE_NOW = datetime(2024, 2, 2, 10, 15)


def lake_of(d: Domain) -> str:
    root = fresh(d.spark, "lake")
    lake.write_hourly(d.demand_events, root, "demand_events", _LAKE_NOW, catch_up_hours=24 * 40)
    return root


@query("snk_lake_hourly", "SELECT CAST(ingested_at AS date) AS dt, hour(ingested_at)::int AS hour, count(*) AS n FROM demand_events WHERE ingested_at < TIMESTAMP '2024-02-02 10:00:00' GROUP BY 1, 2")
def _(d):
    root = lake_of(d)
    lake.write_hourly(d.demand_events, root, "demand_events", _LAKE_NOW, catch_up_hours=24 * 40)  # all there: adds nothing
    return lake.scan(d.spark, root, "demand_events").groupBy("dt", F.col("hour").cast("int").alias("hour")).agg(F.count("*").alias("n"))


@query("src_lake_scan", "SELECT id, event_id FROM demand_events WHERE ingested_at >= TIMESTAMP '2024-01-10 06:00:00' AND ingested_at < TIMESTAMP '2024-01-12 10:00:00'")
def _(d):
    rows = lake.scan(d.spark, lake_of(d), "demand_events", datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 9), d.demand_events.schema)
    return rows.select("id", "event_id")


@query("src_lake_list", "SELECT count(*) AS objects, 'demand_events' AS table_name FROM (SELECT DISTINCT date_trunc('hour', ingested_at) FROM demand_events)")
def _(d):
    files = lake.listing(d.spark, lake_of(d))
    return files.agg(F.count("*").alias("objects"), F.min(lake.path_parts(F.col("path"))[0]).alias("table_name"))


@query("prj_path", "SELECT DISTINCT CAST(ingested_at AS date) AS dt, lpad(hour(ingested_at)::varchar, 2, '0') AS hour, 'demand_events' AS table_name FROM demand_events")
def _(d):
    table, dt, hour = lake.path_parts(F.col("path"))
    return lake.listing(d.spark, lake_of(d)).select(dt, hour, table.alias("table_name"))


@query("src_backfill", "SELECT count(*) FILTER (event_id IS NULL) AS null_ids, count(DISTINCT event_id) AS ids FROM demand_events WHERE CAST(ingested_at AS date) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'")
def _(d):
    root, path = lake_of(d), fresh(d.spark, "raw")
    lake.backfill(d.spark, root, "demand_events", path, date(2024, 1, 5), date(2024, 1, 6))
    lake.backfill(d.spark, root, "demand_events", path, date(2024, 1, 6), date(2024, 1, 7))
    rows = tables.stored(d.spark, path)
    return rows.dropDuplicates(["id"]).agg(F.count_if(F.col("event_id").isNull()).alias("null_ids"), F.count_distinct("event_id").alias("ids"))


@query("src_replay", f"SELECT event_id, city, event_type, sim_ts FROM demand_events WHERE ({_REASON}) IS NULL AND sim_ts >= TIMESTAMP '2024-01-15 06:00:00'")
def _(d):
    """The messages from a time on, read again into another table from a fresh checkpoint."""
    live = Live(d.spark, d.dir)
    written = live.demand_events.withColumn("timestamp", F.col("sim_ts").cast("timestamp"))
    store = ingested(d, envelope.since(messages(live, written), datetime(2024, 1, 15, 6)))
    return store.read("demand").select("event_id", "city", "event_type", "sim_ts")


@query("src_copy_csv", "SELECT id, event_id, round(quantity, 6) AS quantity FROM demand_events")
def _(d):
    path = fresh(d.spark, "csv")
    d.demand_events.select("id", "event_id", F.round("quantity", 6).alias("quantity")).write.option("nullValue", "\\N").option("emptyValue", "").csv(path)
    return d.spark.read.schema("id bigint, event_id string, quantity double").option("nullValue", "\\N").csv(path)


@query("src_weather_flatten", "SELECT city, polled_at, temperature_c, humidity_pct, precip_mm, condition FROM weather_readings")
def _(d):
    blank = F.lit(None).cast("double")
    nested = F.struct(
        F.struct(F.col("temperature_c").alias("degrees")).alias("temperature"),
        F.struct(blank.alias("degrees")).alias("feelsLikeTemperature"),
        F.struct(blank.alias("degrees")).alias("dewPoint"),
        F.col("humidity_pct").alias("relativeHumidity"),
        F.struct(F.struct(blank.alias("value")).alias("speed"), F.struct(blank.alias("degrees")).alias("direction")).alias("wind"),
        blank.alias("cloudCover"),
        F.struct(F.struct(blank.alias("percent")).alias("probability"), F.struct(F.col("precip_mm").alias("quantity")).alias("qpf")).alias("precipitation"),
        F.struct(F.col("condition").alias("type")).alias("weatherCondition"),
    )
    return generate.flattened(d.weather_readings.withColumn("response", nested)).select("city", "polled_at", *WEATHER, "condition")


@query("src_chaos")
def _(d):
    return generate.with_faults(d.weather_readings.select("id", *WEATHER), 0.1, ("temperature_c", "temp")).agg(F.count("*").alias("n"), F.count("temp").alias("n_temp"))


_ROUTES = ORACLES_OF["jn_assemble"][len(VIEWS) :]


@query("prj_registry", f"SELECT * EXCLUDE (feature_date) FROM ({_ROUTES})")
def _(d):
    rows = marts.route_features(d.mart, d.demand_events, FEATURE_DATE)
    return registered(rows, "batch", ["route_id"]).select("route_id", *r(*ROUTE_FEATURES))


@query("snk_hset", f"SELECT * EXCLUDE (feature_date), '2024-01-30T23:30:00' AS batch_computed_at, '2024-01-30T23:30:00' AS completed_at FROM ({_ROUTES})")
def _(d):
    """The last of two days of each route, all batch features of the registry: sent by the tasks in batches to a store of files, then the marker; and read back from both."""
    store, marker = qualified(d.spark, fresh(d.spark, "hashes")), fresh(d.spark, "marker")
    days = [marts.route_features(d.mart, d.demand_events, day) for day in (FEATURE_DATE - timedelta(days=1), FEATURE_DATE)]
    last = latest_by(days[0].unionByName(days[1]), "route_id", "feature_date")
    sent = online.as_hash(last, "route_id", [f.name for f in REGISTRY.of("batch")])
    finish = lambda at: d.spark.createDataFrame([(at,)], "completed_at string").write.parquet(marker)
    tables.sync(sent, tables.parquet_store(store), finish, _AS_OF.isoformat())
    kept = d.spark.read.schema("key string, fields map<string,string>").parquet(store)
    values = [(F.round(F.try_element_at("fields", F.lit(c)).cast("double"), 6) + 0.0).alias(c) for c in ROUTE_FEATURES]
    return kept.select(F.col("key").alias("route_id"), *values, F.col("fields")["batch_computed_at"].alias("batch_computed_at")).join(
        F.broadcast(d.spark.read.schema("completed_at string").parquet(marker)),
        F.lit(True),  # one row
    )


# Set operations


@query("set_union", "SELECT city, kind FROM (SELECT city, 'demand' AS kind FROM demand_hourly UNION ALL SELECT city, 'weather' FROM weather_hourly) GROUP BY 1, 2")
def _(d):
    both = d.demand_hourly.select("city", F.lit("demand").alias("kind")).unionByName(d.weather_hourly.select("city", F.lit("weather").alias("kind")), allowMissingColumns=True)
    return both.distinct()


@query("set_except", "SELECT city, hour_ts FROM demand_hourly EXCEPT SELECT city, hour_ts FROM weather_hourly")
def _(d):
    return d.demand_hourly.select("city", "hour_ts").exceptAll(d.weather_hourly.select("city", "hour_ts"))


# Streams and replay

@query("st_sliding", "SELECT route_id, id, epoch_us(sim_ts) AS sim_us, searches_5m, bookings_15m, searches_1h, bookings_1h, round(bookings_1h / greatest(searches_1h, 1), 6) AS look_to_book_1h FROM sliding")
def _(d):
    spark = d.spark
    return streams.latest(streams.finished(streams.sliding(Live(spark, d.dir).demand_events), fresh(spark, "sliding"), fresh(spark, "point")))


@query("st_dedup", "SELECT DISTINCT event_id FROM demand_events")
def _(d):
    spark = d.spark
    return streams.finished(streams.once(Live(spark, d.dir).demand_events).select("event_id"), fresh(spark, "once"), fresh(spark, "point"))


@query("snk_lake_stream", "SELECT CAST(sim_ts AS date) AS dt, hour(sim_ts)::int AS hour, count(*) AS n FROM demand_events GROUP BY 1, 2")
def _(d):
    path = fresh(d.spark, "stream")
    streams.to_lake(Live(d.spark, d.dir).demand_events, path, fresh(d.spark, "point")).awaitTermination()
    return d.spark.read.parquet(path).groupBy("dt", F.col("hour").cast("int").alias("hour")).agg(F.count("*").alias("n"))


@query("st_skip", f"SELECT ({_REASON}) IS NULL AS ok, count(*) AS n FROM demand_events GROUP BY 1")
def _(d):
    """A stream over all messages whose batch is run again: the ones it skips are in the dead letters, the others in the table, once."""
    stream, path = messages(Live(d.spark, d.dir)), fresh(d.spark, "store")
    point = fresh(d.spark, "point")
    streams.ingest(stream, "demand", path, point).awaitTermination()
    delete(d.spark, f"{point}/commits")  # as if the stream had died before it noted that the batch is done
    streams.ingest(stream, "demand", path, point).awaitTermination()
    store = Store(d.spark, path)
    both = store.read("demand").select(F.lit(True).alias("ok")).unionByName(store.read(streams.DEAD).select(F.lit(False).alias("ok")))
    return both.groupBy("ok").agg(F.count("*").alias("n"))


@query(
    "st_latest",
    "SELECT city AS route_id, arg_max(temperature_c, (polled_at, id)) AS weather_temp_c, round(arg_max(precip_mm, (polled_at, id)), 6) AS weather_precip_mm, arg_max(condition, (polled_at, id)) AS weather_condition, max(polled_at) AS stream_computed_at FROM weather_readings GROUP BY 1",
)
def _(d):
    return online.latest_weather(d.weather_readings).withColumn("weather_precip_mm", F.round("weather_precip_mm", 6))


def _asks(d: Domain) -> DataFrame:
    return d.demand_hourly.select(F.col("city").alias("route_id"), F.expr("timestampadd(MINUTE, 30, hour_ts)").alias("at"))


_REBUILT = """SELECT a.route_id, a.at, count(DISTINCT CASE WHEN event_type = 'search' AND t >= s - 300 THEN event_id END) AS searches_5m,
  count(DISTINCT CASE WHEN event_type = 'booking' AND t >= s - 900 THEN event_id END) AS bookings_15m,
  count(DISTINCT CASE WHEN event_type = 'search' THEN event_id END) AS searches_1h, count(DISTINCT CASE WHEN event_type = 'booking' THEN event_id END) AS bookings_1h, count(*) AS rows_scanned
  FROM (SELECT city AS route_id, hour_ts + interval 30 minute AS at, epoch(hour_ts + interval 30 minute) AS s FROM demand_hourly) a
  JOIN (SELECT *, epoch(sim_ts) AS t FROM demand_events) e ON e.city = a.route_id AND e.t BETWEEN a.s - 3600 AND a.s GROUP BY 1, 2"""


@query("st_reconstruct", f"SELECT *, round(bookings_1h / greatest(searches_1h, 1), 6) AS look_to_book_1h FROM ({_REBUILT})")
def _(d):
    return online.reconstruct(d.demand_events, _asks(d))


@query(
    "st_verify",
    """SELECT feature, ok, count(*) AS n FROM (SELECT s.route_id, s.sim_ts, s.searches_5m + (s.id % 41 = 0)::int AS searches_5m, s.bookings_15m,
         count(DISTINCT CASE WHEN e.event_type = 'search' AND e.t >= epoch(s.sim_ts) - 300 THEN e.event_id END) AS r5,
         count(DISTINCT CASE WHEN e.event_type = 'booking' AND e.t >= epoch(s.sim_ts) - 900 THEN e.event_id END) AS r15
       FROM sliding s JOIN (SELECT *, epoch(sim_ts) AS t FROM demand_events) e ON e.city = s.route_id AND e.t BETWEEN epoch(s.sim_ts) - 3600 AND epoch(s.sim_ts) GROUP BY ALL),
    LATERAL (VALUES ('searches_5m', abs(r5 - searches_5m) < 0.001), ('bookings_15m', abs(r15 - bookings_15m) < 0.001)) v(feature, ok) GROUP BY 1, 2""",
)
def _(d):
    """The served windows, some of them off by one, against a replay of the events."""
    path = fresh(d.spark, "served")
    off = F.col("searches_5m") + (F.col("id") % 41 == 0).cast("int")
    online.sliding_features(d.demand_events).withColumnRenamed("sim_ts", "at").withColumn("searches_5m", off).write.parquet(path)
    served = d.spark.read.parquet(path)
    rebuilt = online.reconstruct(d.demand_events, served.select("route_id", "at").distinct())
    return online.verify(rebuilt, served, ["route_id", "at"], ["searches_5m", "bookings_15m"]).groupBy("feature", "ok").agg(F.count("*").alias("n"))


# Training


@query("ml_split", "SELECT part, count(*) AS n, min(hour_ts) AS first_at FROM (SELECT hour_ts, CASE WHEN hour_ts >= (SELECT max(hour_ts) FROM mart) - interval 7 day THEN 'val' ELSE 'train' END AS part FROM mart) GROUP BY 1")
def _(d):
    parts = [p.withColumn("part", F.lit(n)) for p, n in zip(training.split(d.stored_mart, 7), ("train", "val"), strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("part").agg(F.count("*").alias("n"), F.min("hour_ts").alias("first_at"))


@query("ml_naive", "SELECT city, hour_ts, round(coalesce(demand_lag_24h, (SELECT quantile_cont(total_demand, 0.5) FROM mart WHERE hour_ts < (SELECT max(hour_ts) FROM mart) - interval 7 day)), 6) AS prediction FROM mart WHERE hour_ts >= (SELECT max(hour_ts) FROM mart) - interval 7 day")
def _(d):
    return training.naive(*training.split(d.stored_mart, 7)).select("city", "hour_ts", *r("prediction"))


_Z = training.TRAINER_NUMERIC
_FILLED = "(SELECT city, hour_ts, " + ", ".join(f"coalesce({c}::double, (SELECT quantile_cont({c}::double, 0.5) FROM mart)) AS {c}" for c in _Z) + " FROM mart)"


@query("ml_prep", "SELECT hour_ts, city, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) + 0.0::double AS z_{c}" for c in _Z) + f" FROM {_FILLED}")
def _(d):
    prep = training.fit_preparation(d.stored_mart)
    return prep.transform(d.stored_mart, ("hour_ts", "city")).select(F.col("key_hour_ts").alias("hour_ts"), F.col("key_city").alias("city"), *r(*[f"z_{c}" for c in _Z], n=5))


@query("ml_fit_once", "SELECT 'demand_lag_1h' AS feature, round(quantile_cont(demand_lag_1h, 0.5), 6) + 0.0::double AS median FROM mart")
def _(d):
    path = fresh(d.spark, "preparation")
    training.fit_once(d.mart, path)
    again = training.fit_once(d.mart.withColumn("demand_lag_1h", F.lit(9e9)), path)  # the kept one is used
    return d.spark.createDataFrame([("demand_lag_1h", round(again.medians["demand_lag_1h"], 6))], "feature string, median double")


@query("src_batch_fail", "SELECT 'store' AS reason, count(*) AS n FROM demand_events")
def _(d):
    """A store whose table has other columns: all messages become dead letters."""
    store = Store(d.spark, fresh(d.spark, "store"))
    store.append({"demand": d.spark.range(1).select(F.array("id").alias("event_id"))})
    dead = ingested(d, messages(Live(d.spark, d.dir)), store.path).read(streams.DEAD)
    return dead.groupBy(F.substring_index(F.col("headers")[0]["value"].cast("string"), ":", 1).alias("reason")).agg(F.count("*").alias("n"))


_SC = training.WORKER_NUMERIC
_THERE = " AND ".join(f"{c} IS NOT NULL" for c in _SC)


@query("ml_scaler", "SELECT city, hour_ts, " + ", ".join(f"round(CASE WHEN {_THERE} THEN ({c} - (SELECT avg({c}) FROM mart WHERE {_THERE})) / (SELECT stddev_pop({c}) FROM mart WHERE {_THERE}) ELSE {c} END, 5) + 0.0::double AS {c}" for c in _SC) + " FROM mart")
def _(d):
    return training.scaled(d.stored_mart, *training.complete_scaler(d.stored_mart, _SC)).select("city", "hour_ts", *r(*_SC, n=5))


def _trained(d: Domain, fit) -> DataFrame:
    train, val = training.split(d.stored_mart, 7)
    prep = training.fit_preparation(train)
    return training.predicted(fit(train, prep), val, prep)


@query("ml_ridge")
def _(d):
    return _trained(d, training.fit_ridge)


_CANDIDATES = ("demand_lag_24h", "demand_roll_3h", "demand_roll_24h")
_CUT = "hour_ts < (SELECT max(hour_ts) FROM mart) - interval 7 day"
_ERRORS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, avg(abs(total_demand - (i + s * {c}))) AS mae FROM mart, (SELECT regr_slope(total_demand, {c}) AS s, regr_intercept(total_demand, {c}) AS i FROM mart WHERE {_CUT}) WHERE NOT ({_CUT})" for c in _CANDIDATES
) + f" UNION ALL SELECT 'baseline', avg(abs(total_demand - coalesce(demand_lag_24h, (SELECT quantile_cont(total_demand, 0.5) FROM mart WHERE {_CUT})))) FROM mart WHERE NOT ({_CUT})"


def _errors(d: Domain) -> dict[str, float]:
    """Validation errors (mae) of the baseline and of a line through each candidate feature."""
    train, val = training.split(d.stored_mart, 7)
    lines = train.agg(*[f(training.TARGET, c).alias(f"{n}_{c}") for c in _CANDIDATES for n, f in (("s", F.regr_slope), ("i", F.regr_intercept))]).first()
    gaps = [F.avg(F.abs(F.col(training.TARGET) - (F.lit(lines[f"i_{c}"]) + F.lit(lines[f"s_{c}"]) * F.col(c)))).alias(c) for c in _CANDIDATES]
    of = val.agg(*gaps).first().asDict()
    return {**of, "baseline": training.metrics(training.naive(train, val), training.TARGET, "prediction").first()["mae"]}


@query("ml_select", f"SELECT name, round(mae, 4) AS mae, name = (SELECT arg_min(name, mae) FROM ({_ERRORS}) WHERE name <> 'baseline') AS chosen FROM ({_ERRORS})")
def _(d):
    errors = _errors(d)
    chosen = training.best(errors)
    return d.spark.createDataFrame([(n, round(e, 4), n == chosen) for n, e in errors.items()], "name string, mae double, chosen boolean")


GATE_PSI = "(" + " UNION ALL ".join(f"SELECT * FROM {_psi_sql(c)}" for c in WEATHER) + f" UNION ALL {ORACLE_PSI_CITY})"


_KS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(max(abs(a - b)), 6) AS ks FROM (SELECT v, sum(r) OVER (ORDER BY v) / sum(r) OVER () AS a, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS b FROM (SELECT {c}::double AS v, count(*) FILTER (hour_ts < TIMESTAMP '2024-01-15') AS r, count(*) FILTER (hour_ts >= TIMESTAMP '2024-01-15') AS c FROM mart WHERE {c} IS NOT NULL GROUP BY 1))"
    for c in WEATHER
)


@query("ml_ks", _KS)
def _(d):
    cut = "TIMESTAMP_NTZ '2024-01-15'"
    return quality.ks_statistic(d.stored_mart.where(f"hour_ts < {cut}"), d.stored_mart.where(f"hour_ts >= {cut}"), *WEATHER).select("feature", *r("ks"))

# Serving


def _store(d: Domain) -> DataFrame:
    """The online hash of each route: the last sliding features and weather; one route's ratio cannot be read."""
    slid = online.sliding_features(d.demand_events)
    last = slid.groupBy("route_id").agg(F.max_by(F.struct("searches_5m", "bookings_15m", "look_to_book_1h"), F.struct("sim_ts", "id")).alias("s")).select("route_id", "s.*")
    rows = last.join(online.latest_weather(d.weather_readings), "route_id", "full_outer")
    rows = rows.withColumn("look_to_book_1h", F.when(F.col("route_id") == "tokyo", "oops").otherwise(F.col("look_to_book_1h").cast("string")))
    rows = rows.withColumn("weather_precip_mm", F.when(F.col("route_id") != "dubai", F.round("weather_precip_mm", 6)))
    fields = ["searches_5m", "bookings_15m", "look_to_book_1h", "weather_temp_c", "weather_precip_mm", "weather_condition", "stream_computed_at"]
    return online.as_hash(rows, "route_id", fields)


_LAST_SLIDE = "(SELECT route_id, arg_max({'s': searches_5m, 'b': bookings_15m, 'l': round(bookings_1h / greatest(searches_1h, 1), 6)}, (sim_ts, id)) AS x FROM sliding GROUP BY 1)"
_LAST_WX = "(SELECT city AS route_id, arg_max({'t': temperature_c, 'p': precip_mm, 'c': condition}, (polled_at, id)) AS y, max(polled_at) AS computed FROM weather_readings GROUP BY 1)"


@query(
    "sv_online",
    f"""SELECT route_id, x.s::double AS searches_5m, x.b::double AS bookings_15m, CASE WHEN route_id = 'tokyo' THEN 0.0::double ELSE x.l END AS look_to_book_1h, y.t AS weather_temp_c,
    CASE WHEN route_id = 'dubai' THEN 0.0::double ELSE round(y.p, 6) END AS weather_precip_mm, y.c AS weather_condition,
    CASE route_id WHEN 'tokyo' THEN 'look_to_book_1h' WHEN 'dubai' THEN 'weather_precip_mm' ELSE '' END AS missing,
    epoch(TIMESTAMP '2024-01-30 23:30:00') - epoch(computed) > 300 AS stale_5m FROM {_LAST_SLIDE} JOIN {_LAST_WX} USING (route_id)""",
)
def _(d):
    base = d.demand_hourly.select(F.col("city").alias("route_id")).distinct()
    out = online.online_overlay(base, _store(d), _AS_OF)
    return out.select("route_id", "searches_5m", "bookings_15m", "look_to_book_1h", "weather_temp_c", "weather_precip_mm", "weather_condition", F.array_join("missing", ",").alias("missing"), F.array_contains("stale", "searches_5m").alias("stale_5m"))


def _base(d: Domain) -> DataFrame:
    return latest_by(d.mart, "city", "hour_ts")


@query(
    "sv_rows",
    "SELECT city, step::int AS step, TIMESTAMP '2024-01-30 23:30:00' + step * interval 1 hour AS forecast_ts, event_count, is_holiday::int AS is_holiday, "
    "round(sin(2 * pi() * hour(TIMESTAMP '2024-01-30 23:30:00' + step * interval 1 hour) / 24), 6) + 0.0::double AS hour_sin, round(cos(2 * pi() * (isodow(TIMESTAMP '2024-01-30 23:30:00' + step * interval 1 hour) - 1) / 7), 6) + 0.0::double AS dow_cos, round(total_demand, 6) + 0.0::double AS total_demand "
    "FROM (SELECT * FROM mart QUALIFY row_number() OVER (PARTITION BY city ORDER BY hour_ts DESC) = 1), (SELECT unnest(range(0, 48)) AS step)",
)
def _(d):
    return online.horizon_rows(_base(d), 48, _AS_OF).select("city", "step", "forecast_ts", "event_count", "is_holiday", *r("hour_sin", "dow_cos", "total_demand"))


def _daily_scores(d: Domain) -> DataFrame:
    """A score a day and city, as drift reports are: the relative gap of the day's mean to the city's."""
    days = marts.daily(d.mart, date(2024, 1, 30))
    overall = days.groupBy("city").agg(F.avg("daily_demand").alias("mean"))
    return days.join(overall, "city").select(F.col("day").alias("checked_at"), F.col("city").alias("feature_name"), F.abs(F.col("daily_demand") / F.col("mean") - 1).alias("drift_score"))


_SCORES = "(SELECT day AS checked_at, city AS feature_name, abs(daily_demand / avg(daily_demand) OVER (PARTITION BY city) - 1) AS drift_score FROM (SELECT city, CAST(hour_ts AS date) AS day, sum(total_demand) AS daily_demand FROM mart WHERE CAST(hour_ts AS date) <= DATE '2024-01-30' GROUP BY 1, 2))"


def drift_scores(reports: DataFrame) -> DataFrame:
    """The last finite score of each feature, and whether it counts as detected."""
    last = reports.where("drift_score IS NOT NULL AND NOT isnan(drift_score) AND drift_score < double('Infinity')").groupBy("feature_name").agg(F.max_by("drift_score", "checked_at").alias("score"))
    return last.select("feature_name", F.round("score", 6).alias("score"), (F.col("score") > 0.2).alias("detected")).orderBy(F.desc("score"))


@query("sv_drift_scores", f"SELECT feature_name, round(s, 6) AS score, s > 0.2 AS detected FROM (SELECT feature_name, arg_max(drift_score, checked_at) AS s FROM {_SCORES} GROUP BY 1)")
def _(d):
    return drift_scores(_daily_scores(d))


_PIVOT = ("london", "new_york", "tokyo")


@query("ag_drift_pivot", "SELECT checked_at, " + ", ".join(f"round(max(drift_score) FILTER (feature_name = '{c}'), 6) AS {c}" for c in _PIVOT) + f" FROM {_SCORES} GROUP BY 1")
def _(d):
    return _daily_scores(d).groupBy("checked_at").pivot("feature_name", list(_PIVOT)).agg(F.round(F.max("drift_score"), 6))


@query("sv_sentinel", "SELECT city AS route_id, CASE WHEN m = TIMESTAMP '2024-01-30 23:00:00' THEN 'current' WHEN m > TIMESTAMP '2024-01-30 23:00:00' THEN 'ahead' ELSE 'behind' END AS status FROM (SELECT city, max(hour_ts) AS m FROM mart GROUP BY 1)")
def _(d):
    last = d.mart.groupBy(F.col("city").alias("route_id")).agg(F.max("hour_ts").alias("m"))
    return last.select("route_id", online.sync_status(F.col("m"), F.lit(datetime(2024, 1, 30, 23)).cast("timestamp_ntz")).alias("status"))


_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feat, {c in quality.ONLINE} AS on_, d_{c} > 0.01 AS off, is_stale FROM joined" for c in [*quality.OFFLINE, *quality.ONLINE]) + ")"


@query("sv_skew_verdict", f"SELECT feat, n, fresh, CASE WHEN n = 0 THEN 'clean' WHEN on_ THEN 'online_override' WHEN fresh > 0 THEN 'code_bug' ELSE 'stale_drift' END AS verdict FROM (SELECT feat, on_, count(*) FILTER (off) AS n, count(*) FILTER (off AND NOT is_stale) AS fresh FROM {_LONG} GROUP BY 1, 2)")
def _(d):
    return quality.skew_verdicts(quality.joined(d.prediction_features, d.mart))


@query("sv_shadow")
def _(d):
    train, val = training.split(d.stored_mart, 7)
    prep = training.fit_preparation(train)
    one = training.predicted(training.fit_ridge(train, prep), val, prep)
    two = training.predicted(training.fit_ridge(train, prep, alpha=100.0), val, prep).select("city", "hour_ts", F.col("prediction").alias("shadow"))
    return one.join(two, ["city", "hour_ts"]).groupBy("city").agg(F.avg(F.abs(F.col("prediction") - F.col("shadow"))).alias("gap"))


#: What is wrong with each mart that the checks are put to.
_MARTS = {
    "whole": {},
    "nulls": {"event_count": "CASE WHEN hour(hour_ts) <> 3 THEN event_count END", "total_demand": "CASE WHEN hour(hour_ts) <> 4 THEN total_demand END", "temperature_c": "CASE WHEN hour(hour_ts) = 5 AND day(hour_ts) = 5 THEN temperature_c END"},
    "rows lost": {},
    "empty": {},
}
_ROWS = {"rows lost": "hour(hour_ts) <> 7", "empty": "false"}
_SOFT = (("demand_lag_1h", 0.5), ("temperature_c", 0.9))


def _quality_sql(name: str) -> str:
    col = lambda c: _MARTS[name].get(c, c)
    hard = " + ".join(f"coalesce(max(({col(c)} IS NULL)::int), 0)" for c in marts.NEVER_NULL)
    soft = " + ".join(f"coalesce((avg(({col(c)} IS NULL)::int) > {limit}::double)::int, 0)" for c, limit in _SOFT)
    return f"SELECT '{name}' AS mart, ((count(*) = 0)::int + (count(*) <> (SELECT count(*) FROM demand_hourly))::int + {hard})::int AS errors, ({soft})::int AS warnings FROM mart WHERE {_ROWS.get(name, 'true')}"


@query("dq_assert", " UNION ALL ".join(map(_quality_sql, _MARTS)))
def _(d):
    """The mart as it is, and three that are broken."""
    out = []
    for name, changes in _MARTS.items():
        rows = d.mart.where(_ROWS.get(name, "true")).withColumns({c: F.expr(e) for c, e in changes.items()})
        errors, warnings = marts.quality_report(rows, d.demand_hourly)
        out.append((name, len(errors), len(warnings)))
    return d.spark.createDataFrame(out, "mart string, errors int, warnings int")


@query("jn_overlay", "SELECT m.city, m.hour_ts, round(coalesce(o.t, m.temperature_c), 6) + 0.0::double AS temperature_c FROM mart m LEFT JOIN (SELECT city, arg_max(temperature_c, (polled_at, id)) AS t FROM weather_readings GROUP BY 1) o USING (city)")
def _(d):
    live = online.latest_weather(d.weather_readings).select(F.col("route_id").alias("city"), "weather_temp_c")
    return d.mart.join(live, "city", "left").select("city", "hour_ts", F.coalesce("weather_temp_c", "temperature_c").alias("temperature_c")).select("city", "hour_ts", *r("temperature_c"))


@query("olap_monthly", MART_SQL.replace("FROM mart", "FROM mart WHERE hour_ts >= TIMESTAMP '2024-01-01'"))
def _(d):
    path = fresh(d.spark, "monthly")
    lake.write_monthly(d.mart, path)
    rows = d.spark.read.parquet(path).where("month = 202401")
    return rows.select("city", "hour_ts", "event_count", "is_holiday", *r("total_demand", "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_3h", "demand_roll_24h", *CYCLES, *WEATHER))
