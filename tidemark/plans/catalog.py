"""Queries of the feature jobs by inventory id, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as fn
from tidemark.operators import marts, online, quality, staging
from tidemark.plans.views_sql import VIEWS
from tidemark.sources.domain import FEATURE_DATE, Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2024, 1, 20, 12, 30)
START, END = datetime(2024, 1, 10), datetime(2024, 1, 20)
WEATHER = ("temperature_c", "humidity_pct", "precip_mm")
LAGGED = ("demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_3h", "demand_roll_24h")
CYCLES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")


def query(name: str, sql: str | None = None):
    """Registers a function of the domain views under an inventory id, with the SELECT that follows VIEWS."""

    def register(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = VIEWS + sql
        return build

    return register


def r(*names: str, n: int = 6) -> list:
    return [(F.round(F.col(c).cast("double"), n) + F.lit(0.0)).alias(c) for c in names]  # the sum makes -0 a 0


def rs(*names: str, n: int = 6) -> str:
    return ", ".join(f"round({c}::double, {n}) + 0.0::double AS {c}" for c in names)


MART_SQL = f"SELECT city, hour_ts, event_count, is_holiday, {rs('total_demand', *LAGGED, *CYCLES, *WEATHER)} FROM mart"


@query("mart_city_hour", MART_SQL)
def _(d):
    return d.mart.select("city", "hour_ts", "event_count", "is_holiday", *r("total_demand", *LAGGED, *CYCLES, *WEATHER))


# Filters, projections, scalar functions


@query("flt_window", "SELECT id, event_id, ingested_at FROM demand_events WHERE ingested_at >= TIMESTAMP '2024-01-10' AND ingested_at < TIMESTAMP '2024-01-20'")
def _(d):
    return staging.ingested(d.demand_events, START, END).select("id", "event_id", "ingested_at")


@query("flt_lookback", "SELECT count(*) AS n, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM demand_events WHERE ingested_at >= TIMESTAMP '2024-01-13 12:00:00' AND ingested_at < TIMESTAMP '2024-01-20 12:00:00'")
def _(d):
    rows = staging.ingested(d.demand_events, *staging.ingest_window(NOW, 7))
    return rows.agg(F.count("*").alias("n"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"))


@query("flt_pit", "SELECT id FROM demand_events WHERE CAST(sim_ts AS date) > DATE '2024-01-20' - 10 AND CAST(sim_ts AS date) <= DATE '2024-01-20'")
def _(d):
    return d.demand_events.where(marts._since("sim_ts", FEATURE_DATE, 10)).select("id")


@query("prj_reject", "SELECT id, reject_reason FROM demand_classified WHERE reject_reason IS NOT NULL")
def _(d):
    return staging.classify_demand(staging.dedup(d.demand_events)).where("reject_reason IS NOT NULL").select("id", "reject_reason")


@query("prj_cast", "SELECT id, floor(quantity)::int AS quantity_int, temperature_c::double AS temp, id::bigint AS id_long, TRY_CAST(event_id AS int) AS id_int FROM demand_events")
def _(d):
    whole = F.floor("quantity").cast("int")
    return d.demand_events.select("id", whole.alias("quantity_int"), F.col("temperature_c").cast("double").alias("temp"), F.col("id").cast("long").alias("id_long"), F.expr("try_cast(event_id AS int)").alias("id_int"))


@query("fn_trunc", "SELECT id, date_trunc('hour', sim_ts) AS hour_ts FROM demand_events")
def _(d):
    return d.demand_events.select("id", fn.hour_of(F.col("sim_ts")).alias("hour_ts"))


@query("fn_extract", "SELECT id, hour(sim_ts)::int AS h, isodow(sim_ts)::int AS dow, round(epoch(sim_ts), 3) AS epoch_s FROM demand_events")
def _(d):
    ts = F.col("sim_ts")
    return d.demand_events.select("id", F.hour(ts).alias("h"), fn.iso_weekday(ts).alias("dow"), F.round(fn.epoch(ts), 3).alias("epoch_s"))


@query("fn_cyclic", f"SELECT DISTINCT hour_ts, {rs(*CYCLES)} FROM mart")
def _(d):
    return d.demand_hourly.select("hour_ts").distinct().select("hour_ts", *fn.cyclic_time(F.col("hour_ts"))).select("hour_ts", *r(*CYCLES))


@query("fn_safe_div", "SELECT id, round(quantity / nullif(id % 3, 0), 6) AS ratio FROM demand_events")
def _(d):
    return d.demand_events.select("id", F.round(fn.safe_div(F.col("quantity"), F.col("id") % 3), 6).alias("ratio"))


@query("fn_coalesce", "SELECT city, hour_ts, round(coalesce(demand_lag_24h, 0.0), 6) AS lag_24, round(coalesce(precip_mm, 0.0), 6) AS precip FROM mart")
def _(d):
    return d.mart.select("city", "hour_ts", F.round(F.coalesce("demand_lag_24h", F.lit(0.0)), 6).alias("lag_24"), F.round(F.coalesce("precip_mm", F.lit(0.0)), 6).alias("precip"))


@query("fn_math", "SELECT id, round(abs(temperature_c), 4) AS a, round(ln(quantity + 1), 6) AS l, round(exp(-abs(temperature_c) / 10), 6) AS e, round(sqrt(quantity), 6) AS s, greatest(0.0, least(30.0, temperature_c))::double AS clamped FROM demand_events")
def _(d):
    q, t = F.col("quantity"), F.col("temperature_c")
    return d.demand_events.select("id", F.round(F.abs(t), 4).alias("a"), F.round(F.log(q + 1), 6).alias("l"), F.round(F.exp(-F.abs(t) / 10), 6).alias("e"), F.round(F.sqrt(q), 6).alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(30.0), t)).alias("clamped"))


@query("fn_tochar", "SELECT city, strftime(hour_ts, '%Y-%m-%d %H:%M') AS label FROM demand_hourly")
def _(d):
    return d.demand_hourly.select("city", F.date_format("hour_ts", "yyyy-MM-dd HH:mm").alias("label"))


@query("fn_holiday", "SELECT m.city, CAST(hour_ts AS date) AS day, bool_or(h.holiday IS NOT NULL) AS is_holiday FROM demand_hourly m LEFT JOIN hol h ON h.city = m.city AND h.holiday = CAST(m.hour_ts AS date) GROUP BY 1, 2")
def _(d):
    return marts.with_holidays(d.demand_hourly, d.holidays).groupBy("city", F.to_date("hour_ts").alias("day")).agg(F.bool_or("is_holiday").alias("is_holiday"))


_POINTS = ", ".join(f"'{p}'" for p in "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split())


@query(
    "fn_wx_derived",
    f"""SELECT id, ([{_POINTS}])[CAST(round_even((id % 360) / 22.5, 0) AS int) % 16 + 1] AS wind,
    CASE WHEN hour(polled_at) < 6 OR hour(polled_at) > 20 THEN 0 ELSE greatest(0, least(11, CAST(round_even(sin((hour(polled_at) - 6) * (pi() / 14)) * 10 * (1 - (id % 100) / 150), 0) AS int))) END::int AS uv,
    round(round(greatest(1.0, least(20.0, 20.0::double - (humidity_pct - 50) * 0.1::double - (id % 100) * 0.05::double)), 6), 1) AS visibility,
    CASE WHEN id % 97 >= 70 THEN 'HEAVY_RAIN' WHEN id % 97 >= 40 THEN 'RAIN' WHEN id % 97 >= 20 THEN 'DRIZZLE' WHEN id % 100 >= 90 THEN 'CLOUDY'
         WHEN id % 100 >= 70 THEN 'MOSTLY_CLOUDY' WHEN id % 100 >= 40 THEN 'PARTLY_CLOUDY_DAY' WHEN id % 100 >= 20 THEN 'MOSTLY_CLEAR' ELSE 'CLEAR_DAY' END AS label FROM weather_readings""",
)
def _(d):
    cloud = F.col("id") % 100
    return d.weather_readings.select("id", fn.compass(F.col("id") % 360).alias("wind"), fn.uv_index(F.hour("polled_at"), cloud).alias("uv"), fn.visibility_km(F.col("humidity_pct"), cloud).alias("visibility"), fn.condition(cloud, F.col("id") % 97).alias("label"))


@query(
    "fn_hash16",
    """SELECT left(sha256(string_agg(g, '' ORDER BY g)), 16) AS hash16 FROM (SELECT sha256(string_agg(g, '' ORDER BY g)) AS g FROM (
    SELECT left(digest, 6) AS p, sha256(string_agg(digest, '' ORDER BY digest)) AS g FROM (
    SELECT sha256(city || '|' || hour_ts::varchar || '|' || coalesce(total_demand::decimal(18, 4)::varchar, '')) AS digest FROM mart) GROUP BY 1) GROUP BY left(p, 3))""",
)
def _(d):
    return fn.snapshot_hash(d.mart.select("city", "hour_ts", F.col("total_demand").cast("decimal(18,4)").alias("total_demand")), ["city", "hour_ts"], "total_demand")


# Joins


@query("jn_weather", f"SELECT city, hour_ts, event_count, {rs('total_demand', *WEATHER)} FROM demand_hourly LEFT JOIN weather_hourly USING (city, hour_ts)")
def _(d):
    return marts.with_weather(d.demand_hourly, d.weather_hourly).select("city", "hour_ts", "event_count", *r("total_demand", *WEATHER))


@query(
    "jn_inner",
    "SELECT city, dow, round(dow_avg / nullif(overall, 0), 6) AS ratio FROM (SELECT city, isodow(day)::int AS dow, avg(daily_bookings) AS dow_avg FROM daily GROUP BY 1, 2) JOIN (SELECT city, avg(daily_bookings) AS overall FROM daily GROUP BY 1) USING (city)",
)
def _(d):
    days = marts.daily(d.mart, FEATURE_DATE)
    by_dow = days.groupBy("city", fn.iso_weekday(F.col("day")).alias("dow")).agg(F.avg("daily_bookings").alias("dow_avg"))
    return by_dow.join(days.groupBy("city").agg(F.avg("daily_bookings").alias("overall")), "city").select("city", "dow", F.round(fn.safe_div(F.col("dow_avg"), F.col("overall")), 6).alias("ratio"))


_DAYS = [f"seasonality_{x}" for x in marts.DAYS]
_SEASON = ", ".join(f"avg(daily_bookings) FILTER (isodow(day) = {i + 1}) / nullif(avg(daily_bookings), 0) AS {c}" for i, c in enumerate(_DAYS))
_LEADS = "SELECT city, quantile_cont(l, 0.5) AS lead_time_p50, quantile_cont(l, 0.9) AS lead_time_p90 FROM (SELECT city, (epoch_us(ingested_at) - epoch_us(sim_ts)) / 3.6e9::double AS l FROM demand_events WHERE CAST(sim_ts AS date) > DATE '2024-01-20' - 90 AND CAST(sim_ts AS date) <= DATE '2024-01-20' AND city IS NOT NULL) WHERE l >= 0 GROUP BY city"
_CANCEL = "SELECT city, count(*) FILTER (event_type = 'cancellation') / count(*) AS cancellation_rate_180d FROM demand_events WHERE CAST(sim_ts AS date) > DATE '2024-01-20' - 180 AND CAST(sim_ts AS date) <= DATE '2024-01-20' AND city IS NOT NULL GROUP BY city"
_CORR = "SELECT city, CASE WHEN stddev_pop(temperature_c) * stddev_pop(total_demand) > 0 THEN covar_pop(temperature_c, total_demand) / (stddev_pop(temperature_c) * stddev_pop(total_demand)) END AS elasticity_estimate FROM mart WHERE CAST(hour_ts AS date) <= DATE '2024-01-20' AND temperature_c IS NOT NULL AND total_demand IS NOT NULL GROUP BY city"
_LEVEL = "SELECT city, avg(daily_bookings) AS avg_bookings_90d FROM daily WHERE day > DATE '2024-01-20' - 90 GROUP BY city"
ROUTE_FEATURES = ["avg_bookings_90d", *_DAYS, "lead_time_p50", "lead_time_p90", "cancellation_rate_180d", "elasticity_estimate"]


@query(
    "jn_assemble",
    f"SELECT l.city AS route_id, DATE '2024-01-20' AS feature_date, {rs(*[c for c in ROUTE_FEATURES if c != 'cancellation_rate_180d'])}, round(coalesce(cancellation_rate_180d, 0.0)::double, 6) AS cancellation_rate_180d "
    f"FROM ({_LEVEL}) l LEFT JOIN (SELECT city, {_SEASON} FROM daily GROUP BY city) s USING (city) LEFT JOIN ({_LEADS}) t USING (city) LEFT JOIN ({_CANCEL}) c USING (city) LEFT JOIN ({_CORR}) e USING (city)",
)
def _(d):
    return marts.route_features(d.mart, d.demand_events, FEATURE_DATE).select("route_id", "feature_date", *r(*ROUTE_FEATURES))


_DELTAS = [f"d_{c}" for c in [*quality.OFFLINE, *quality.ONLINE]]


@query("jn_skew", f"SELECT city, serving_hour, wh_hour, is_stale, {rs(*_DELTAS)} FROM joined")
def _(d):
    return quality.joined(d.prediction_features, d.mart).select("city", "serving_hour", "wh_hour", "is_stale", *r(*_DELTAS))


_UNPIVOT = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feat, d_{c} AS delta, {c in quality.ONLINE} AS is_online, wh_hour IS NOT NULL AS has_wh, is_stale FROM joined" for c in [*quality.OFFLINE, *quality.ONLINE]) + ")"


@query("jn_lateral", f"SELECT feat, is_online, has_wh, count(*) AS n, round(sum(delta)::double, 3) AS total FROM {_UNPIVOT} GROUP BY 1, 2, 3")
def _(d):
    return quality.unpivoted(quality.joined(d.prediction_features, d.mart)).groupBy("feat", "is_online", "has_wh").agg(F.count("*").alias("n"), F.round(F.sum("delta"), 3).alias("total"))


@query("jn_update", "SELECT m.city, m.hour_ts, coalesce(h.holiday IS NOT NULL, false) AS is_holiday FROM demand_hourly m LEFT JOIN hol h ON h.city = m.city AND h.holiday = CAST(m.hour_ts AS date)")
def _(d):
    old = d.demand_hourly.select("city", "hour_ts", F.lit(False).alias("is_holiday"))
    new = marts.with_holidays(d.demand_hourly, d.holidays).where("is_holiday").select("city", "hour_ts", F.col("is_holiday").alias("new"))
    return old.join(new, ["city", "hour_ts"], "left").select("city", "hour_ts", F.coalesce("new", "is_holiday").alias("is_holiday"))


@query("jn_scalar", "SELECT city, hour_ts, round(total_demand, 6) AS total_demand FROM mart WHERE hour_ts = (SELECT max(hour_ts) FROM mart)")
def _(d):
    last = d.mart.agg(F.max("hour_ts").alias("last"))
    return d.mart.join(F.broadcast(last), F.col("hour_ts") == F.col("last")).select("city", "hour_ts", *r("total_demand"))


@query(
    "jn_actual_pred",
    "SELECT coalesce(a.city, p.city) AS city, coalesce(a.hour_ts, p.hour_ts) AS ts, round(a.total_demand, 6) AS actual, round(p.demand_lag_24h, 6) AS predicted FROM (SELECT * FROM mart WHERE hour(hour_ts) % 2 = 0) a FULL JOIN (SELECT city, hour_ts + interval 1 hour AS hour_ts, demand_lag_24h FROM mart WHERE hour(hour_ts) % 3 = 0) p ON a.city = p.city AND a.hour_ts = p.hour_ts",
)
def _(d):
    a = d.mart.where(F.hour("hour_ts") % 2 == 0).select("city", F.col("hour_ts").alias("ts"), F.round("total_demand", 6).alias("actual"))
    p = d.mart.where(F.hour("hour_ts") % 3 == 0).select("city", F.expr("timestampadd(HOUR, 1, hour_ts)").alias("ts"), F.round("demand_lag_24h", 6).alias("predicted"))
    return a.join(p, ["city", "ts"], "full_outer")


# Aggregations


@query("ag_demand_hour", f"SELECT city, hour_ts, event_count, {rs('total_demand', 'avg_temp_c')} FROM demand_hourly")
def _(d):
    return d.demand_hourly.select("city", "hour_ts", "event_count", *r("total_demand", "avg_temp_c"))


@query("ag_weather_hour", f"SELECT city, hour_ts, {rs(*WEATHER)} FROM weather_hourly")
def _(d):
    return d.weather_hourly.select("city", "hour_ts", *r(*WEATHER))


@query("ag_daily", f"SELECT city, day, daily_bookings::bigint AS daily_bookings, {rs('daily_demand')} FROM daily")
def _(d):
    return marts.daily(d.mart, FEATURE_DATE).select("city", "day", "daily_bookings", *r("daily_demand"))


@query("ag_avg90", f"SELECT city, {rs('avg_bookings_90d')} FROM ({_LEVEL})")
def _(d):
    return marts.booking_level(marts.daily(d.mart, FEATURE_DATE), FEATURE_DATE).select("city", *r("avg_bookings_90d"))


@query("ag_season", f"SELECT city, {rs(*_DAYS)} FROM (SELECT city, {_SEASON} FROM daily GROUP BY city)")
def _(d):
    return marts.seasonality(marts.daily(d.mart, FEATURE_DATE)).select("city", *r(*_DAYS))


@query("ag_pctcont", f"SELECT city, {rs('lead_time_p50', 'lead_time_p90')} FROM ({_LEADS})")
def _(d):
    return marts.lead_times(d.demand_events, FEATURE_DATE).select("city", *r("lead_time_p50", "lead_time_p90"))


@query("ag_cancel", f"SELECT city, {rs('cancellation_rate_180d')} FROM ({_CANCEL})")
def _(d):
    return marts.cancellation_rate(d.demand_events, FEATURE_DATE).select("city", *r("cancellation_rate_180d"))


@query("ag_corr", f"SELECT city, {rs('elasticity_estimate')} FROM ({_CORR})")
def _(d):
    return marts.elasticity(d.mart, FEATURE_DATE).select("city", *r("elasticity_estimate"))


_PROFILED = [*LAGGED, *WEATHER, "total_demand"]


@query("ag_null_profile", f"SELECT count(*) AS n_rows, {', '.join(f'count(*) FILTER ({c} IS NULL) AS null_{c}' for c in _PROFILED)} FROM mart")
def _(d):
    return marts.null_profile(d.mart, _PROFILED)


def _summary_sql(guard: str) -> str:
    off = lambda c: f"d_{c} > 0.01{guard}"
    return (
        "SELECT count(*) AS total, count(wh_hour) AS matched, count(*) - count(wh_hour) AS unmatched, count(*) FILTER (is_stale) AS stale_mart, "
        + ", ".join(f"count(*) FILTER ({off(c)}) AS bug_{n}, count(*) FILTER (NOT is_stale AND {off(c)}) AS true_bug_{n}" for c, n in quality.OFFLINE.items())
        + ", "
        + ", ".join(f"count(*) FILTER ({off(c)}) AS online_{n}" for c, n in quality.ONLINE.items())
        + " FROM joined"
    )


@query("ag_skew_summary", _summary_sql(""))
def _(d):
    return quality.skew_summary(quality.joined(d.prediction_features, d.mart))


@query("ag_skew_summary_guarded", _summary_sql(" AND wh_hour IS NOT NULL"))
def _(d):
    return quality.skew_summary(quality.joined(d.prediction_features, d.mart), guarded=True)


@query("ag_skew_feature", f"SELECT feat, is_online, count(*) FILTER (has_wh AND delta > 0.01) AS mismatches, round(avg(delta) FILTER (has_wh AND delta > 0.01), 4) AS avg_delta, round(max(delta) FILTER (has_wh AND delta > 0.01), 4) AS max_delta FROM {_UNPIVOT} GROUP BY 1, 2")
def _(d):
    return quality.skew_by_feature(quality.joined(d.prediction_features, d.mart))


def bench_aggregate(mart: DataFrame, deviation: Callable) -> DataFrame:
    """The wide aggregate by city and hour of the day: six means, a deviation, holidays and rows."""
    means = {"avg_demand": "total_demand", "avg_lag_1h": "demand_lag_1h", "avg_lag_24h": "demand_lag_24h", "avg_roll_24h": "demand_roll_24h", "avg_temp_c": "temperature_c", "avg_humidity": "humidity_pct"}
    return mart.groupBy("city", F.hour("hour_ts").alias("hour_of_day")).agg(
        *[F.round(F.avg(c), 6).alias(n) for n, c in means.items()], F.round(deviation("total_demand"), 6).alias("std_demand"), F.count_if("is_holiday").alias("holiday_hours"), F.count("*").alias("n_rows")
    )


def _bench_sql(dev: str) -> str:
    return f"SELECT city, hour(hour_ts)::int AS hour_of_day, round(avg(total_demand), 6) AS avg_demand, round({dev}(total_demand), 6) AS std_demand, round(avg(demand_lag_1h), 6) AS avg_lag_1h, round(avg(demand_lag_24h), 6) AS avg_lag_24h, round(avg(demand_roll_24h), 6) AS avg_roll_24h, round(avg(temperature_c), 6) AS avg_temp_c, round(avg(humidity_pct), 6) AS avg_humidity, count(*) FILTER (is_holiday) AS holiday_hours, count(*) AS n_rows FROM mart GROUP BY 1, 2"


@query("ag_bench", _bench_sql("stddev_samp"))
def _(d):
    return bench_aggregate(d.mart, F.stddev_samp)


@query("ag_bench_pop", _bench_sql("stddev_pop"))
def _(d):
    return bench_aggregate(d.mart, F.stddev_pop)


_AT = "epoch(TIMESTAMP '2024-01-20 12:00:00')"


@query(
    "ag_distinct_win",
    f"SELECT city, count(DISTINCT CASE WHEN event_type = 'search' AND epoch(sim_ts) >= {_AT} - 300 THEN event_id END) AS searches_5m, count(DISTINCT CASE WHEN event_type = 'booking' AND epoch(sim_ts) >= {_AT} - 900 THEN event_id END) AS bookings_15m, count(DISTINCT CASE WHEN event_type = 'search' THEN event_id END) AS searches_1h, count(DISTINCT CASE WHEN event_type = 'booking' THEN event_id END) AS bookings_1h FROM demand_events WHERE city IS NOT NULL AND epoch(sim_ts) BETWEEN {_AT} - 3600 AND {_AT} GROUP BY city",
)
def _(d):
    asks = d.demand_hourly.select(F.col("city").alias("route_id")).distinct().withColumn("at", F.lit(datetime(2024, 1, 20, 12)).cast("timestamp_ntz"))
    return online.reconstruct(d.demand_events, asks).select(F.col("route_id").alias("city"), "searches_5m", "bookings_15m", "searches_1h", "bookings_1h")


@query("ag_lake_counts", "SELECT city, count(*) AS n, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM demand_events GROUP BY city")
def _(d):
    return d.demand_events.groupBy("city").agg(F.count("*").alias("n"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at")).orderBy(F.desc("n"), "city")


@query("ag_distinct_city", "SELECT DISTINCT city FROM mart")
def _(d):
    return d.mart.select("city").distinct().orderBy("city")


@query("ag_timebucket", "SELECT date_trunc('hour', ingested_at) AS bucket, count(*) AS n, round(avg(k), 6) AS avg_latency, round(quantile_cont(k, 0.99), 6) AS p99_latency FROM (SELECT ts + (k - 5) * interval 1 minute AS ingested_at, k FROM ev) GROUP BY 1")
def _(d):
    rows = d.events.select(F.expr("timestampadd(MINUTE, k - 5, ts)").alias("ingested_at"), "k")
    return rows.groupBy(fn.hour_of(F.col("ingested_at")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("avg_latency"), F.round(F.percentile("k", 0.99), 6).alias("p99_latency"))


@query("ag_dup_having", "SELECT event_id, count(*) AS n FROM demand_dup WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(d):
    return staging.duplicate_groups(d.demand_dup)


@query("ag_metrics", "SELECT round(avg(abs(total_demand - demand_lag_24h)), 6) AS mae, round(sqrt(avg((total_demand - demand_lag_24h) ** 2)), 6) AS rmse, round(avg(abs(total_demand - demand_lag_24h) / greatest(abs(total_demand), 1e-8)), 6) AS mape FROM mart WHERE demand_lag_24h IS NOT NULL")
def _(d):
    from tidemark.plans.training import metrics

    return metrics(d.mart.where("demand_lag_24h IS NOT NULL"), "total_demand", "demand_lag_24h").select(*r("mae", "rmse", "mape"))


_SPLIT = "hour_ts < TIMESTAMP '2024-01-15'"


def _halves(d):
    return d.stored_mart.where("hour_ts < TIMESTAMP_NTZ '2024-01-15'"), d.stored_mart.where("hour_ts >= TIMESTAMP_NTZ '2024-01-15'")


def _psi_sql(c: str) -> str:
    return f"""(WITH ref AS (SELECT {c}::double AS v FROM mart WHERE {_SPLIT} AND {c} IS NOT NULL), cur AS (SELECT {c}::double AS v FROM mart WHERE NOT ({_SPLIT}) AND {c} IS NOT NULL),
    e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS es FROM ref),
    b AS (SELECT unnest(range(1, len(es))) AS b, es FROM e),
    n AS (SELECT b, len(es) - 1 AS k, (SELECT count(*) FROM ref WHERE v >= es[b] AND (v < es[b + 1] OR (b = len(es) - 1 AND v = es[b + 1]))) AS r,
          (SELECT count(*) FROM cur WHERE v >= es[b] AND (v < es[b + 1] OR (b = len(es) - 1 AND v = es[b + 1]))) AS c FROM b),
    p AS (SELECT (r + 0.5::double) / ((SELECT count(*) FROM ref) + 0.5::double * k) AS pr, (c + 0.5::double) / ((SELECT count(*) FROM cur) + 0.5::double * k) AS pc FROM n)
    SELECT '{c}' AS feature, round(sum((pc - pr) * ln(pc / pr)), 6) AS psi FROM p)"""


@query("ag_psi_num", " UNION ALL ".join(f"SELECT * FROM {_psi_sql(c)}" for c in WEATHER))
def _(d):
    return quality.psi_numeric(*_halves(d), *WEATHER).select("feature", *r("psi"))


ORACLE_PSI_CITY = f"""SELECT 'city' AS feature, round(sum((pc - pr) * ln(pc / pr)), 6) AS psi FROM (
    SELECT (count(*) FILTER ({_SPLIT}) + 0.5::double) / (sum(count(*) FILTER ({_SPLIT})) OVER () + 0.5::double * count(*) OVER ()) AS pr,
           (count(*) FILTER (NOT ({_SPLIT})) + 0.5::double) / (sum(count(*) FILTER (NOT ({_SPLIT}))) OVER () + 0.5::double * count(*) OVER ()) AS pc FROM mart GROUP BY city)"""


@query("ag_psi_cat", ORACLE_PSI_CITY)
def _(d):
    return quality.psi_categorical(*_halves(d), "city").select("feature", *r("psi"))


@query("ag_shadow", "SELECT city, round(avg(abs(total_demand - demand_roll_24h)), 6) AS shadow_mae FROM mart WHERE demand_roll_24h IS NOT NULL GROUP BY city")
def _(d):
    pairs = d.mart.where("demand_roll_24h IS NOT NULL").groupBy("city", F.to_date("hour_ts").alias("day")).agg(F.collect_list(F.struct("total_demand", "demand_roll_24h")).alias("h"))  # 24 a day
    gaps = pairs.select("city", quality.mean_abs_difference(F.col("h.total_demand"), F.col("h.demand_roll_24h")).alias("gap"), F.size("h").alias("n"))
    return gaps.groupBy("city").agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 6).alias("shadow_mae"))


# Windows


@query("wn_lag", f"SELECT city, hour_ts, {rs(*LAGGED[:3])} FROM lagged")
def _(d):
    return marts.with_lags(d.demand_hourly).select("city", "hour_ts", *r(*LAGGED[:3]))


@query("wn_roll", f"SELECT city, hour_ts, {rs(*LAGGED[3:])} FROM lagged")
def _(d):
    return marts.with_lags(d.demand_hourly).select("city", "hour_ts", *r(*LAGGED[3:]))


@query("wn_named", f"SELECT city, hour_ts, {rs('demand_lag_1h', 'demand_roll_3h')} FROM lagged")
def _(d):
    rows = d.spark.sql(
        """SELECT city, hour_ts, lag(total_demand, 1) OVER w AS demand_lag_1h,
        avg(total_demand) OVER (PARTITION BY city ORDER BY hour_ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS demand_roll_3h
        FROM {hours} WINDOW w AS (PARTITION BY city ORDER BY hour_ts)""",
        hours=d.demand_hourly,
    )
    return rows.select("city", "hour_ts", *r("demand_lag_1h", "demand_roll_3h"))


@query("wn_dedup", "SELECT id, event_id, ingested_at FROM demand_dup QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at, id) = 1")
def _(d):
    return staging.dedup(d.demand_dup).select("id", "event_id", "ingested_at")


@query("wn_latest", "SELECT city, hour_ts, round(total_demand, 6) AS total_demand FROM mart QUALIFY row_number() OVER (PARTITION BY city ORDER BY hour_ts DESC) = 1")
def _(d):
    return staging.latest_by(d.mart, "city", "hour_ts").select("city", "hour_ts", *r("total_demand"))


_COUNTS = "searches_5m, bookings_15m, searches_1h, bookings_1h"


@query("wn_sliding", f"SELECT route_id, id, sim_ts, {_COUNTS}, round(bookings_1h / greatest(searches_1h, 1), 6) AS look_to_book_1h FROM sliding")
def _(d):
    return online.sliding_features(d.demand_events)


# Sorting and limits


@query("tk_latest_city", "SELECT city, hour_ts, round(total_demand, 6) AS total_demand FROM mart WHERE city = 'london' ORDER BY hour_ts DESC LIMIT 1")
def _(d):
    return d.mart.where("city = 'london'").orderBy(F.desc("hour_ts")).limit(1).select("city", "hour_ts", *r("total_demand"))


def history(mart: DataFrame, city: str, hours: int) -> DataFrame:
    """The last hours of a city with demand; their number is held between 1 and 8760."""
    return mart.where((F.col("city") == city) & F.col("total_demand").isNotNull()).orderBy(F.desc("hour_ts")).limit(max(1, min(8760, hours)))


@query("tk_history", "SELECT hour_ts, round(total_demand, 6) AS total_demand FROM mart WHERE city = 'tokyo' ORDER BY hour_ts DESC LIMIT 48")
def _(d):
    return history(d.mart, "tokyo", 48).select("hour_ts", *r("total_demand"))


@query("tk_preview", "SELECT id, event_id, city FROM demand_events ORDER BY id LIMIT 10")
def _(d):
    return d.demand_events.select("id", "event_id", "city").orderBy("id").limit(10)


@query("tk_lag_sort", "SELECT event_type, max(id) - min(id) AS lag FROM demand_events GROUP BY 1")
def _(d):
    return d.demand_events.groupBy("event_type").agg((F.max("id") - F.min("id")).alias("lag")).orderBy(F.desc("lag"))


@query("tk_train_order", "SELECT hour_ts, city, round(total_demand, 6) AS total_demand FROM mart")
def _(d):
    return d.mart.orderBy("hour_ts", "city").select("hour_ts", "city", *r("total_demand"))


@query("tk_worst", "SELECT round(max(m), 6) AS worst_score, arg_max(city, m) AS worst_feature, count(*) FILTER (m > 250) AS above FROM (SELECT city, max(total_demand) AS m FROM mart GROUP BY 1)")
def _(d):
    scores = d.mart.groupBy("city").agg(F.max("total_demand").alias("m"))
    return quality.worst(scores, "city", "m", 250.0).select(*r("worst_score"), "worst_feature", "above")
