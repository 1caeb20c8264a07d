"""Queries over drift states and reports, metric series and alerts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import drift, quality, series
from tidemark.plans.views_sql import VIEWS
from tidemark.sources.domain import Domain
from tidemark.sources.paths import fresh
from tidemark.sources.snapshots import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = VIEWS + sql
        return build

    return register


# Drift

HALVES = [(datetime(2024, 1, 31), date(2023, 12, 1), date(2024, 1, 14), date(2024, 1, 15), date(2024, 3, 1))]
DAILY = drift.daily_windows(date(2024, 1, 16), date(2024, 1, 30), reference_days=14)


def _report_sql(windows) -> str:
    """CTEs that end in `report`: psi and ks of each window and feature, from the mart's rows."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(hour_ts AS date) AS day, round({c}{'::int' if c == 'is_holiday' else ''}::double, {drift.DIGITS}) AS v FROM mart WHERE {c} IS NOT NULL" for c in quality.DRIFT_FEATURES)
    rows = ", ".join(f"(TIMESTAMP '{w[0]}', {', '.join(f"DATE '{x}'" for x in w[1:])})" for w in windows)
    names = ", ".join(f"('{c}')" for c in quality.DRIFT_FEATURES)
    inside = "v >= es[b] AND (v < es[b + 1] OR (b = len(es) - 1 AND v = es[b + 1]))"
    return f""", long AS ({long}), w(checked_at, rf, rt, cf, ct) AS (VALUES {rows}),
    ref AS (SELECT checked_at, feature, v FROM long JOIN w ON day BETWEEN rf AND rt), cur AS (SELECT checked_at, feature, v FROM long JOIN w ON day BETWEEN cf AND ct),
    sorted AS (SELECT checked_at, feature, count(*) AS nr, list(v ORDER BY v) AS l FROM ref GROUP BY 1, 2),
    q AS (SELECT checked_at, feature, nr, l, unnest(range(0, 11)) * (nr - 1) AS pos FROM sorted),
    e AS (SELECT checked_at, feature, nr, list(DISTINCT l[pos // 10 + 1] + (l[least(pos // 10 + 2, nr)] - l[pos // 10 + 1]) * ((pos % 10) / 10.0::double)) AS es0 FROM q GROUP BY 1, 2, 3),
    es AS (SELECT checked_at, feature, nr, list_sort(es0) AS es FROM e),
    nc AS (SELECT checked_at, feature, count(*) AS nc FROM cur GROUP BY 1, 2),
    b AS (SELECT *, unnest(range(1, len(es))) AS b FROM es WHERE len(es) >= 3),
    rb AS (SELECT checked_at, feature, b, count(*) AS r FROM b JOIN ref USING (checked_at, feature) WHERE {inside} GROUP BY 1, 2, 3),
    cb AS (SELECT checked_at, feature, b, count(*) AS c FROM b JOIN cur USING (checked_at, feature) WHERE {inside} GROUP BY 1, 2, 3),
    p AS (SELECT checked_at, feature, (coalesce(r, 0) + 0.5::double) / (nr + 0.5::double * (len(es) - 1)) AS pr, (coalesce(c, 0) + 0.5::double) / (nc + 0.5::double * (len(es) - 1)) AS pc
          FROM b JOIN nc USING (checked_at, feature) LEFT JOIN rb USING (checked_at, feature, b) LEFT JOIN cb USING (checked_at, feature, b) WHERE nr >= 10 AND nc >= 5),
    psi AS (SELECT checked_at, feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM p GROUP BY 1, 2),
    steps AS (SELECT checked_at, feature, v, sum(r) AS r, sum(c) AS c FROM (SELECT *, 1 AS r, 0 AS c FROM ref UNION ALL SELECT *, 0, 1 FROM cur) GROUP BY 1, 2, 3),
    ks AS (SELECT checked_at, feature, max(abs(a / nullif(n, 0) - d / nullif(m, 0))) AS ks FROM (SELECT checked_at, feature, (sum(r) OVER o)::double AS a, (sum(r) OVER q)::double AS n, (sum(c) OVER o)::double AS d, (sum(c) OVER q)::double AS m
           FROM steps WINDOW o AS (PARTITION BY checked_at, feature ORDER BY v), q AS (PARTITION BY checked_at, feature)) GROUP BY 1, 2),
    sizes AS (SELECT checked_at, count(*) FILTER (day BETWEEN rf AND rt) AS rn, count(*) FILTER (day BETWEEN cf AND ct) AS cn FROM (SELECT CAST(hour_ts AS date) AS day FROM mart) JOIN w ON day BETWEEN rf AND rt OR day BETWEEN cf AND ct GROUP BY 1),
    names(feature) AS (VALUES {names}),
    report AS (SELECT checked_at, feature AS feature_name, round(coalesce(psi, 0), 6) AS drift_score, round(ks, 6) AS ks, coalesce(psi, 0) > 0.2 AND cn >= 20 AS drift_detected, rn AS reference_count, cn AS current_count
               FROM sizes CROSS JOIN names LEFT JOIN psi USING (checked_at, feature) LEFT JOIN ks USING (checked_at, feature))"""


HALVES_SQL, DAILY_SQL = _report_sql(HALVES), _report_sql(DAILY)


def drift_store(d: Domain) -> Store:
    """A store with the mart's states, the second half of which is put in place twice."""
    store, counts = Store(d.spark, fresh(d.spark, "drift")), drift.day_counts(d.mart)
    drift.keep_days(store, counts)
    drift.keep_days(store, counts.where("day >= DATE '2024-01-15'"))
    return store


def halves_report(d: Domain) -> DataFrame:
    return drift.reports(drift_store(d).read(drift.STATES), HALVES)


@query("ml_drift", f"{HALVES_SQL} SELECT * EXCLUDE (checked_at) FROM report")
def _(d):
    """The mart's second half against its first, from stored states of days."""
    return halves_report(d).drop("checked_at")


def daily_reports(d: Domain) -> DataFrame:
    """Kept reports: a day's rows against the two weeks before it, for each day. The last batch is sent twice."""
    store = drift_store(d)
    states = store.read(drift.STATES)
    drift.keep_reports(store, drift.reports(states, DAILY[:10]), batch=("daily", 0))
    for _ in range(2):
        drift.keep_reports(store, drift.reports(states, DAILY[10:]), batch=("daily", 1))
    return store.read(drift.REPORTS)


@query("ml_drift_daily", f"{DAILY_SQL} SELECT * FROM report")
def _(d):
    return daily_reports(d)


@query("tk_drift_hits", f"{DAILY_SQL} SELECT checked_at, feature_name, drift_score, drift_detected FROM report WHERE drift_detected ORDER BY checked_at DESC, feature_name LIMIT 20")
def _(d):
    return drift.hits(daily_reports(d)).select("checked_at", "feature_name", "drift_score", "drift_detected")


# Counters, histograms, range queries

TICK, WINDOW, STEP = 600, 3600, 1800
#: Upper bounds of the latency histogram's buckets, in seconds.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 0.75, float("inf"))
#: A request's latency; every sixth hour is slow.
_LATENCY = "((temperature_c + 10) / 100 + CASE WHEN hour(sim_ts) % 6 = 0 THEN 0.3{d} ELSE 0.0{d} END)"
_SECOND = "CAST(unix_micros(CAST(sim_ts AS timestamp)) DIV 1000000 AS bigint)"


def counters(d: Domain) -> DataFrame:
    """city, le, t, v: cumulative buckets of the latency histogram, scraped every TICK seconds, sometimes not; they begin again at midnight."""
    e = d.demand_events.where("city IS NOT NULL AND sim_ts IS NOT NULL").select("city", F.expr(f"{_SECOND} DIV {TICK}").alias("tick"), F.expr(_LATENCY.format(d="D")).alias("latency"))
    # Counts of each bucket alone, then with those below: a row a city, tick and bucket, whatever the number of events.
    bucket = reduce(lambda a, b: F.least(a, b), [F.when(F.col("latency") <= le, F.lit(le)).otherwise(F.lit(float("inf"))) for le in BOUNDS])
    own = e.groupBy("city", "tick", bucket.alias("le")).agg(F.count("*").alias("n"))
    span = e.agg(F.min("tick").alias("a"), F.max("tick").alias("z"))
    bounds = F.explode(F.array(*[F.lit(x) for x in BOUNDS])).alias("le")
    dense = d.demand_events.where("city IS NOT NULL").select("city").distinct().crossJoin(F.broadcast(span)).select("city", bounds, F.explode(F.sequence("a", "z")).alias("tick"))
    rows = dense.join(own, ["city", "tick", "le"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "day": F.expr(f"tick DIV {86_400 // TICK}")})
    since = Window.partitionBy("city", "day", "le").orderBy("tick")
    alone = rows.select("city", "tick", "le", F.sum("n").over(since).alias("n"))
    below = Window.partitionBy("city", "tick").orderBy("le")
    return alone.select("city", "le", ((F.col("tick") + 1) * TICK).alias("t"), F.sum("n").over(below).cast("double").alias("v")).where(f"(t DIV {TICK} - 1) % 7 <> 3")


_BOUNDS = ", ".join(f"({x}::double)" for x in BOUNDS[:-1]) + ", ('infinity'::double)"
_COUNTERS = f""", lat AS (SELECT city, floor(epoch(sim_ts) / {TICK})::bigint AS tick, {_LATENCY.format(d="::double")} AS latency FROM demand_events WHERE city IS NOT NULL AND sim_ts IS NOT NULL),
  les(le) AS (VALUES {_BOUNDS}),
  ticks AS (SELECT city, le, unnest(range(a, z + 1)) AS tick FROM (SELECT DISTINCT city FROM lat), les, (SELECT min(tick) AS a, max(tick) AS z FROM lat)),
  per AS (SELECT t.city, t.le, t.tick, count(l.latency) AS n FROM ticks t LEFT JOIN lat l ON l.city = t.city AND l.tick = t.tick AND l.latency <= t.le GROUP BY 1, 2, 3),
  counters AS (SELECT city, le, (tick + 1) * {TICK} AS t, sum(n) OVER (PARTITION BY city, le, tick // {86_400 // TICK} ORDER BY tick)::double AS v FROM per QUALIFY tick % 7 <> 3),
  stepped AS (SELECT *, lag(t) OVER o AS pt, lag(v) OVER o AS pv, unnest(range(ceil(t / {STEP})::bigint, ceil((t + {WINDOW}) / {STEP})::bigint)) * {STEP} AS pos FROM counters WINDOW o AS (PARTITION BY city, le ORDER BY t)),
  ends AS (SELECT city, le, pos, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0, arg_max(v, t) AS v1, sum(CASE WHEN pt > pos - {WINDOW} AND v < pv THEN pv ELSE 0 END) AS resets FROM stepped GROUP BY 1, 2, 3),
  gaps AS (SELECT *, v1 - v0 + resets AS delta, (t1 - t0)::double AS span, (t1 - t0) / (n - 1)::double AS mean, (t0 - (pos - {WINDOW}))::double AS s, (pos - t1)::double AS z FROM ends WHERE n > 1),
  rates AS (SELECT city, le, pos AS t, delta * (span + least(CASE WHEN s >= mean * 1.1::double THEN mean / 2 ELSE s END, coalesce(CASE WHEN delta > 0 AND v0 >= 0 THEN span * v0 / delta END, CASE WHEN s >= mean * 1.1::double THEN mean / 2 ELSE s END))
              + CASE WHEN z >= mean * 1.1::double THEN mean / 2 ELSE z END) / span AS increase FROM gaps),
  ranked AS (SELECT city, t, le, increase / {WINDOW} AS c, lag(increase / {WINDOW}, 1, 0.0::double) OVER o AS cp, lag(le) OVER o AS lp, max(CASE WHEN le = 'infinity'::double THEN increase / {WINDOW} END) OVER (PARTITION BY city, t) AS total FROM rates WINDOW o AS (PARTITION BY city, t ORDER BY le))"""


def _quantile_sql(q: float) -> str:
    return f"""(SELECT city, t, CASE WHEN le = 'infinity'::double THEN lp ELSE coalesce(lp, 0) + (le - coalesce(lp, 0)) * ({q}::double * total - cp) / nullif(c - cp, 0) END AS value
      FROM ranked WHERE total > 0 AND c >= {q}::double * total QUALIFY row_number() OVER (PARTITION BY city, t ORDER BY le) = 1)"""


@query("ag_prom", f"{_COUNTERS} SELECT city, t, round(increase, 6) + 0.0::double AS increase, round(increase / {WINDOW}, 9) + 0.0::double AS rate FROM rates WHERE le = 'infinity'::double")
def _(d):
    """Requests an hour and a second of each city, from counters that begin again every day."""
    rows = series.increases(counters(d).where("le = double('infinity')"), ["city"], WINDOW, STEP)
    return rows.select("city", "t", (F.round("increase", 6) + 0.0).alias("increase"), (F.round("rate", 9) + 0.0).alias("rate"))


def latency_quantile(d: Domain, q: float) -> DataFrame:
    return series.histogram_quantile(series.increases(counters(d), ["city", "le"], WINDOW, STEP), ["city"], q)


@query("ag_prom_quantile", f"{_COUNTERS} SELECT city, t, round(a.value, 6) AS p50, round(b.value, 6) AS p99 FROM {_quantile_sql(0.5)} a FULL JOIN {_quantile_sql(0.99)} b USING (city, t)")
def _(d):
    of = lambda q, name: latency_quantile(d, q).where("value IS NOT NULL").select("city", "t", F.round("value", 6).alias(name))
    return of(0.5, "p50").join(of(0.99, "p99"), ["city", "t"], "full_outer")


def hourly_scores(d: Domain) -> DataFrame:
    """city, t, v: how far an hour's demand is from the city's mean; hours without demand have none."""
    mean = d.stored_mart.groupBy("city").agg(F.avg("total_demand").alias("mean"))
    return d.stored_mart.join(mean, "city").select("city", F.expr("CAST(unix_micros(CAST(hour_ts AS timestamp)) DIV 1000000 AS bigint)").alias("t"), F.abs(F.col("total_demand") / F.col("mean") - 1).alias("v"))


_HOURLY = ", hs AS (SELECT city, epoch(hour_ts)::bigint AS t, abs(total_demand / avg(total_demand) OVER (PARTITION BY city) - 1) AS v FROM mart)"
_NOW = 1_706_655_600  # 2024-01-30 23:00


def _history_sql(hours: int, step: int) -> str:
    return f"""SELECT {step} AS step, g.city, g.t, round(s.v, 6) AS score FROM (SELECT city, unnest(range({_NOW - hours * 3600}, {_NOW + 1}, {step})) AS t FROM (SELECT DISTINCT city FROM hs)) g
      ASOF JOIN hs s ON s.city = g.city AND s.t <= g.t WHERE g.t - s.t < {series.LOOKBACK} AND s.t >= {_NOW - hours * 3600 - series.LOOKBACK}"""


@query("sv_drift_history", f"{_HOURLY} {_history_sql(72, 300)} UNION ALL {_history_sql(6, 3600)}")
def _(d):
    """Five minutes apart over the longest window there is (more was asked for), and an hour apart over six."""
    of = lambda hours, step: series.history(hourly_scores(d), ["city"], _NOW, hours, step).select(F.lit(step).alias("step"), "city", "t", "score")
    return of(500, 300).unionByName(of(6, 3600))


# Alerts

_FIRST, _LAST = 1_704_067_200, _NOW  # of January
#: Messages that a city may be behind, at this size of table.
LAG_LIMIT = 15


def backlog(d: Domain) -> DataFrame:
    """city, t, v: how many messages have happened and are not ingested yet, minute by minute."""
    minute = lambda c: F.expr(f"CAST(ceil(unix_micros(CAST({c} AS timestamp)) / 60000000D) AS bigint)")
    e = d.demand_events.where("city IS NOT NULL AND ingested_at > sim_ts")
    moves = e.select("city", F.explode(F.array(F.struct(minute("sim_ts").alias("m"), F.lit(1).alias("n")), F.struct(minute("ingested_at").alias("m"), F.lit(-1).alias("n")))).alias("x"))
    net = moves.groupBy("city", F.greatest("x.m", F.lit(_FIRST // 60)).alias("m")).agg(F.sum("x.n").alias("n"))
    grid = net.select("city").distinct().select("city", F.explode(F.sequence(F.lit(_FIRST // 60), F.lit(_LAST // 60))).alias("m"))
    return grid.join(net, ["city", "m"], "left").select("city", (F.col("m") * 60).alias("t"), F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("city").orderBy("m")).alias("v"))


def _states_sql(evaluated: str, alert: str, condition: str, step: int, lasting: int) -> str:
    over = f"CASE WHEN z < last THEN z + {step} END"
    runs = f"""(SELECT label, min(t) AS a, max(t) AS z, any_value(last) AS last FROM (SELECT label, t, last, t - {step} * row_number() OVER (PARTITION BY label ORDER BY t) AS run
      FROM (SELECT label, t, max(t) OVER (PARTITION BY label) AS last, coalesce({condition}, false) AS hit FROM {evaluated}) WHERE hit) GROUP BY label, run)"""
    out = [f"SELECT '{alert}' AS alert, label, 'firing' AS state, a + {lasting} AS t_from, {over} AS t_to FROM {runs} WHERE z - a >= {lasting}", f"SELECT '{alert}', label, 'resolved', z + {step}, NULL FROM {runs} WHERE z - a >= {lasting} AND z < last"]
    if lasting:
        out.append(f"SELECT '{alert}', label, 'pending', a, CASE WHEN z - a >= {lasting} THEN a + {lasting} ELSE {over} END FROM {runs}")
    return " UNION ALL ".join(out)


_LAGS = f"""(SELECT city AS label, m * 60 AS t, sum(coalesce(n, 0)) OVER (PARTITION BY city ORDER BY m) AS v FROM (SELECT city, unnest(range({_FIRST // 60}, {_LAST // 60} + 1)) AS m FROM (SELECT DISTINCT city FROM demand_events WHERE city IS NOT NULL AND ingested_at > sim_ts))
    LEFT JOIN (SELECT city, greatest(m, {_FIRST // 60}) AS m, sum(n) AS n FROM (SELECT city, ceil(epoch_us(sim_ts) / 60000000)::bigint AS m, 1 AS n FROM demand_events WHERE city IS NOT NULL AND ingested_at > sim_ts
      UNION ALL SELECT city, ceil(epoch_us(ingested_at) / 60000000)::bigint, -1 FROM demand_events WHERE city IS NOT NULL AND ingested_at > sim_ts) GROUP BY 1, 2) USING (city, m))"""
_HOURS = f"(SELECT unnest(range({_FIRST}, {_LAST + 1}, 3600)) AS t)"
_DRIFTS = f"(SELECT g.label, g.t, s.v FROM (SELECT DISTINCT hs.city AS label, h.t FROM hs, {_HOURS} h) g LEFT JOIN hs s ON s.city = g.label AND s.t = g.t)"
_TRAINED = f"(SELECT 'model' AS label, g.t, (SELECT max(floor(epoch(sim_ts)))::bigint FROM demand_events WHERE id % 500 = 0 AND epoch(sim_ts) <= g.t) AS v FROM {_HOURS} g)"
_SLOW = f"(SELECT label, g.t, q.value AS v FROM (SELECT DISTINCT city AS label FROM lat), (SELECT unnest(range({_FIRST}, {_LAST + 1}, {STEP})) AS t) g LEFT JOIN {_quantile_sql(0.99)} q ON q.city = label AND q.t = g.t)"


@query(
    "dq_alerts",
    f"{_COUNTERS} {_HOURLY} "
    + " UNION ALL ".join(
        [
            _states_sql(_LAGS, "KafkaConsumerLagHigh", f"v > {LAG_LIMIT}", 60, 300),
            _states_sql(_DRIFTS, "FeatureDriftHigh", "v > 0.2", 3600, 0),
            _states_sql(_SLOW, "PredictionLatencyHigh", "v > 0.5", STEP, 300),
            _states_sql(_TRAINED, "ModelNotTrainedRecently", "v IS NULL OR t - v > 172800", 3600, 0),
        ]
    ),
)
def _(d):
    """Four rules over a month: messages behind for five minutes, drift, slow answers for five minutes, and training that is old or absent."""
    model = d.spark.createDataFrame([("model",)], "city string")
    runs = d.demand_events.where("id % 500 = 0 AND sim_ts IS NOT NULL").select(F.lit("model").alias("city"), F.expr(_SECOND).alias("t")).withColumn("v", F.col("t").cast("double"))
    trained = series.on_grid(runs, ["city"], _FIRST, _LAST, 3600, None, model)
    scores, slow = hourly_scores(d), latency_quantile(d, 0.99).withColumnRenamed("value", "v")
    cities = d.demand_events.where("city IS NOT NULL").select("city").distinct()
    rules = [
        ("KafkaConsumerLagHigh", backlog(d), F.col("v") > LAG_LIMIT, 60, 300),
        ("FeatureDriftHigh", series.on_grid(scores, ["city"], _FIRST, _LAST, 3600), F.col("v") > 0.2, 3600, 0),
        ("PredictionLatencyHigh", series.on_grid(slow, ["city"], _FIRST, _LAST, STEP, known=cities), F.col("v") > 0.5, STEP, 300),
        ("ModelNotTrainedRecently", trained, F.col("v").isNull() | (F.col("t") - F.col("v") > 172_800), 3600, 0),
    ]
    each = [series.alert_states(rows, ["city"], holds, step, lasting).select(F.lit(name).alias("alert"), F.col("city").alias("label"), "state", "t_from", "t_to") for name, rows, holds, step, lasting in rules]
    return reduce(DataFrame.unionByName, each)
