"""Queries over trained models: the registry, both gates, retraining under a lease, the prediction log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import online, quality
from tidemark.plans import training
from tidemark.plans.catalog import WEATHER, _halves
from tidemark.plans.monitoring import HALVES_SQL, halves_report
from tidemark.plans.more import _AS_OF, _CANDIDATES, _CUT, _LAST_SLIDE, _LAST_WX, GATE_PSI, _base, _store
from tidemark.plans.views_sql import VIEWS
from tidemark.sources.domain import Domain
from tidemark.sources.paths import fresh, together, written
from tidemark.sources.registry_log import PRODUCTION, STAGING, Lease, Registry
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


@query("ml_hgb")
def _(d):
    """Boosted trees at full size: 300 rounds of 31 leaves."""
    return training.boosted(*training.split(d.stored_mart, 7))


# The registry and the gates

_BROKEN = "broken"


def gated(d: Domain) -> tuple[Registry, list[tuple[str, int, str]]]:
    """A registry after each candidate was registered, gated against the stored Production model, and promoted if it passed.

    At the end a version without readable parameters gets into Production, and the first candidate comes again.
    """
    registry = Registry(d.spark, fresh(d.spark, "registry"))
    train, val = training.split(d.stored_mart, 7)
    halves = _halves(d)
    rows = quality.psi_numeric(*halves, *WEATHER).unionByName(quality.psi_categorical(*halves, "city"))
    psi = {row["feature"]: row["psi"] for row in rows.collect()}  # four features
    lines = {c: training.line(train, c) for c in _CANDIDATES}
    val = val.select(training.TARGET, *_CANDIDATES).persist()
    out = []
    for n, name in enumerate([*_CANDIDATES, _BROKEN, _CANDIDATES[0]]):
        parameters = {} if name == _BROKEN else lines[name]
        error = None if name == _BROKEN else training.line_error(parameters, val)
        version = registry.register(name, error, parameters, _AS_OF + timedelta(hours=n))
        if name == _BROKEN:
            registry.change(version, PRODUCTION)
            continue
        out.append((name, version, training.gate(registry, version, psi, val)))
        if registry.state()[1][version - 1]["stage"] == STAGING:
            registry.promote()
    val.unpersist()
    return registry, out


_ORDER = " UNION ALL ".join(f"SELECT {k} AS version, '{c}' AS name, avg(abs(total_demand - (i + s * {c}))) AS mae FROM mart, (SELECT regr_slope(total_demand, {c}) AS s, regr_intercept(total_demand, {c}) AS i FROM mart WHERE {_CUT}) WHERE NOT ({_CUT})" for k, c in enumerate(_CANDIDATES, 1))
_GATED = f""", ml AS ({_ORDER}), un AS (SELECT arg_max(feature, psi) AS feature FROM {GATE_PSI} WHERE psi > 0.25),
  pr AS (SELECT *, (SELECT feature FROM un) AS unstable, min(mae) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ml),
  gated AS (SELECT version, name, mae, CASE WHEN unstable IS NOT NULL THEN 'feature_drift: ' || unstable WHEN best IS NULL THEN 'no_production_model_exists' WHEN mae < best THEN 'beats_production' ELSE 'holdout_mae' END AS reason FROM pr
    UNION ALL SELECT 5, name, mae, CASE WHEN unstable IS NOT NULL THEN 'feature_drift: ' || unstable ELSE 'production_model_eval_failed' END FROM pr WHERE version = 1)"""


@query("ml_gate", f"{_GATED} SELECT name, version, reason NOT LIKE 'feature_drift%' AND reason <> 'holdout_mae' AS promoted, reason FROM gated")
def _(d):
    rows = [(name, version, not why.startswith("feature_drift") and why != "holdout_mae", why) for name, version, why in gated(d)[1]]
    return d.spark.createDataFrame(rows, "name string, version int, promoted boolean, reason string")


@query(
    "tk_models",
    f"""{_GATED}, moved AS (SELECT version, name AS run_id, mae, reason NOT LIKE 'feature_drift%' AND reason <> 'holdout_mae' AS up FROM gated UNION ALL SELECT 4, '{_BROKEN}', NULL, true)
    SELECT version, CASE WHEN NOT up THEN 'None' WHEN version = max(CASE WHEN up THEN version END) OVER () THEN 'Production' ELSE 'Archived' END AS stage, run_id, round(mae, 6) AS val_mae,
           TIMESTAMP '2024-01-30 23:30:00' + (version - 1) * interval 1 hour AS created_at, version = max(version) OVER (PARTITION BY CASE WHEN NOT up THEN 0 WHEN version = (SELECT max(version) FROM moved WHERE up) THEN 1 ELSE 2 END) AS newest_of_stage FROM moved""",
)
def _(d):
    """All versions, newest first, and whether each is the newest of its stage."""
    rows = gated(d)[0].table()
    newest = rows.groupBy("stage").agg(F.max("version").alias("newest"))
    return rows.join(F.broadcast(newest), "stage").select("version", "stage", "run_id", F.round("val_mae", 6).alias("val_mae"), "created_at", (F.col("version") == F.col("newest")).alias("newest_of_stage")).orderBy(F.desc("version"))


# Retraining

#: Of each trigger who it is, how many minutes after the first one it comes, and of how many rows.
_TRIGGERS = (("first", 0, None), ("cooling", 180, None), ("due", 420, None), ("dead", 900, None), ("blocked", 930, None), ("after", 1400, None), ("small", 1800, 99))


@query(
    "ml_retrain",
    f"""{HALVES_SQL}, hit AS (SELECT coalesce(bool_or(drift_score > 0.3 OR drift_detected), false) AS h FROM report), n AS (SELECT count(*) >= 100 AS enough FROM mart)
    SELECT owner, CASE WHEN NOT h THEN 'no drift' WHEN said = 'trained' AND NOT enough THEN 'too few rows' ELSE said END AS outcome FROM hit, n,
      (VALUES ('first', 'trained'), ('cooling', 'cooling down'), ('due', 'trained'), ('blocked', 'already running'), ('after', 'trained'), ('small', 'too few rows')) t(owner, said)""",
)
def _(d):
    """Triggers by the drift report, one after another: one within the cooldown, one while a dead job's lease lasts, one on few rows."""
    scores = {r["feature_name"]: (r["drift_score"], r["drift_detected"]) for r in halves_report(d).collect()}  # a row a feature
    lease, registry, out = Lease(d.spark, fresh(d.spark, "lease"), minutes=400), Registry(d.spark, fresh(d.spark, "registry")), []
    train, _val = training.split(d.stored_mart, 7)
    for owner, minutes, n in _TRIGGERS:
        now = _AS_OF + timedelta(minutes=minutes)
        if owner == "dead":  # takes the lease and is never heard of again
            lease.take(owner, now)
            continue
        cooldown = 0 if owner == "blocked" else 360
        fit = lambda: registry.register(owner, None, training.line(train, _CANDIDATES[0]), now)  # noqa: B023, E731
        out.append((owner, training.retrain(lease, owner, scores, d.stored_mart if n is None else d.stored_mart.limit(n), now, fit, cooldown_minutes=cooldown)))
    return d.spark.createDataFrame(out, "owner string, outcome string")


# The prediction log

LOG, FEATURES = "prediction_log", "prediction_features"
HORIZON = 48


def served(d: Domain) -> tuple[DataFrame, DataFrame]:
    """What requests are answered from, written once: the last mart row of each city and the online hash of each route.

    A commit runs its rows several times (the keys it looks up, both tables), so they must not have the events below them.
    """
    base, hashes = together(d.spark, lambda: written(_base(d), "last-rows"), lambda: written(_store(d), "online-hashes"))
    return base, hashes


def predictions(base: DataFrame, hashes: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """A request a city: its row of the log (forecasts of both models, what was missing online) and its row of features (those of step 0)."""
    base = base.withColumn("mart_hour_ts", F.col("hour_ts"))
    live = online.online_overlay(base.select(F.col("city").alias("route_id")), hashes, as_of).select(F.col("route_id").alias("city"), "age_seconds", "missing", "stale")
    steps = online.horizon_rows(base, HORIZON, as_of)
    request = F.sha2(F.concat_ws("|", "city", F.lit(as_of.isoformat())), 256).alias("request_id")
    series = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("step", F.col(c).alias("p")))), lambda x: x["p"])
    log = steps.groupBy("city").agg(series("demand_roll_24h").alias("prod_preds"), series("demand_lag_24h").alias("staging_preds")).join(live, "city")  # at most 168 steps a city
    at = F.lit(as_of).cast("timestamp_ntz").alias("requested_at")
    log = log.select(
        request, at, "city", F.lit(HORIZON).alias("horizon_hours"), F.lit(3).alias("prod_version"), "prod_preds", F.lit(4).alias("staging_version"), "staging_preds", F.col("age_seconds").alias("feature_age_s"), F.col("missing").alias("feature_missing"), F.col("stale").alias("feature_degraded")
    )
    numeric = ("event_count", "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_3h", "demand_roll_24h", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "temperature_c", "humidity_pct", "precip_mm", "is_holiday")
    features = steps.where("step = 0").join(live, "city").select(
        request, at, "city", F.lit(3).alias("model_version"), *[F.col(c).cast("double").alias(c) for c in numeric], "mart_hour_ts", F.col("age_seconds").alias("online_age_s"), F.col("missing").alias("online_missing"), F.col("stale").alias("online_degraded")
    )
    return log, features


def log_predictions(store: Store, log: DataFrame, features: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Adds both rows of each request that is not there yet, in one commit: both or neither, and once."""
    return store.insert_ignore(LOG, log, "request_id", batch=batch, follow={FEATURES: features})


@query(
    "sv_log",
    f"""SELECT city, step0.hour_ts AS mart_hour_ts, requested_at, {HORIZON} AS n_prod, round(demand_roll_24h, 6) AS first_prod, round(demand_lag_24h, 6) AS first_staging, coalesce(event_count, 0)::double AS event_count, round(sin(2 * pi() * hour(requested_at) / 24), 6) + 0.0::double AS hour_sin,
      CASE city WHEN 'tokyo' THEN 'look_to_book_1h' WHEN 'dubai' THEN 'weather_precip_mm' ELSE '' END AS missing
    FROM (SELECT * FROM mart QUALIFY row_number() OVER (PARTITION BY city ORDER BY hour_ts DESC) = 1) step0, (VALUES (TIMESTAMP '2024-01-30 23:30:00'), (TIMESTAMP '2024-01-31 00:30:00')) t(requested_at)
    WHERE city IN (SELECT route_id FROM {_LAST_SLIDE} JOIN {_LAST_WX} USING (route_id))""",
)
def _(d):
    """Two rounds of requests, of which the first is sent again with the second; the rows of both tables by request."""
    store = Store(d.spark, fresh(d.spark, "predictions"))
    base, hashes = served(d)
    log, features = predictions(base, hashes, _AS_OF)
    log_predictions(store, log, features)
    later = predictions(base, hashes, _AS_OF + timedelta(hours=1))
    log_predictions(store, log.unionByName(later[0]), features.unionByName(later[1]))
    both = store.read(LOG).join(store.read(FEATURES).drop("city", "requested_at"), "request_id")
    return both.select(
        "city", "mart_hour_ts", "requested_at", F.size("prod_preds").alias("n_prod"), F.round(F.col("prod_preds")[0], 6).alias("first_prod"), F.round(F.col("staging_preds")[0], 6).alias("first_staging"), "event_count", (F.round("hour_sin", 6) + 0.0).alias("hour_sin"), F.array_join("feature_missing", ",").alias("missing")
    )
