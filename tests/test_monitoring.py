"""Drift states, metric series, alerts, the model registry, leases and the prediction log."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, quality, series
from tidemark.plans import models, training
from tidemark.sources.domain import Domain
from tidemark.sources.paths import fresh
from tidemark.sources.registry_log import ARCHIVED, PRODUCTION, STAGING, Lease, Registry
from tidemark.sources.snapshots import Conflict, Store, StoreError

T0 = datetime(2024, 1, 10)

# Drift


def test_reports_from_states_equal_reports_over_rows(spark, sf_dir):
    mart = Domain(spark, sf_dir).mart
    rounded = mart.withColumns({c: F.round(F.col(c).cast("double"), drift.DIGITS) for c in quality.DRIFT_FEATURES})
    window = (T0, date(2024, 1, 3), date(2024, 1, 12), date(2024, 1, 20), date(2024, 1, 27))
    days = F.to_date("hour_ts")
    want = quality.drift_report(rounded.where(days.between(window[1], window[2])), rounded.where(days.between(window[3], window[4])))
    store = Store(spark, fresh(spark, "drift"))
    counts = drift.day_counts(mart)
    drift.keep_days(store, counts.where("day < DATE '2024-01-15'"))
    drift.keep_days(store, counts.where("day >= DATE '2024-01-10'"))  # some days again
    got = drift.reports(store.read(drift.STATES), [window]).drop("checked_at")
    assert {r.feature_name for r in got.collect()} == set(quality.DRIFT_FEATURES)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_only_a_rolling_feature_drifts_and_training_starts(spark):
    rng = random.Random(1)
    rows = [(T0 + timedelta(hours=h), *[rng.random() for _ in quality.DRIFT_FEATURES[:-1]], False) for h in range(480)]
    at = quality.DRIFT_FEATURES.index("demand_roll_24h") + 1
    rows = [(*r[:at], r[at] + (5 if k >= 240 else 0), *r[at + 1 :]) for k, r in enumerate(rows)]
    mart = spark.createDataFrame(rows, "hour_ts timestamp_ntz, " + ", ".join(f"{c} double" for c in quality.DRIFT_FEATURES[:-1]) + ", is_holiday boolean")
    window = (T0, date(2024, 1, 10), date(2024, 1, 19), date(2024, 1, 20), date(2024, 1, 29))
    report = {r.feature_name: r for r in drift.reports(drift.day_counts(mart), [window]).collect()}
    assert [n for n, r in report.items() if r.drift_detected] == ["demand_roll_24h"]
    done, lease = [], Lease(spark, fresh(spark, "lease"))
    scores = {n: (r.drift_score, r.drift_detected) for n, r in report.items()}
    assert training.retrain(lease, "a", {n: s for n, s in scores.items() if n != "demand_roll_24h"}, mart, T0, lambda: done.append(1)) == "no drift"
    assert training.retrain(lease, "a", scores, mart, T0, lambda: done.append(1)) == "trained" and done == [1]


def test_kept_reports_are_appended_once(spark):
    store = Store(spark, fresh(spark, "drift"))
    counts = spark.createDataFrame([(date(2024, 1, d), c, float(v), 3) for d in range(1, 20) for c in (drift.ALL, "temperature_c") for v in range(10)], "day date, feature string, v double, n long")
    windows = drift.daily_windows(date(2024, 1, 16), date(2024, 1, 18), 10)
    for _ in range(2):
        drift.keep_reports(store, drift.reports(counts, windows, ("temperature_c",)), batch=("daily", 1))
    kept = store.read(drift.REPORTS)
    assert kept.count() == 3 and {(r.reference_count, r.current_count, r.drift_score) for r in kept.collect()} == {(300, 30, 0.0)}
    assert drift.hits(kept).count() == 0 and drift.hits(kept.withColumn("drift_detected", F.lit(True)), 2).first().checked_at == datetime(2024, 1, 18)


# Series


def samples(spark, rows):
    return spark.createDataFrame([("a", t, float(v)) for t, v in rows], "name string, t long, v double")


def test_counters_that_begin_again(spark):
    # 10 a minute, begun again after 240 s; samples reach both ends of (0, 600] but for a minute.
    rows = [(60 * k, 100 + 10 * k if k <= 4 else 10 * (k - 4)) for k in range(1, 11)]
    got = {r.t: r for r in series.increases(samples(spark, rows), ["name"], 600, 600).collect()}
    # 90 between the first and the last, and a tenth of the way more at the start, where the gap is one distance.
    assert got[600].increase == pytest.approx(90 * 600 / 540) and got[600].rate == pytest.approx(got[600].increase / 600)
    # Never further back than zero: begun at 5 and 10 more in each minute.
    few = series.increases(samples(spark, [(60 * k, 5 + 10 * (k - 5)) for k in range(5, 10)]), ["name"], 600, 600).first()
    assert few.increase == pytest.approx(40 * (240 + 30 + 60) / 240)
    assert series.increases(samples(spark, [(60, 1)]), ["name"], 600, 600).count() == 0


def test_windows_across_slots_are_whole(spark):
    rng = random.Random(2)
    rows = [(30 * k + rng.randrange(20), k % 97) for k in range(3_000)]
    got = {r.t: r.increase for r in series.increases(samples(spark, rows), ["name"], 300, 100).collect()}
    for at in range(1_000, 80_000, 700):
        inside = [(t, v) for t, v in rows if at - 300 < t <= at]
        delta = inside[-1][1] - inside[0][1] + sum(a for (_, a), (_, b) in zip(inside, inside[1:], strict=False) if b < a)
        span, mean = inside[-1][0] - inside[0][0], (inside[-1][0] - inside[0][0]) / (len(inside) - 1)
        start, end = inside[0][0] - (at - 300), at - inside[-1][0]
        start, end = (x if x < 1.1 * mean else mean / 2 for x in (start, end))
        start = min(start, span * inside[0][1] / delta) if delta > 0 else start
        assert got[at] == pytest.approx(delta * (span + start + end) / span)


def test_quantiles_of_buckets(spark):
    rows = [("a", 0, le, c) for le, c in ((0.1, 10.0), (0.5, 40.0), (math.inf, 50.0))] + [("b", 0, le, 0.0) for le in (0.1, 0.5, math.inf)]
    df = spark.createDataFrame(rows, "name string, t long, le double, rate double")
    of = lambda q: {r.name: r.value for r in series.histogram_quantile(df, ["name"], q).collect()}
    assert of(0.5) == {"a": pytest.approx(0.1 + 0.4 * 15 / 30), "b": None}
    assert of(0.1)["a"] == pytest.approx(0.05) and of(0.99)["a"] == 0.5


def test_steps_take_the_last_value_within_the_look_back(spark):
    df = samples(spark, [(10, 1), (320, 2), (1_000, float("nan"))])
    got = {r.t: r.v for r in series.on_grid(df, ["name"], 0, 1_200, 100).collect()}
    assert [got[t] for t in (0, 100, 300, 400, 600, 700)] == [None, 1.0, 1.0, 2.0, 2.0, None]
    assert {r.t for r in series.history(df, ["name"], 1_200, 500, 100).collect()} == {100, 200, 300, 400, 500, 600}
    known = spark.createDataFrame([("z",)], "name string")
    assert [r.v for r in series.on_grid(df.limit(0), ["name"], 0, 100, 100, None, known).collect()] == [None, None]


def states(spark, values, lasting, step=60):
    df = spark.createDataFrame([("a", step * k, None if v is None else float(v)) for k, v in enumerate(values)], "name string, t long, v double")
    return sorted((r.state, r.t_from, r.t_to) for r in series.alert_states(df, ["name"], F.col("v") > 10, step, lasting).collect())


def test_a_spike_of_four_minutes_does_not_fire(spark):
    quiet = [0] * 5
    assert states(spark, quiet + [20] * 5 + quiet, 300) == [("pending", 300, 600)]  # holds from 300 to 540: four minutes
    assert states(spark, quiet + [20] * 6 + quiet, 300) == [("firing", 600, 660), ("pending", 300, 600), ("resolved", 660, None)]
    assert states(spark, quiet + [20] * 8, 300) == [("firing", 600, None), ("pending", 300, 600)]
    assert states(spark, [20, None, 20], 0) == [("firing", 0, 60), ("firing", 120, None), ("resolved", 60, None)]
    assert states(spark, quiet, 300) == []


# Models


def test_of_two_promotions_at_once_one_wins(spark, monkeypatch):
    registry = Registry(spark, fresh(spark, "registry"))
    for k in range(2):
        registry.change(registry.register(f"run{k}", 1.0, {}, T0), STAGING)
    other, state = Registry(spark, registry.log.folder), registry.state()
    assert other.promote() == 2
    monkeypatch.setattr(registry, "state", lambda: state)  # what this one saw before
    with pytest.raises(Conflict):
        registry.promote()
    assert [m["stage"] for m in other.state()[1]] == [STAGING, PRODUCTION]
    assert other.promote() == 1 and [m["stage"] for m in other.state()[1]] == [PRODUCTION, ARCHIVED]
    with pytest.raises(LookupError):
        other.promote()
    assert other.table().count() == 2 and other.newest(PRODUCTION)["run_id"] == "run0"


def test_gates_against_the_stored_production_model(spark):
    rows = spark.createDataFrame([(float(x), 2.0 * x) for x in range(10)], "x double, total_demand double")
    registry = Registry(spark, fresh(spark, "registry"))
    line = lambda slope: {"feature": "x", "slope": slope, "intercept": 0.0}
    def add(parameters, psi=None):
        return training.gate(registry, registry.register("r", None, parameters, T0), psi or {}, rows)

    assert add(line(5.0), {"city": 0.3}) == "feature_drift: city" and registry.newest(STAGING) is None
    assert add(line(1.0)) == "no_production_model_exists"
    registry.promote()
    assert add(line(0.5)) == "holdout_mae" and add(line(1.0)) == "holdout_mae" and add(line(1.5)) == "beats_production"
    assert registry.newest(STAGING)["tags"]["compared_against_prod_version"] == "2"
    for broken in ({}, {"feature": "gone", "slope": 1.0, "intercept": 0.0}, {"feature": "x", "slope": None, "intercept": 0.0}):
        registry.change(registry.register("broken", None, broken, T0), PRODUCTION)
        assert add(line(0.1)) == "production_model_eval_failed"


def test_a_lease_is_one_owners_until_it_runs_out(spark):
    lease, other = (Lease(spark, folder, 60) for folder in [fresh(spark, "lease")] * 2)
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    assert lease.take("a", at(0)) and not other.take("b", at(59))
    assert other.take("b", at(60)) and other.last_run() == at(60)
    lease.give_back("a")  # not its own any more
    assert not lease.take("a", at(70))
    other.give_back("b")
    assert lease.take("a", at(71))


def test_two_triggers_one_run(spark):
    rows, drifted, done = spark.range(150), {"x": (0.5, False)}, []
    lease = Lease(spark, fresh(spark, "lease"))
    first = lambda: done.append(training.retrain(lease, "two", drifted, rows, T0 + timedelta(minutes=1), lambda: None, cooldown_minutes=0))
    assert training.retrain(lease, "one", drifted, rows, T0, first) == "trained" and done == ["already running"]
    assert training.retrain(lease, "three", drifted, rows, T0 + timedelta(minutes=300), lambda: None) == "cooling down"
    assert training.retrain(lease, "four", drifted, rows.limit(99), T0 + timedelta(minutes=400), lambda: None) == "too few rows"

    def fails():
        raise RuntimeError("out of memory")

    with pytest.raises(RuntimeError):
        training.retrain(lease, "five", drifted, rows, T0 + timedelta(minutes=800), fails)
    assert training.retrain(lease, "six", drifted, rows, T0 + timedelta(minutes=1200), lambda: None) == "trained"


def test_a_prediction_is_logged_in_two_rows_or_none(spark, monkeypatch):
    store = Store(spark, fresh(spark, "log"))
    log = spark.createDataFrame([(f"r{k}", [1.0]) for k in range(3)], "request_id string, preds array<double>")
    features = spark.createDataFrame([(f"r{k}", 2.0) for k in range(3)], "request_id string, x double")
    both = lambda: (store.count(models.LOG), store.count(models.FEATURES))
    stage = Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, name, *a, **k: stage(self, name, *a, **k) if name == models.LOG else (_ for _ in ()).throw(StoreError("away")))
    with pytest.raises(StoreError):
        models.log_predictions(store, log, features)
    assert both() == (0, 0)
    monkeypatch.setattr(Store, "stage", stage)
    for _ in range(2):
        models.log_predictions(store, log, features)
    assert both() == (3, 3)
    more = lambda df, *rest: df.unionByName(spark.createDataFrame([("r9", *rest)], df.schema))
    models.log_predictions(store, more(log, [3.0]), more(features, 4.0))
    assert both() == (4, 4)


def test_no_step_of_a_log_commit_reads_the_events(spark, sf_dir, monkeypatch):
    read, commit = [], models.log_predictions
    monkeypatch.setattr(models, "log_predictions", lambda store, log, features: read.extend(log.inputFiles() + features.inputFiles()) or commit(store, log, features))
    assert models.QUERIES["sv_log"](spark, sf_dir).count() == 10
    assert read and not [f for f in read if sf_dir in f]
