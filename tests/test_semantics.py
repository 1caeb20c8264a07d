"""Edge rows and properties of the feature operators."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as fn
from tidemark.operators import marts, online, quality, staging
from tidemark.plans import more, training
from tidemark.plans.catalog import history
from tidemark.registry import REGISTRY, Feature, Registry
from tidemark.schemas import DEMAND_HOURLY
from tidemark.sources import envelope, generate, tables
from tidemark.sources.domain import FEATURE_DATE, Domain
from tidemark.sources.paths import fresh
from tidemark.sources.snapshots import Store, StoreError
from tidemark.streaming import features as streams

T0 = datetime(2024, 1, 10, 12)
EVENTS = "id long, event_id string, city string, event_type string, sim_ts timestamp_ntz, quantity double, temperature_c double, ingested_at timestamp_ntz"


def events(spark, rows):
    """(event_id, city, type, seconds after T0[, ingestion minutes after])."""
    out = [(i, e, c, k, T0 + timedelta(seconds=s), 1.0, 20.0, T0 + timedelta(seconds=s, minutes=m[0] if m else 0)) for i, (e, c, k, s, *m) in enumerate(rows)]
    return spark.createDataFrame(out, EVENTS)


def test_null_ids_collapse_to_one_unless_kept(spark):
    df = events(spark, [(None, "a", "search", 0), (None, "a", "search", 1), ("x", "a", "search", 2), ("x", "a", "search", 3)])
    assert staging.dedup(df).count() == 2
    assert staging.dedup(df, keep_null_keys=True).count() == 3
    assert [r.sim_ts for r in staging.dedup(df).where("event_id = 'x'").collect()] == [T0 + timedelta(seconds=2)]
    by_window = staging.first_row_number(df, "event_id", [F.col("ingested_at"), F.col("id")])
    assert sorted(r.id for r in by_window.collect()) == sorted(r.id for r in staging.dedup(df).collect())


def test_hour_across_the_window_edge_is_partial(spark):
    df = events(spark, [("a", "x", "search", 0, 1), ("b", "x", "search", 60, 90)])
    hourly, _ = staging.stage_demand(df, T0, T0 + timedelta(hours=1))
    assert [r.event_count for r in hourly.collect()] == [1]


def test_rejects_name_all_failed_checks(spark):
    df = spark.createDataFrame([(1, "e", None, None, T0, None, 1.0, T0)], EVENTS)
    _, log = staging.stage_demand(df, T0, T0 + timedelta(hours=1))
    assert log.first().reject_reason == "null_city,null_event_type,null_quantity"


def test_lags_go_by_rows(spark):
    hours = [0, 1, 3, 4]  # one is missing
    df = spark.createDataFrame([("x", T0 + timedelta(hours=h), float(h)) for h in hours], "city string, hour_ts timestamp_ntz, total_demand double")
    got = {r.total_demand: (r.demand_lag_1h, r.demand_roll_3h) for r in marts.with_lags(df).collect()}
    assert got == {0.0: (None, None), 1.0: (0.0, 0.0), 3.0: (1.0, 0.5), 4.0: (3.0, 4 / 3)}


def test_decimals_round_half_up_at_the_table(spark):
    df = spark.createDataFrame([("x", T0, 1.00005, 1, 2.345)], "city string, hour_ts timestamp_ntz, total_demand double, event_count int, avg_temp_c double")
    r = staging.as_stored(df, DEMAND_HOURLY).first()
    assert (str(r.total_demand), str(r.avg_temp_c)) == ("1.0001", "2.35")


def test_point_in_time_features_ignore_the_future(spark, sf_dir):
    d = Domain(spark, sf_dir)
    past = marts.route_features(d.mart, d.demand_events, FEATURE_DATE).orderBy("route_id").collect()
    future = d.mart.limit(5).withColumns({"hour_ts": F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz"), "total_demand": F.lit(9e6), "event_count": F.lit(9999)})
    late = d.demand_events.limit(5).withColumns({"sim_ts": F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz"), "event_type": F.lit("cancellation")})
    again = marts.route_features(d.mart.unionByName(future), d.demand_events.unionByName(late), FEATURE_DATE).orderBy("route_id").collect()
    # Sums of doubles may be taken in another order in another plan; everything else is equal.
    close = lambda x, y: x == y if not isinstance(x, float) else y == pytest.approx(x, rel=1e-9)
    assert past and len(past) == len(again)
    assert all(a.asDict().keys() == b.asDict().keys() and all(map(close, a, b)) for a, b in zip(past, again, strict=True))


def test_lower_bound_is_exclusive(spark):
    days = [FEATURE_DATE - timedelta(days=n) for n in (90, 89, 0)]
    df = spark.createDataFrame([("x", d, 1.0, n) for d, n in zip(days, (100, 10, 20), strict=True)], "city string, day date, daily_demand double, daily_bookings int")
    assert marts.booking_level(df, FEATURE_DATE).first().avg_bookings_90d == 15.0


def test_constant_temperature_has_no_correlation(spark):
    df = spark.createDataFrame([("x", T0 + timedelta(hours=h), 20.0, float(h)) for h in range(3)], "city string, hour_ts timestamp_ntz, temperature_c double, total_demand double")
    assert marts.elasticity(df, FEATURE_DATE).first().elasticity_estimate is None


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", "x", "search", -300)], {"searches_5m": 1}),
        ([("a", "x", "search", -301)], {"searches_5m": 0, "searches_1h": 1}),
        ([("a", "x", "booking", -1000)], {"bookings_15m": 0, "bookings_1h": 1}),
        ([("a", "x", "search", -3700)], {"searches_1h": 0}),
        ([(f"s{i}", "x", "search", -i) for i in range(1, 7)] + [(f"b{i}", "x", "booking", -i) for i in range(3)], {"look_to_book_1h": 0.5}),
        ([("b1", "x", "booking", -5), ("b2", "x", "booking", -6)], {"look_to_book_1h": 2.0}),
    ],
)
def test_sliding_windows(spark, rows, want):
    df = events(spark, [*rows, ("now", "x", "click", 0)])
    got = online.sliding_features(df).orderBy(F.desc("sim_ts")).first()
    assert {k: got[k] for k in want} == want
    asks = spark.createDataFrame([("x", T0)], "route_id string, at timestamp_ntz")
    if (again := online.reconstruct(df, asks).first()) is not None:
        assert {k: again[k] for k in want} == want


def _bounded_frames(df) -> list[str]:
    """Frames of the plan that recompute a window for every row."""
    return re.findall(r"specifiedwindowframe\(RangeFrame, -?\d[^)]*\)", df._jdf.queryExecution().optimizedPlan().toString())


def test_windows_and_replay_cost_a_row_the_same_however_dense_the_events_are(spark):
    """1 500 events in 25 minutes, asked for at each of them: no frame moves with the row, and no join pairs asks with events."""
    df = events(spark, [(f"e{i % 700}" if i % 11 else None, "x", ("search", "booking", "click")[i % 3], i) for i in range(1_500)])
    asks = df.select(F.col("city").alias("route_id"), F.col("sim_ts").alias("at"))
    slid, again = online.sliding_features(df), online.reconstruct(df, asks.unionByName(asks))
    assert not _bounded_frames(slid) and not _bounded_frames(again)
    joins = re.findall(r"Join (\w+)", again._jdf.queryExecution().optimizedPlan().toString())
    assert joins == ["LeftSemi"]
    members = [(r.event_type, r.event_id, (r.sim_ts - T0).total_seconds()) for r in df.collect()]
    want = {}
    for *_, at in members:
        n = [len({e for k, e, t in members if k == kind and e is not None and at - w <= t <= at}) for _, kind, w in online.WINDOWS]
        want[T0 + timedelta(seconds=at)] = (*n, sum(at - online.LONG <= t <= at for *_, t in members))
    assert {r.sim_ts: tuple(r[c] for c, _, _ in online.WINDOWS) for r in slid.collect()} == {k: v[:4] for k, v in want.items()}
    got = again.collect()
    assert len(got) == len(want) and {r.at: (*(r[c] for c, _, _ in online.WINDOWS), r.rows_scanned) for r in got} == want


def test_envelope_null_value_passes_but_missing_key_fails(spark):
    good = '{"schema_version":1,"event_id":"a","produced_at":"t","payload":{"city":null,"event_type":"s","sim_ts":"t","quantity":1}}'
    short = '{"schema_version":1,"event_id":"a","produced_at":"t","payload":{"city":"x","event_type":"s","sim_ts":"t"}}'
    later = good.replace('"schema_version":1', '"schema_version":99')
    df = spark.createDataFrame([(bytearray(b"k"), bytearray(v.encode())) for v in (good, short, later, "{")], "key binary, value binary")
    valid, dead = envelope.split(df, "demand")
    assert valid.count() == 1
    assert sorted(r.headers[0].value.decode() for r in dead.collect()) == ["malformed envelope", "missing quantity", "unknown schema_version 99"]
    assert all(bytes(r.key) == b"k" for r in dead.collect())


def test_a_message_is_written_and_parsed_once(spark, sf_dir):
    """Neither the reasons nor the fields cost another parse; a null and an empty value are one dead letter each."""
    d = Domain(spark, sf_dir)
    valid, dead = envelope.split(more.messages(d), "demand")
    for df in (envelope.demand_rows(valid), dead):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator") == 2 and plan.count("Relation [") == 1
    assert valid.count() + dead.count() == d.demand_events.count()
    odd = spark.createDataFrame([(bytearray(b"k"), None), (bytearray(b"k"), bytearray()), (bytearray(b"k"), bytearray(b"[]")), (None, bytearray(b"{}"))], "key binary, value binary")
    valid, dead = envelope.split(odd, "demand")
    assert valid.count() == 0 and [r.headers[0].value.decode() for r in dead.collect()] == ["malformed envelope"] * 4


def test_store_failure_sends_the_batch_to_dead_letters(spark, sf_dir, monkeypatch):
    def broken(*_a, **_k):
        raise StoreError("no store")

    monkeypatch.setattr(Store, "insert_ignore", broken)
    path = fresh(spark, "store")
    streams.ingest(more.messages(more.Live(spark, sf_dir)), "demand", path, fresh(spark, "p")).awaitTermination()
    rows = Store(spark, path).read(streams.DEAD)
    assert rows.count() == 1000
    assert rows.select(F.col("headers")[0]["value"].cast("string")).first()[0] == "store: StoreError"


def test_insert_ignore_is_idempotent(spark):
    path, df = fresh(spark, "t"), events(spark, [("a", "x", "search", 0), ("a", "x", "search", 1), ("b", "x", "search", 2)])
    tables.insert_ignore(df, path)
    tables.insert_ignore(df, path)
    assert tables.stored(spark, path).count() == 2
    assert staging.duplicate_groups(tables.stored(spark, path)).count() == 0


def test_upsert_rewrites_only_the_partitions_it_touches(spark):
    path = fresh(spark, "parts")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, part string")
    tables.upsert(frame([(1, "a", "p"), (2, "b", "p"), (3, "c", "q")]), path, ["k"], by="part")
    files = lambda part: {r.input for r in tables.stored(spark, path).where(F.col("part") == part).select(F.input_file_name().alias("input")).collect()}
    other = files("q")
    tables.upsert(frame([(2, "x", "p"), (4, "d", "p")]), path, ["k"], by="part")
    assert sorted((r.k, r.v, r.part) for r in tables.stored(spark, path).collect()) == [(1, "a", "p"), (2, "x", "p"), (3, "c", "q"), (4, "d", "p")]
    assert files("q") == other


def _hashes(spark, n):
    store = spark.createDataFrame([(f"r{i}", float(i), None) for i in range(n)], "route_id string, a double, b double")
    return online.as_hash(store, "route_id", ["a", "b"]).coalesce(1)


def test_sync_sends_batches_and_then_the_marker(spark, tmp_path):
    out = tmp_path / "sent"

    def send(batch):
        with out.open("a") as f:
            f.write("".join(f"{len(batch)} {k} {sorted(v)} {v['batch_computed_at']}\n" for k, v in batch))

    assert tables.sync(_hashes(spark, 7), send, lambda at: (tmp_path / at).touch(), "now", batch_size=3) == 7
    lines = out.read_text().splitlines()
    assert len(lines) == 7 and all("['a', 'batch_computed_at'] now" in x for x in lines) and {x[0] for x in lines} == {"3", "1"}
    assert (tmp_path / "now").exists()


def test_sync_leaves_the_marker_without_rows_or_after_a_failure(spark):
    done = []
    assert tables.sync(_hashes(spark, 3).limit(0), lambda _: None, done.append, "now") == 0

    def broken(batch):
        raise OSError("the store is away")

    with pytest.raises(Exception, match="the store is away"):
        tables.sync(_hashes(spark, 3), broken, done.append, "now")
    assert not done


def test_a_live_stream_takes_messages_as_they_come(spark, sf_dir):
    path = fresh(spark, "live")
    going = streams.ingest(more.messages(more.Live(spark, sf_dir)), "demand", path, fresh(spark, "p"), live=True)
    try:
        going.processAllAvailable()
        store = Store(spark, path)
        assert going.isActive and store.count("demand") + store.count(streams.DEAD) == 1000
        assert going.lastProgress is not None
    finally:
        going.stop()


def psi(spark, ref, cur):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    return quality.psi_numeric(frame(ref), frame(cur), "v").first().psi


def test_psi_edges(spark):
    assert psi(spark, range(100), range(4)) == 0.0  # too few current values
    assert psi(spark, [1] * 100, range(50)) == 0.0  # constant reference
    assert psi(spark, range(100), range(100)) == pytest.approx(0.0, abs=1e-9)
    assert psi(spark, range(100), [*range(50), *[1000] * 50]) > 0.5  # outside values only count in the total


def test_overlay_defaults_and_staleness(spark):
    base = spark.createDataFrame([("x",), ("y",)], "route_id string")
    store = spark.createDataFrame([("x", {"searches_5m": "3", "look_to_book_1h": "oops", "stream_computed_at": "2024-01-10 11:50:00"})], "route_id string, fields map<string,string>")
    got = {r.route_id: r for r in online.online_overlay(base, store, T0).collect()}
    assert got["x"].searches_5m == 3.0 and got["x"].look_to_book_1h == 0.0
    assert "look_to_book_1h" in got["x"].missing and got["x"].stale == ["searches_5m"] and got["x"].degraded
    assert len(got["y"].missing) == 6 and got["y"].weather_temp_c is None


def test_registry():
    assert len(REGISTRY) == 18 and len(REGISTRY.of("batch")) == 12
    assert Feature("a", "batch", default=1) == Feature("a", "batch", default=2)
    with pytest.raises(ValueError, match="twice"):
        Registry([Feature("a", "batch"), Feature("a", "stream")])


def test_horizon_bounds_and_history_clamp(spark, sf_dir):
    mart = Domain(spark, sf_dir).mart
    with pytest.raises(ValueError):
        online.horizon_rows(mart, 169, T0)
    assert history(mart, "london", 0).count() == 1


def test_preparation_unknown_city_and_order(spark):
    rows = spark.createDataFrame([("a", T0, 1.0, 1, *[float(i)] * 5, 0.0, 1.0, 0.0, 1.0, None, 2.0, 3.0, True) for i in range(4)], "city string, hour_ts timestamp_ntz, total_demand double, event_count int, demand_lag_1h double, demand_lag_24h double, demand_lag_168h double, demand_roll_3h double, demand_roll_24h double, hour_sin double, hour_cos double, dow_sin double, dow_cos double, temperature_c double, humidity_pct double, precip_mm double, is_holiday boolean")
    prep = training.fit_preparation(rows)
    out = prep.transform(rows.withColumn("city", F.lit("nowhere"))).first()
    assert out.city_a == 0.0 and out.is_holiday == 1.0
    assert prep.medians["demand_lag_1h"] == 1.5 and prep.deviations["demand_lag_1h"] == pytest.approx(1.118, abs=1e-3)


def test_refitting_on_a_spike_differs_from_the_kept_fit(spark):
    frame = lambda lo, hi, n: spark.range(n).select((F.lit(float(lo)) + generate.uniform(F.col("id")) * (hi - lo)).alias("total_demand"))
    train, spike = frame(100, 500, 500), frame(2000, 5000, 100)
    means, devs = training.complete_scaler(train, ("total_demand",))
    kept = training.scaled(spike, means, devs).agg(F.avg("total_demand")).first()[0]
    again = training.scaled(spike, *training.complete_scaler(spike, ("total_demand",))).agg(F.avg("total_demand")).first()[0]
    assert abs(again) < 1e-6 and kept > 20


def test_ridge_equals_the_closed_form(spark, sf_dir):
    import numpy as np

    train, _ = training.split(Domain(spark, sf_dir).mart, 7)
    prep = training.fit_preparation(train)
    model = training.fit_ridge(train, prep)
    rows = training._assembled(train, prep).select("features", "label").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)


def test_decisions():
    assert training.best({"baseline": 0.0, "b": 2.0, "a": 1.0}) == "a"


def test_quality_errors_are_all_collected(spark, sf_dir):
    d = Domain(spark, sf_dir)
    bad = d.mart.withColumns({"city": F.lit(None).cast("string"), "event_count": F.lit(None).cast("int")}).limit(3)
    errors, _ = marts.quality_report(bad, d.demand_hourly)
    assert len(errors) == 3
    with pytest.raises(ValueError):
        marts.check_quality(bad, d.demand_hourly)


def test_faults_lose_values_at_their_rate(spark, sf_dir):
    n, there = more.QUERIES["src_chaos"](spark, sf_dir).first()
    assert 0.85 * n < there < 0.95 * n


def test_shadow_gap_is_the_mean_difference(spark, sf_dir):
    got = {r.city: r.gap for r in more.QUERIES["sv_shadow"](spark, sf_dir).collect()}
    train, val = training.split(Domain(spark, sf_dir).mart, 7)
    prep = training.fit_preparation(train)
    one, two = ({(r.city, r.hour_ts): r.prediction for r in training.predicted(training.fit_ridge(train, prep, alpha=a), val, prep).collect()} for a in (1.0, 100.0))
    for city, gap in got.items():
        own = [abs(v - two[k]) for k, v in one.items() if k[0] == city]
        assert gap == pytest.approx(sum(own) / len(own))


def test_easter_and_holidays():
    days = set(fn.holidays(2024, 2024))
    assert {("GB", date(2024, 3, 29)), ("GB", date(2024, 4, 1)), ("US", date(2024, 11, 28)), ("AU", date(2024, 4, 25)), ("GB", date(2024, 8, 26))} <= days


def test_snapshot_hash_sees_changes(spark, sf_dir):
    hourly = Domain(spark, sf_dir).demand_hourly.select("city", "hour_ts", F.round("total_demand", 4).alias("total_demand"))
    one = fn.snapshot_hash(hourly, ["city", "hour_ts"], "total_demand").first().hash16
    again = fn.snapshot_hash(hourly.repartition(3), ["city", "hour_ts"], "total_demand").first().hash16
    other = fn.snapshot_hash(hourly.withColumn("total_demand", F.col("total_demand") + 1), ["city", "hour_ts"], "total_demand").first().hash16
    assert one == again != other and len(one) == 16
