"""Stored tables: commits, retries, key lookups, snapshots; streams that are run again."""

from __future__ import annotations

import random
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import online
from tidemark.plans import more
from tidemark.sources import lake, paths, snapshots, tables
from tidemark.sources.domain import Domain
from tidemark.sources.paths import delete, fresh
from tidemark.sources.snapshots import PART, Conflict, Store, StoreError, VersionLog
from tidemark.streaming import features as streams

KV = "k string, v long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def counts(store):
    return store.count("demand"), store.count(streams.DEAD)


def test_a_number_is_given_once(spark):
    log = VersionLog(spark, fresh(spark, "log"))
    assert log.last() == 0 and log.get(0) == {}
    assert log.put(1, {"a": 1}) == 1 and log.get(log.last()) == {"a": 1}
    with pytest.raises(Conflict):
        log.put(1, {"a": 2})
    assert log.get(1) == {"a": 1}


def test_a_batch_that_runs_again_changes_nothing(spark):
    store, rows = Store(spark, fresh(spark, "s")), spark.createDataFrame([("a", 1)], KV)
    for batch in (0, 0, 1, 0):
        store.append({"t": rows}, batch=("stream", batch))
    assert store.count("t") == 2 and store.version() == 2 and store.applied("stream") == 1 and store.applied("other") == -1


def test_an_insert_writes_its_tables_at_once_and_nothing_beside_them(spark, monkeypatch):
    """A micro-batch is a few short jobs: no table on the way, and a table does not wait for another to be staged."""
    store, beside, both = Store(spark, fresh(spark, "s")), [], threading.Barrier(2, timeout=60)
    monkeypatch.setattr(snapshots, "written", lambda df, name: beside.append(name) or paths.written(df, name))
    stage = Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, *a, **k: both.wait() and None or stage(self, *a, **k))
    dead = spark.createDataFrame([("x", 0)], KV)
    for n, keys in enumerate(("ab", "bc")):
        rows = spark.createDataFrame([(k, n) for k in keys], KV)
        store.insert_ignore("t", rows, "k", batch=("stream", n), also={"dead": dead})
    assert rows_of(store.read("t")) == [("a", 0), ("b", 0), ("c", 1)] and store.count("t") == 3 and store.count("dead") == 2
    assert not beside


def test_several_tables_are_committed_together(spark, monkeypatch):
    store, rows = Store(spark, fresh(spark, "s")), spark.createDataFrame([("a", 1)], KV)
    store.append({"log": rows, "features": rows})
    stage = Store.stage

    def broken(self, name, *a, **k):
        if name == "features":
            raise StoreError("the disk is full")
        return stage(self, name, *a, **k)

    monkeypatch.setattr(Store, "stage", broken)
    with pytest.raises(StoreError):
        store.append({"log": rows, "features": rows})
    assert (store.count("log"), store.count("features")) == (1, 1)


def test_writers_at_once_lose_nothing(spark):
    store = Store(spark, fresh(spark, "s"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: Store(spark, store.path).insert_ignore("t", spark.createDataFrame([("same", i), (f"own{i}", i)], KV), "k"), range(3)))
    assert sorted(r.k for r in store.read("t").collect()) == ["own0", "own1", "own2", "same"]


def test_other_columns_are_refused(spark):
    store = Store(spark, fresh(spark, "s"))
    store.append({"t": spark.createDataFrame([("a", 1)], KV)})
    with pytest.raises(StoreError, match="other columns"):
        store.append({"t": spark.range(1)})


def test_a_batch_opens_only_files_that_may_hold_its_keys(spark):
    store = Store(spark, fresh(spark, "s"))
    frame = lambda keys: spark.createDataFrame([(k, 1) for k in keys], KV)
    for n in range(6):
        store.insert_ignore("t", frame([f"{n}-{i}" for i in range(500)]), "k")
    store.insert_ignore("t", spark.createDataFrame([(None, 1), (None, 2)], KV), "k")
    total = store.manifest().count()
    assert total == 6 * 16 + 1
    bucket = F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("k"), F.lit(16)).cast("string"))
    again = store.candidates("t", frame([f"3-{i}" for i in range(500)]), "k", bucket, store.version())
    opened = set(again.inputFiles())
    # Its own 16 files, and of the other 80 those that a filter of 16 bits a key lets through by mistake.
    assert 16 <= len(opened) <= 40
    assert again.columns == ["k"] and "ReadSchema: struct<k:string>" in again._jdf.queryExecution().executedPlan().toString()
    assert len(set(store.candidates("t", frame(["new"]), "k", bucket, store.version()).inputFiles()) if store.candidates("t", frame(["new"]), "k", bucket, store.version()) else []) <= 1
    store.insert_ignore("t", frame([f"3-{i}" for i in range(400, 600)]), "k")
    assert store.count("t") == 3_000 + 2 + 100 == store.read("t").count()
    # Merged buckets hold the same, under the same index.
    before = rows_of(store.read("t"))
    store.compact("t", "k")
    assert rows_of(store.read("t")) == before and store.manifest().count() == 16 + 1
    store.insert_ignore("t", frame(["3-1", "one more"]), "k")
    assert store.count("t") == len(before) + 1
    assert PART not in store.read("t").columns


def test_a_reader_keeps_its_version_and_a_dead_writer_leaves_none(spark, monkeypatch):
    path = fresh(spark, "s")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, part string")
    first = [(1, "a", "p"), (2, "b", "q"), (3, "c", "")]
    tables.upsert(frame(first), path, ["k"], by="part")
    opened = tables.stored(spark, path)
    commit = Store.commit
    monkeypatch.setattr(Store, "commit", lambda *_a, **_k: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # both parts are written, and nothing is committed
        tables.upsert(frame([(1, "x", "p"), (2, "y", "q")]), path, ["k"], by="part")
    assert rows_of(tables.stored(spark, path)) == rows_of(frame(first))
    monkeypatch.setattr(Store, "commit", commit)
    tables.upsert(frame([(1, "x", "p"), (2, "y", "q"), (4, "z", None)]), path, ["k"], by="part")
    assert {(r.k, r.v) for r in tables.stored(spark, path).collect()} == {(1, "x"), (2, "y"), (3, "c"), (4, "z")}
    assert rows_of(opened) == rows_of(frame(first))
    assert Store(spark, path).vacuum(keep=1, grace_hours=0) == 2  # the first version's and the dead writer's
    assert tables.stored(spark, path).count() == 4


def test_manifest_parts_are_put_together(spark, monkeypatch):
    monkeypatch.setattr("tidemark.sources.snapshots.MANIFEST_PARTS", 3)
    store, rows = Store(spark, fresh(spark, "s")), spark.createDataFrame([("a", 1)], KV)
    for _ in range(5):
        store.append({"t": rows})
    assert store.count("t") == 5 and len(store.log.get(store.version())["manifest"]) < 5


# Streams


def topic(spark, sf_dir, per_file):
    path, all_ = fresh(spark, "topic"), more.messages(Domain(spark, sf_dir))
    from tidemark.sources import envelope

    envelope.topic_files(all_, path, per_file)
    return lambda: envelope.from_files(spark, path, all_.schema)


def test_a_stream_whose_commit_is_lost_repeats_nothing(spark, sf_dir):
    stream, path, point = topic(spark, sf_dir, 400), fresh(spark, "store"), fresh(spark, "p")
    streams.ingest(stream(), "demand", path, point).awaitTermination()
    store = Store(spark, path)
    before, version = counts(store), store.version()
    assert before == (864, 136) and version >= 3  # a version a batch
    delete(spark, f"{point}/commits/{version - 1}")
    streams.ingest(stream(), "demand", path, point).awaitTermination()
    assert counts(store) == before and store.version() == version
    # A fresh checkpoint reads all again: rows are known by their ids, what is dead has none and comes again.
    streams.ingest(stream(), "demand", path, fresh(spark, "p")).awaitTermination()
    assert counts(store) == (864, 272)


def test_a_store_that_fails_twice_loses_and_repeats_nothing(spark, sf_dir, monkeypatch):
    stream, path, point = topic(spark, sf_dir, 400), fresh(spark, "store"), fresh(spark, "p")
    commit, left = Store.commit, [1, 1, 0]

    def failing(self, *a, **k):
        if self.version() == 1 and left.pop(0):
            raise StoreError("the store is away")
        return commit(self, *a, **k)

    monkeypatch.setattr(Store, "commit", failing)
    for _ in range(2):
        with pytest.raises(Exception, match="the store is away"):
            streams.ingest(stream(), "demand", path, point, retry=True).awaitTermination()
        assert Store(spark, path).version() == 1
    streams.ingest(stream(), "demand", path, point, retry=True).awaitTermination()
    assert counts(Store(spark, path)) == (864, 136)
    assert Store(spark, path).read("demand").groupBy("event_id").count().where("count > 1").count() == 0


def test_a_fault_of_the_plan_is_no_dead_letter(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(streams.envelope, "demand_rows", lambda valid: valid.select(F.expr("raise_error('a bug')").cast("string").alias("event_id")))
    path = fresh(spark, "store")
    with pytest.raises(Exception, match="a bug"):
        streams.ingest(more.messages(more.Live(spark, sf_dir)), "demand", path, fresh(spark, "p")).awaitTermination()
    assert Store(spark, path).version() == 0


def test_small_batches_take_few_jobs_and_leave_few_files(spark, sf_dir, monkeypatch):
    """What a micro-batch costs does not grow with the number of those before it, and no key is lost on the way to its bucket."""
    monkeypatch.setattr(snapshots, "FEW_FILES", 2)
    monkeypatch.setattr(snapshots, "FEW_ROWS", 120)  # two batches' rows are more
    stream, path, dealt, jobs = topic(spark, sf_dir, 100), fresh(spark, "store"), [], []
    stage, tidy = Store.stage, Store.tidy
    ran = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(spark.streams.active[0].runId)))
    monkeypatch.setattr(Store, "stage", lambda self, name, *a, **k: dealt.append(name) or stage(self, name, *a, **k))
    monkeypatch.setattr(Store, "tidy", lambda self, *a, **k: jobs.append(ran()) or tidy(self, *a, **k) and jobs.append(ran()))
    streams.ingest(stream(), "demand", path, fresh(spark, "p"), at_most=100).awaitTermination()
    store = Store(spark, path)
    assert counts(store) == (864, 136) and dealt.count("demand") >= 2
    files = {n: store.manifest().where(F.col("name") == n).count() for n in ("demand", streams.DEAD)}
    assert files["demand"] <= 2 + 2 + 2 * 16 and files[streams.DEAD] <= 2 + 2 + 2  # of 10 batches, each of which was 16 files
    assert max(after - before for before, after in zip([0, *jobs[1::2]], jobs[::2])) <= 15  # noqa: B905
    assert store.read("demand").select("event_id").distinct().count() == 864 and store.read(streams.DEAD).count() == 136
    # All are known to a large batch too, wherever they are now.
    streams.ingest(more.messages(more.Live(spark, sf_dir)), "demand", path, fresh(spark, "p")).awaitTermination()
    assert counts(store) == (864, 272)


def test_a_repeated_id_in_small_batches_is_one_row(spark):
    path, point = fresh(spark, "store"), fresh(spark, "p")
    value = lambda i: f'{{"schema_version": 1, "event_id": "{i}", "produced_at": "x", "payload": {{"city": "x", "event_type": "search", "sim_ts": "2024-01-01T00:00:00", "quantity": "1"}}}}'
    folder = fresh(spark, "topic")
    for ids in (["a", "b", "a"], ["b", "c"], []):
        rows = [(bytearray(b"k"), bytearray(value(i).encode())) for i in ids] or [(None, None)]
        spark.createDataFrame(rows, "key binary, value binary").coalesce(1).write.mode("append").parquet(folder)
    streams.ingest(streams.envelope.from_files(spark, folder, spark.read.parquet(folder).schema), "demand", path, point, at_most=3).awaitTermination()
    store = Store(spark, path)
    assert sorted(r.event_id for r in store.read("demand").collect()) == ["a", "b", "c"] and store.count(streams.DEAD) == 1 and store.version() == 3


def test_a_small_batch_fails_as_a_large_one_does(spark, sf_dir, monkeypatch):
    stream, path = topic(spark, sf_dir, 400), fresh(spark, "store")
    with monkeypatch.context() as patch:
        patch.setattr(streams.envelope, "demand_rows", lambda valid: valid.select(F.expr("raise_error('a bug')").cast("string").alias("event_id")))
        with pytest.raises(Exception, match="a bug"):
            streams.ingest(stream(), "demand", path, fresh(spark, "p"), at_most=400).awaitTermination()
    assert Store(spark, path).version() == 0
    with monkeypatch.context() as patch:
        patch.setattr(Store, "insert_ignore", lambda *_a, **_k: (_ for _ in ()).throw(StoreError("no store")))
        streams.ingest(stream(), "demand", path, fresh(spark, "p"), at_most=400).awaitTermination()
    assert Store(spark, path).read(streams.DEAD).count() == 1000
    streams.ingest(stream(), "demand", path, fresh(spark, "p"), at_most=400).awaitTermination()
    assert counts(Store(spark, path)) == (864, 1136)


# The lake


def test_an_hour_that_failed_is_written_again(spark, monkeypatch):
    start = datetime(2024, 1, 10)
    rows = spark.createDataFrame([(i, start + timedelta(minutes=i)) for i in range(240)], "id long, ingested_at timestamp_ntz")
    root, now, publish, done = fresh(spark, "lake"), start + timedelta(hours=4, minutes=5), paths.publish, []

    def dies(*a):
        if len(done) == 2:
            raise OSError("the name node is away")
        done.append(publish(*a))

    monkeypatch.setattr(paths, "publish", dies)
    with pytest.raises(OSError):
        lake.write_hourly(rows, root, "t", now)
    assert lake.scan(spark, root, "t").groupBy("hour").count().where("count = 60").count() == 2 == lake.slots(spark, root, "t").count()
    monkeypatch.setattr(paths, "publish", publish)
    lake.write_hourly(rows, root, "t", now)
    lake.write_hourly(rows, root, "t", now)
    assert [r["count"] for r in lake.scan(spark, root, "t").groupBy("hour").count().collect()] == [60] * 4


def test_a_hot_hour_has_several_files(spark):
    start = datetime(2024, 1, 10)
    rows = spark.range(200_000, numPartitions=4).select("id", F.when(F.col("id") % 50 == 0, F.lit(start)).otherwise(F.lit(start + timedelta(hours=1))).cast("timestamp_ntz").alias("ingested_at"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    root = fresh(spark, "lake")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        lake.write_hourly(rows, root, "t", start + timedelta(hours=3))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {r.hour: r.n for r in lake.listing(spark, root).groupBy(lake.path_parts(F.col("path"))[2].alias("hour")).agg(F.count("*").alias("n")).collect()}
    assert files["01"] >= 4 and files["00"] >= 1
    assert lake.scan(spark, root, "t").count() == 200_000


# Sliding windows in a stream

T0 = datetime(2024, 1, 10, 11)
EVENTS = "id long, event_id string, city string, event_type string, sim_ts timestamp_ntz"
COLUMNS = ["route_id", "id", "searches_5m", "bookings_15m", "searches_1h", "bookings_1h", "look_to_book_1h"]


def by_hand(events):
    out = []
    for i, _, city, _, t in events:
        if city is None:
            continue
        within = lambda kind, s: len({e for _, e, c, k, u in events if c == city and k == kind and e and timedelta(0) <= t - u <= timedelta(seconds=s)})  # noqa: B023, E731
        s1, b1 = within("search", 3600), within("booking", 3600)
        out.append((city, i, within("search", 300), within("booking", 900), s1, b1, round(b1 / max(1, s1), 6)))
    return sorted(out, key=repr)


def odd_events(n=400, seed=5):
    """Over three slots; null and repeated ids, ties, and arrivals up to 50 minutes late."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = T0 + timedelta(seconds=rng.randrange(0, 60) * (60 if rng.random() < 0.5 else 1), hours=2.0 * i / n * 4)
        event = None if rng.random() < 0.1 else f"e{rng.randrange(n // 2)}"
        rows.append((i, event, rng.choice(["x", "y", None]), rng.choice(["search", "booking", "click"]), t))
    return rows


def test_batch_windows_equal_a_direct_count(spark):
    events = odd_events()
    got = online.sliding_features(spark.createDataFrame(events, EVENTS)).select(COLUMNS)
    assert rows_of(got) == by_hand(events)


def test_stream_equals_batch_row_by_row_with_late_rows(spark):
    events, folder = odd_events(), fresh(spark, "arrivals")
    rng = random.Random(6)
    arrival = sorted(events, key=lambda e: e[4] + timedelta(minutes=rng.random() * 50))
    for k in range(0, len(arrival), 100):
        spark.createDataFrame(arrival[k : k + 100], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.sliding(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder))
    out, point = fresh(spark, "out"), fresh(spark, "p")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    assert rows.count() > len(by_hand(events))  # late events had earlier ones told anew
    assert rows_of(streams.latest(rows).select(COLUMNS)) == by_hand(events)


def test_state_of_an_idle_route_goes(spark):
    folder = fresh(spark, "arrivals")
    day = lambda d, route, n: spark.createDataFrame([(d * 1000 + i, f"{d}-{i}", route, "search", T0 + timedelta(days=d, seconds=i)) for i in range(n)], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    day(0, "idle", 300)
    stream = lambda: streams.sliding(spark.readStream.schema(EVENTS).parquet(folder))
    out, point, held = fresh(spark, "out"), fresh(spark, "p"), []
    for d in range(1, 4):
        query = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(spark.read.format("statestore").option("stateVarName", "minutes").load(point).select("key.route_id").distinct().count() if d == 1 else {r.route_id for r in spark.read.format("statestore").option("stateVarName", "minutes").load(point).select("key.route_id").distinct().collect()})
        day(d, "busy", 3)
    assert held[0] == 1 and held[-1] == {"busy"}


def test_stream_and_batch_agree_on_the_events_table(spark, sf_dir):
    live = more.QUERIES["st_sliding"](spark, sf_dir).select(COLUMNS)
    batch = online.sliding_features(Domain(spark, sf_dir).demand_events).select(COLUMNS)
    assert rows_of(live) == rows_of(batch)
