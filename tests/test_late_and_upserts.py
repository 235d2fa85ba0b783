"""Streams out of order, and keyed results stored by their changes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadenza.plans.jobs import run_late, run_upserts
from cadenza.sources import store
from cadenza.streaming import progress as PR
from cadenza.streaming import upserts as UP
from cadenza.streaming.reorder import PROVIDER, rocksdb_state, session_feed_late, throttle_late

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id bigint, ts timestamp, event_id bigint, event_type string, value double"


def _events(spark, rows):
    return spark.createDataFrame([(u, T0 + dt.timedelta(seconds=s), i, step, v) for i, (u, s, step, v) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def shuffled():
    draw = random.Random(4)
    rows = [(draw.randrange(4), s, draw.choice(["view", "view", "click"]), float(draw.randrange(25))) for s in range(0, 4000, 10)]
    return rows + [(1, 1234, "purchase", 1.0), (2, 55, "purchase", None), (0, 500, "view", 3.0), (0, 500, "view", 9.0)]


def test_throttle_of_shuffled_rows_is_the_batch_result(spark, shuffled):
    ev = _events(spark, shuffled)
    late = run_late(ev, lambda s: throttle_late(s, "10 minutes"), "test", 600, pieces=3)
    assert sorted(r["event_id"] for r in late.collect()) == sorted(r["event_id"] for r in PR.throttle(ev, 5.0).collect())


def test_feed_of_shuffled_rows_is_the_batch_result(spark, shuffled):
    ev = _events(spark, shuffled)
    late = run_late(ev, lambda s: session_feed_late(s, "10 minutes", limit_seconds=1500), "test", 600, pieces=3)
    assert sorted(map(repr, late.collect())) == sorted(map(repr, PR.session_feed(ev, 5.0, 1500).collect()))


def test_rows_beyond_the_delay_are_dropped_and_late_ones_reordered(spark, tmp_path):
    """Deliveries in this order: 0 s and 1000 s; then 950 s (in time) and 10 s (too late)."""
    first = [(1, 0, "A", 0.0), (1, 1000, "A", 6.0)]
    second = [(1, 950, "A", 3.0), (1, 10, "A", 90.0), (1, 5000, "A", 6.0)]
    got = []
    for i, rows in enumerate([first, second, [(9, 90_000, "end", 0.0)]]):
        _events(spark, rows).withColumn("event_id", F.col("event_id") + 10 * i).write.mode("append").parquet(f"{tmp_path}/in")
        stream = throttle_late(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "4 minutes")
        with rocksdb_state(spark):
            stream.writeStream.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).format("parquet").start(
                f"{tmp_path}/out").awaitTermination()
        got.append(sorted(r["event_id"] for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()))
    assert got == [[0], [0, 1], [0, 1]]  # 0 and 6 are emitted; 3 and the last 6 are near; 90 came too late
    assert "RocksDB" not in spark.conf.get(PROVIDER)


def _deliver(spark, folder, make, deliveries, schema=SCHEMA):
    """Run a stream over deliveries, stopped and started again between them; its rows and its queries."""
    queries = []
    for df in deliveries:
        df.write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        with rocksdb_state(spark):
            queries.append(stream.writeStream.option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).format("parquet").start(f"{folder}/out"))
            queries[-1].awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), queries


def test_state_of_late_rows_does_not_grow_by_calls_for_each_key(spark, tmp_path):
    """1,500 keys with a row each in one time bucket: state entries are those of slots."""
    ev = _events(spark, [(u, 1, "A", 0.0) for u in range(1500)])
    end = _events(spark, [(-1, 9000, "end", 0.0)]).withColumn("event_id", F.lit(-1).cast("bigint"))
    rows, queries = _deliver(spark, tmp_path, lambda s: throttle_late(s, "4 minutes"), [ev, end])
    assert sorted(r["event_id"] for r in rows.collect()) == list(range(1500))
    updated = [p["stateOperators"][0]["numRowsUpdated"] for q in queries for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(updated) < 1500


def test_nulls_and_great_ids_among_keys_of_a_slot(spark, tmp_path):
    great = 2**53 + 1
    rows = [(great + u if u else None, s, great + 100 * u + s if s != 20 else None, step, v) for u in range(300)
            for s, step, v in ((10, "A", 0.0), (20, "A", 9.0), (30, "A", None), (40, None, 1.0), (50, None, 2.0), (60, "B", None), (70, "B", 9.0))]
    ev = spark.createDataFrame([(u, T0 + dt.timedelta(seconds=s), i, step, v) for u, s, i, step, v in rows], SCHEMA)
    end = _events(spark, [(-1, 9000, "end", 0.0)])
    got, _ = _deliver(spark, tmp_path, lambda s: throttle_late(s, "4 minutes"), [ev, end])
    shown = sorted(repr((r["user_id"], (r["ts"] - T0).seconds, r["event_id"], r["event_type"], r["value"])) for r in got.collect())
    assert shown == sorted(repr(r) for r in rows if r[1] in (10, 20, 40, 60))


def test_an_ended_session_drops_what_waits_and_begins_anew_after_its_tombstone(spark, tmp_path):
    """Bucket 60 s.  Key 1 ends at 10 s while its row of 1000 s waits; the row of 1100 s
    meets the tombstone, that of 9100 s comes after it."""
    deliveries = [[(1, 0, "A", 0.0), (1, 10, "purchase", 1.0), (1, 1000, "A", 90.0), (2, 0, "A", 0.0), (2, 1000, "A", 90.0)],
                  [(1, 1100, "B", 0.0), (3, 9000, "A", 0.0)], [(1, 9100, "C", 0.0)], [(9, 90_000, "end", 0.0)]]
    frames = [_events(spark, rows).withColumn("event_id", F.col("event_id") + 10 * i) for i, rows in enumerate(deliveries)]
    got, _ = _deliver(spark, tmp_path, lambda s: session_feed_late(s, "4 minutes", limit_seconds=1500, tombstone_seconds=3600), frames)
    assert sorted((r["user_id"], r["status"], r["event_id"] if r["event_id"] is not None else -1) for r in got.collect()) == [
        (1, "completed", 1), (1, "running", 0), (1, "running", 20), (1, "timeout", -1),
        (2, "running", 3), (2, "running", 4), (2, "timeout", -1), (3, "running", 11), (3, "timeout", -1)]


def _latest(spark, folder):
    return PR.latest_per_key_stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in").select("user_id", "event_id", "ts", "event_type", "value"))


def test_only_changed_keys_are_written_and_a_restart_goes_on(spark, tmp_path):
    path = f"{tmp_path}/store"
    _events(spark, [(u, u % 7, "A", float(u)) for u in range(500)]).write.parquet(f"{tmp_path}/in")
    UP.start_upserts(_latest(spark, tmp_path), path).awaitTermination()
    schema = _latest(spark, tmp_path).schema
    base = UP.compact(spark, path, schema, "user_id")
    _events(spark, [(3, 100, "B", 1.0), (4, 101, "B", 2.0), (4, 90, "C", 0.0), (5, -5, "old", 0.0), (900, 0, "new", 0.0)]).withColumn(
        "event_id", F.col("event_id") + 1000).write.mode("append").parquet(f"{tmp_path}/in")
    UP.start_upserts(_latest(spark, tmp_path), path).awaitTermination()  # from the checkpoint
    written = dict(UP.changes(spark, path, schema).groupBy(UP.BATCH).count().collect())
    assert sorted(written.values()) == [4, 500]  # keys 3, 4, 5 (seen again) and 900
    batch = sorted(map(repr, PR.latest_per_key(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").select(
        "user_id", "event_id", "ts", "event_type", "value")).collect()))
    assert sorted(map(repr, UP.read_upserts(spark, path, schema, "user_id").collect())) == batch
    assert sorted(map(repr, UP.read_upserts(spark, path, schema, "user_id", base).collect())) == batch
    again = UP.compact(spark, path, schema, "user_id", base)
    assert sorted(map(repr, spark.read.parquet(again).collect())) == batch


def test_a_stream_without_batches_has_an_empty_result(spark, tmp_path):
    _events(spark, [(1, 0, "A", 0.0)]).limit(0).write.parquet(f"{tmp_path}/in")
    out = run_upserts(_latest(spark, tmp_path), "empty", "user_id")
    assert out.collect() == [] and out.columns == ["user_id", "event_id", "ts", "event_type", "value"]


def test_a_second_try_of_a_run_replaces_the_first(spark, tmp_path):
    path = f"{tmp_path}/runs"
    store.append_run(spark.range(5), path, "a/1")
    store.append_run(spark.range(3), path, "b")
    store.append_run(spark.range(7, 9), path, "a/1")
    assert sorted(r["id"] for r in store.read_run(spark, path, "a/1").collect()) == [7, 8]
    assert store.read_run(spark, path, "b").count() == 3
