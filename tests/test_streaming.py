import datetime as dt
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from cadenza.streaming import progress as PR

T0 = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(
        [(u, T0 + dt.timedelta(seconds=s), i, step, float(v)) for i, (u, s, step, v) in enumerate(rows)],
        "user_id bigint, ts timestamp, event_id bigint, event_type string, value double",
    )


def test_throttle_compares_with_last_emitted(spark):
    # W1: A: 0,3,6,9,11 then B: 11 -> emit 0, 6, 11 and B 11 (lag would give 0 and B only)
    rows = [(1, i, "A", v) for i, v in enumerate([0, 3, 6, 9, 11])] + [(1, 5, "B", 11)]
    out = PR.throttle(_events(spark, rows), 5.0).orderBy("ts").collect()
    assert [(r["event_type"], r["value"]) for r in out] == [("A", 0), ("A", 6), ("A", 11), ("B", 11)]


def _reference(pdf, delta):
    keep = []
    for _, g in pdf.sort_values(["user_id", "ts", "event_id"]).groupby("user_id"):
        ls, lp = None, None
        for r in g.itertuples():
            if ls is None or r.event_type != ls or abs(r.value - lp) >= delta:
                keep.append(r.event_id)
                ls, lp = r.event_type, r.value
    return sorted(keep)


def test_throttle_batch_equals_reference_and_stream(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "user_id", "ts", "event_id", "event_type", "value")
    exp = _reference(ev.toPandas(), 5.0)
    got = sorted(r["event_id"] for r in PR.throttle(ev, 5.0).collect())
    assert got == exp
    d = tempfile.mkdtemp(prefix="cadenza-stream-")
    stream = spark.readStream.schema(ev.schema).parquet("/root/testdata/sf0.001/events*.parquet").select(*ev.columns)
    q = (PR.throttle_stream(stream, 5.0).writeStream.format("memory").queryName("thr_test")
         .option("checkpointLocation", os.path.join(d, "ck")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("thr_test").collect()) == exp


def test_session_timeout_boundary(spark):
    # W3: terminal at +299 s -> completed, +300 s -> timeout, never -> timeout
    rows = [(1, 0, "view", 1), (1, 299, "purchase", 1),
            (2, 0, "view", 1), (2, 300, "purchase", 1),
            (3, 0, "view", 1), (3, 10, "click", 1)]
    got = {r["user_id"]: r["status"] for r in PR.session_timeout(_events(spark, rows)).collect()}
    assert got == {1: "completed", 2: "timeout", 3: "timeout"}


def test_session_status(spark):
    rows = [(1, 0, "view", 10), (1, 5, "purchase", 100), (2, 0, "view", 10), (2, 9, "click", 20)]
    req = spark.createDataFrame([(1,), (2,), (3,)], "session_id bigint")
    got = {r["session_id"]: (r["status"], r["step"], r["progress"])
           for r in PR.session_status(req, _events(spark, rows)).collect()}
    assert got == {1: ("completed", None, None), 2: ("running", "click", 20.0), 3: ("not_found", None, None)}


def test_session_feed_stream_equals_batch(spark):
    import __spark_entry__ as E

    qs = E.queries()
    d = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in qs["session_feed_stream"](spark, d).collect())
    b = sorted(tuple(r) for r in qs["session_feed_day"](spark, d).collect())
    assert a == b and len(a) > 0


def test_session_feed_terminal_ends_output(spark):
    # W4: nothing after the first terminal record; W3: deadline cuts the feed
    rows = [(1, 0, "view", 0), (1, 10, "view", 50), (1, 20, "purchase", 60), (1, 30, "view", 70),
            (2, 0, "view", 0), (2, 400, "purchase", 1)]
    got = sorted((r["user_id"], r["status"], r["value"]) for r in PR.session_feed(_events(spark, rows), 5.0, 300).collect())
    assert got == [(1, "completed", 60.0), (1, "running", 0.0), (1, "running", 50.0),
                   (2, "running", 0.0), (2, "timeout", None)]


def test_throttle_on_hot_key(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):  # user 1 holds most rows; long runs cross partition bounds
        u = 1 if i % 10 else 2 + (i % 7)
        step = "A" if (i // 400) % 2 == 0 else "B"
        if rng.random() < 0.05:
            step = "C"
        rows.append((u, i, step, float(rng.integers(0, 40))))
    ev = _events(spark, rows).repartition(5)
    exp = _reference(ev.toPandas(), 5.0)
    assert sorted(r["event_id"] for r in PR.throttle(ev, 5.0).collect()) == exp


def test_run_ids_cross_partitions(spark):
    rows = [(1, i, "A" if i < 50 or i >= 90 else "B", 0.0) for i in range(120)]
    ev = _events(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["event_id"]: r["_run"] for r in PR.run_ids(ev).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(got[i] == 0 for i in range(50))
    assert all(got[i] == 50 for i in range(50, 90))
    assert all(got[i] == 90 for i in range(90, 120))


def test_emissions_equal_the_plain_rule():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        vals = rng.integers(0, 30, n).astype(float)
        vals[rng.random(n) < 0.05] = np.nan
        starts = rng.random(n) < 0.02
        last, want, at = 3.0, [], 3.0
        for i in range(n):
            hit = bool(starts[i]) or abs(vals[i] - at) >= 5.0
            want.append(hit)
            at = vals[i] if hit else at
        assert PR.emissions(starts, vals, last, 5.0).tolist() == want


def _micro_batches(spark, batches, make):
    """Run a stream over one file for each batch, in order."""
    from cadenza.plans.jobs import run_stream

    d = tempfile.mkdtemp(prefix="cadenza-batches-")
    for i, rows in enumerate(batches):
        df = _events(spark, rows).withColumn("event_id", F.col("event_id") + 100000 * i)
        path = os.path.join(d, f"b{i}")
        df.coalesce(1).write.parquet(path)
        part = [f for f in os.listdir(path) if f.endswith(".parquet")][0]
        os.rename(os.path.join(path, part), os.path.join(d, f"{i}.parquet"))
        os.utime(os.path.join(d, f"{i}.parquet"), (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "*.parquet"))
    return run_stream(make(stream), "test")


def test_feed_stream_with_a_deadline_behind_the_watermark(spark):
    rows = _micro_batches(spark, [[(2, 0, "view", 1)], [(3, 5000, "view", 1)], [(2, 5001, "view", 9)], [(4, 9999, "view", 1)]],
                          lambda s: PR.session_feed_stream(s, 5.0, 300)).collect()
    got = sorted((r["user_id"], r["status"]) for r in rows)
    assert got[:4] == [(2, "running"), (2, "timeout"), (3, "running"), (3, "timeout")]


def test_feed_stream_does_not_revive_a_finished_session(spark):
    rows = _micro_batches(spark, [[(2, 0, "view", 1), (2, 10, "purchase", 2)], [(3, 5000, "view", 1)], [(2, 5001, "view", 9)]],
                          lambda s: PR.session_feed_stream(s, 5.0, 300)).collect()
    assert sorted((r["status"], r["value"]) for r in rows if r["user_id"] == 2) == [("completed", 2.0), ("running", 1.0)]


def test_throttle_stream_orders_a_large_group(spark):
    import random

    rows = [(1, i, "A", (i * 7) % 100) for i in range(25000)]
    random.Random(3).shuffle(rows)
    ev = _events(spark, rows)
    got = sorted(r["ts"] for r in _micro_batches(spark, [rows], lambda s: PR.throttle_stream(s, 5.0)).collect())
    assert got == sorted(r["ts"] for r in PR.throttle(ev, 5.0).collect())
