"""Runs of any length over many partitions: pointers against the plain rule."""

import numpy as np
import pandas as pd
import pytest

from cadenza.streaming import progress as PR
from cadenza.streaming import runs as RU


def _orbit(vals, x, delta):
    """(rows emitted, value pending at the end) when x is pending before."""
    rows = []
    for i, v in enumerate(vals):
        if abs(v - x) >= delta:
            rows.append(i)
            x = v
    return rows, x


def _shapes(rng, n):
    walk = np.cumsum(rng.normal(0, 1, n))
    ramp = np.linspace(0, 100, n)
    noisy = rng.integers(0, 30, n).astype(float)
    noisy[rng.random(n) < 0.05] = np.nan
    return {"walk": walk, "ramp": ramp, "noisy": noisy, "constant": np.full(n, 3.0), "steps": np.repeat(np.arange(n // 7 + 1), 7)[:n] * 2.5}


@pytest.mark.parametrize("block", [4, 32])
def test_pointers_are_those_of_the_plain_rule(monkeypatch, block):
    monkeypatch.setattr(RU, "BLOCK", block)
    monkeypatch.setattr(RU, "BLOCKS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    for n in (1, 5, 64, 333):
        for vals in _shapes(rng, n).values():
            p = RU.Pointers(vals, 5.0)
            follow, exits = p.following(), p.exits()
            for i in range(n):
                rows, _ = _orbit(vals[i + 1:], vals[i], 5.0)
                assert follow[i] == (i + 1 + rows[0] if rows else n)
                assert exits[i] == (i + 1 + rows[-1] if rows else i)
            x = rng.uniform(-10, 110, 50)
            entry = p.entry(x)
            rows, after = p.step_function()
            for k in range(50):
                hit, end = _orbit(vals, x[k], 5.0)
                assert entry[k] == (hit[0] if hit else n)
                if hit:
                    at = RU._first_record(np.minimum.accumulate(vals[rows]), np.maximum.accumulate(vals[rows]), x[k:k + 1], 5.0)[0]
                    assert after[at] == end


def _frame(spark, vals, parts, key=None, step=None):
    n = len(vals)
    pdf = pd.DataFrame({"user_id": np.ones(n, dtype=np.int64) if key is None else key, "event_id": np.arange(n), "event_type": "A" if step is None else step,
                        "value": vals})
    df = spark.createDataFrame(pdf).selectExpr("user_id", "timestamp_seconds(event_id) as ts", "event_id", "event_type", "nullif(value, double('NaN')) as value")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return df


@pytest.fixture
def many_partitions(spark):
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shape", ["walk", "ramp", "noisy", "constant", "steps"])
def test_one_run_of_all_rows_over_many_partitions(spark, many_partitions, shape):
    vals = _shapes(np.random.default_rng(9), 4000)[shape]
    got = [r["event_id"] for r in PR.throttle(_frame(spark, vals, 16), 5.0).sort("event_id").collect()]
    assert got == [0] + [i + 1 for i in _orbit(vals[1:], vals[0], 5.0)[0]]


def test_long_runs_between_short_ones(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(RU, "ASKED", 3)  # values looked up by several tasks
    rng = np.random.default_rng(1)
    key = np.repeat([1, 1, 2, 3], [1500, 700, 300, 1500])
    step = np.where((np.arange(4000) > 1500) & (np.arange(4000) < 1900), rng.choice(["B", "C"], 4000), "A")
    vals = np.cumsum(rng.normal(0, 2, 4000))
    want = []
    for i in range(4000):
        if not i or key[i] != key[i - 1] or step[i] != step[i - 1] or abs(vals[i] - last) >= 5.0:
            want.append(i)
            last = vals[i]
    got = [r["event_id"] for r in PR.throttle(_frame(spark, vals, 20, key, step), 5.0).sort("event_id").collect()]
    assert got == want


def test_null_keys_steps_and_values(spark):
    rows = [(None, 0, "A", 1.0), (None, 1, "A", 2.0), (None, 2, "A", 9.0), (1, 3, None, 1.0), (1, 4, None, 2.0), (1, 5, "A", None), (1, 6, "A", 50.0), (1, 7, "B", None)]
    df = spark.createDataFrame([(u, i, s, v) for u, i, s, v in rows], "user_id bigint, event_id bigint, event_type string, value double").selectExpr(
        "user_id", "timestamp_seconds(event_id) as ts", "event_id", "event_type", "value")
    assert sorted(r["event_id"] for r in PR.throttle(df, 5.0).collect()) == [0, 2, 3, 5, 7]
    assert PR.throttle(df.limit(0), 5.0).collect() == []
