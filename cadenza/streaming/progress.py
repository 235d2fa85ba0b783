"""Keyed progress-event operators (batch and Structured Streaming).

Events are ``(key, ts, event_id, step, progress, ...)``.  Bindings for the
test tables: key = ``user_id``, step = ``event_type``, progress = ``value``,
terminal (result) record = ``event_type = 'purchase'``.

Throttle rule: a record is emitted iff its step differs from the last
*emitted* record's step, or ``|progress - last emitted progress| >= delta``;
the first record of a key is always emitted.  Comparing with the previous
*row* (``lag``) is a different, wrong rule.

Batch plan: a run of consecutive same-step records always starts with an
emission (its step differs from whatever was emitted last), so runs are
independent.  Rows are range-partitioned and sorted on (key, ts, tie), with no
per-key task, and stay there.  One pass gives a boundary summary of each
partition, which the driver chains; the last one scans every partition with
``mapInPandas``, knowing the value that is pending where it begins inside a
run.  For runs that fill whole partitions those values come from
:mod:`cadenza.streaming.runs`, so even one run of all rows is no long task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import constants as K


TOMBSTONE_SECONDS = 7 * 86400


def emissions(starts: np.ndarray, vals: np.ndarray, last: float, delta: float) -> np.ndarray:
    """Flags of the emitted rows.  ``starts`` marks the first row of each run,
    which is always emitted; before the first mark a run goes on whose last
    emitted value is ``last``.  Inside a run the rule jumps from one emission
    to the next; runs that never leave the band around their first value are
    settled for all at once."""
    keep, n = starts.copy(), len(vals)
    if not n:
        return keep
    begin = np.flatnonzero(starts)
    if not starts[0]:
        begin = np.concatenate(([0], begin))
    end = np.append(begin[1:], n)
    base = np.where(starts[begin], vals[begin], last)
    far = np.fmax(np.fmax.reduceat(vals, begin) - base, base - np.fmin.reduceat(vals, begin)) >= delta
    for a, b, at in zip(begin[far].tolist(), end[far].tolist(), base[far].tolist()):
        width = 64
        while a < b:
            hit = np.abs(vals[a:min(a + width, b)] - at) >= delta
            if hit.any():
                a += int(hit.argmax())
                keep[a], at, width = True, vals[a], 64
                a += 1
            else:
                a, width = a + len(hit), 2 * width
    return keep


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    return (x[1:] != x[:-1]) & ~(pd.isna(x[1:]) & pd.isna(x[:-1]))


def _run_starts(keys, steps, carry_key, carry_step, has_carry):
    """Boolean run-start flags of rows in (key, ts, tie) order."""
    n = len(keys)
    starts = np.ones(n, dtype=bool)
    if n > 1:
        starts[1:] = _changes(keys) | _changes(steps)
    if n and has_carry:
        starts[0] = not (_same(keys[0], carry_key) and _same(steps[0], carry_step))
    return starts


def _same(a, b) -> bool:
    return bool(a == b) or bool(pd.isna(a) and pd.isna(b))


def in_order(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Rows range-partitioned and sorted, checkpointed to the shared folder, so
    that several passes see the same partitions.  A hot key has many."""
    from cadenza.session import checkpoint_dir

    checkpoint_dir(events.sparkSession)
    return events.repartitionByRange(key, ts, tie).sortWithinPartitions(key, ts, tie).checkpoint(eager=True)


def run_ids(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id",
            step: str = "event_type") -> DataFrame:
    """``events`` plus ``_run``: the ``tie`` value of the first row of each
    row's run (maximal sequence of consecutive same-step rows of a key in
    (ts, tie) order).

    No per-key window: rows are range-partitioned and sorted on (key, ts,
    tie) -- a hot key is split over many partitions -- and checkpointed to
    the shared folder so both passes below read identical partitions.  Pass
    1 emits one boundary summary per partition; the driver chains the P
    summaries in order (bounded by the partition count) into the run in
    progress at each partition start; pass 2 labels rows with vectorised
    NumPy."""
    from pyspark import TaskContext

    spark = events.sparkSession
    parts = in_order(events, key, ts, tie)
    key_type = parts.schema[key].dataType.simpleString()
    tie_type = parts.schema[tie].dataType.simpleString()

    def summarise(batches):
        pid = TaskContext.get().partitionId()
        first = last = None
        n = 0
        last_start = None
        prev = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            keys, steps, ids = pdf[key].to_numpy(), pdf[step].to_numpy(), pdf[tie].to_numpy()
            st = _run_starts(keys, steps, prev[0] if prev else None, prev[1] if prev else None, prev is not None)
            if first is None:
                first = (keys[0], steps[0], ids[0])
                st[0] = False  # the first row's status depends on the carry
            idx = np.nonzero(st)[0]
            if len(idx):
                last_start = ids[idx[-1]]
            prev = (keys[-1], steps[-1])
            last = (keys[-1], steps[-1])
            n += len(pdf)
        if n:
            yield pd.DataFrame({
                "pid": [pid], "first_key": [first[0]], "first_step": [first[1]], "first_id": [first[2]],
                "last_key": [last[0]], "last_step": [last[1]], "last_start": [last_start],
            })

    summary_schema = (f"pid int, first_key {key_type}, first_step string, first_id {tie_type}, "
                      f"last_key {key_type}, last_step string, last_start {tie_type}")
    rows = sorted(parts.select(key, step, tie).mapInPandas(summarise, summary_schema).collect(),
                  key=lambda r: r["pid"])  # one row per partition
    carry, state = {}, None
    for r in rows:  # range partitions are in key order
        carry[r["pid"]] = state
        starts0 = state is None or r["first_key"] != state[0] or r["first_step"] != state[1]
        first_run = r["first_id"] if starts0 else state[2]
        end_run = r["last_start"] if r["last_start"] is not None else first_run
        state = (r["last_key"], r["last_step"], end_run)
    bc = spark.sparkContext.broadcast(carry)
    base = parts.schema
    out_schema = T.StructType(list(base.fields) + [T.StructField("_run", base[tie].dataType)])

    def label(batches):
        c = bc.value.get(TaskContext.get().partitionId())
        for pdf in batches:
            if len(pdf) == 0:
                continue
            keys, steps, ids = pdf[key].to_numpy(), pdf[step].to_numpy(), pdf[tie].to_numpy()
            st = _run_starts(keys, steps, c[0] if c else None, c[1] if c else None, c is not None)
            pos = np.maximum.accumulate(np.where(st, np.arange(len(pdf)), -1))
            run = np.where(pos >= 0, ids[np.maximum(pos, 0)], c[2] if c else ids[0])
            c = (keys[-1], steps[-1], run[-1])
            yield pdf.assign(_run=run)

    return parts.mapInPandas(label, out_schema)


def _boundaries(parts: DataFrame, key: str, step: str, progress: str, delta: float) -> list:
    """A row for each partition that has rows, in order: its first and last key
    and step, whether one run fills it, its least and largest value, and the
    value pending at its end if its last run begins in it."""
    from pyspark import TaskContext

    def summarise(pdfs):
        first = last = None
        whole, low, high, pending = True, np.nan, np.nan, 0.0
        for pdf in pdfs:
            if len(pdf) == 0:
                continue
            keys, steps, vals = pdf[key].to_numpy(), pdf[step].to_numpy(), pdf[progress].to_numpy(dtype=np.float64)
            starts = _run_starts(keys, steps, *(last or (None, None)), last is not None)
            first = first or (keys[0], steps[0])
            whole = whole and not starts[1 if last is None else 0:].any()
            keep = emissions(starts, vals, pending, delta)
            if keep.any():
                pending = vals[np.flatnonzero(keep)[-1]]
            low, high = np.fmin(low, np.fmin.reduce(vals)), np.fmax(high, np.fmax.reduce(vals))
            last = (keys[-1], steps[-1])
        if first is not None:
            yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "first_key": [first[0]], "first_step": [first[1]], "last_key": [last[0]],
                                "last_step": [last[1]], "whole": [whole], "low": [low], "high": [high], "pending": [pending]})

    kinds = {c: parts.schema[c].dataType.simpleString() for c in (key, step)}
    schema = (f"pid int, first_key {kinds[key]}, first_step {kinds[step]}, last_key {kinds[key]}, last_step {kinds[step]}, "
              "whole boolean, low double, high double, pending double")
    return sorted(parts.select(key, step, progress).mapInPandas(summarise, schema).collect(), key=lambda r: r["pid"])  # one row per partition


def throttle(events: DataFrame, delta: float = K.THROTTLE_DELTA, key: str = "user_id",
             ts: str = "ts", tie: str = "event_id", step: str = "event_type",
             progress: str = "value") -> DataFrame:
    """Emitted records (all input columns), per key in (ts, tie) order.

    A null key is a key of its own, and so is a null step a step; a null value
    is emitted only where a run begins, and nothing after it in that run."""
    from pyspark import TaskContext

    from cadenza.streaming.runs import pending_values

    parts = in_order(events, key, ts, tie)
    bounds = _boundaries(parts, key, step, progress, delta)
    goes_on = [False] + [_same(b["first_key"], a["last_key"]) and _same(b["first_step"], a["last_step"]) for a, b in zip(bounds, bounds[1:])]
    inner, starts, ranges, run = {}, {}, {}, 0
    for i, r in enumerate(bounds):
        if not goes_on[i] or not r["whole"]:
            run, begin = run + 1, (r["pid"], _number(r["pending"]))
        elif i + 1 < len(bounds) and goes_on[i + 1]:
            inner[r["pid"]], starts[run], ranges[r["pid"]] = run, begin, (_number(r["low"]), _number(r["high"]))
    after = pending_values(parts, progress, inner, starts, ranges, delta) if inner else {}
    before, pending = {}, None
    for i, r in enumerate(bounds):
        before[r["pid"]] = (r["first_key"], r["first_step"], pending) if goes_on[i] else None
        pending = after.get(r["pid"], pending) if r["pid"] in inner else _number(r["pending"])

    def scan(pdfs):
        carry = before.get(TaskContext.get().partitionId())
        for pdf in pdfs:
            if len(pdf) == 0:
                continue
            keys, steps, vals = pdf[key].to_numpy(), pdf[step].to_numpy(), pdf[progress].to_numpy(dtype=np.float64)
            last = carry[2] if carry else 0.0
            keep = emissions(_run_starts(keys, steps, *(carry[:2] if carry else (None, None)), carry is not None), vals, last, delta)
            carry = (keys[-1], steps[-1], vals[np.flatnonzero(keep)[-1]] if keep.any() else last)
            yield pdf.loc[keep]

    return parts.mapInPandas(scan, events.schema)


def _number(x) -> float:
    return float("nan") if x is None else float(x)


def _gathered(pdfs, order: list[str]) -> pd.DataFrame:
    """All rows of a key in a micro-batch, sorted: Arrow hands a large group
    over in several chunks, which are not in order."""
    return pd.concat(list(pdfs)).sort_values(order, kind="mergesort")


def _step_starts(steps: np.ndarray, last_step: str | None) -> np.ndarray:
    starts = np.ones(len(steps), dtype=bool)
    starts[1:] = steps[1:] != steps[:-1]
    if len(steps):
        starts[0] = last_step is None or steps[0] != last_step
    return starts


def throttle_stream(events: DataFrame, delta: float = K.THROTTLE_DELTA, key: str = "user_id",
                    ts: str = "ts", tie: str = "event_id", step: str = "event_type",
                    progress: str = "value", idle_seconds: int | None = None) -> DataFrame:
    """The same rule on a streaming DataFrame with ``applyInPandasWithState``:
    state per key = (last emitted step, last emitted progress).  The rows of a
    key in a micro-batch are applied in (ts, tie) order; a late row of an older
    micro-batch is applied on arrival.

    State is kept for every key; with ``idle_seconds`` that of a key without
    records for so long (processing time) is freed, and its next record counts
    as its first."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    cols = events.columns
    state_schema = T.StructType([
        T.StructField("last_step", T.StringType()),
        T.StructField("last_progress", T.DoubleType()),
    ])

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last_step, last = state.get if state.exists else (None, 0.0)
        pdf = _gathered(pdfs, [ts, tie])
        steps, vals = pdf[step].to_numpy(), pdf[progress].to_numpy(dtype=np.float64)
        keep = emissions(_step_starts(steps, last_step), vals, last, delta)
        if keep.any():
            at = np.flatnonzero(keep)[-1]
            last_step, last = steps[at], float(vals[at])
        state.update((last_step, last))
        if idle_seconds is not None:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pdf.loc[keep, cols]

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy(key).applyInPandasWithState(fn, events.schema, state_schema, "append", timeout)


def latest_per_key(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest record per key (overwrite semantics): ``max_by`` over
    (ts, tie), a partial aggregation."""
    others = [c for c in events.columns if c != key]
    rec = F.max_by(F.struct(*others), F.struct(F.col(ts), F.col(tie)))
    return events.groupBy(key).agg(rec.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])


def session_status(requested: DataFrame, events: DataFrame, req_key: str = "session_id",
                   key: str = "user_id", step: str = "event_type", progress: str = "value",
                   terminal: str = K.TERMINAL_STEP) -> DataFrame:
    """Status of requested sessions: a terminal (result) record exists ->
    ``completed``; else any progress record -> ``running`` with the latest
    step/progress; else ``not_found``."""
    latest = latest_per_key(events.select(key, "ts", "event_id", step, progress), key)
    done = events.filter(F.col(step) == terminal).groupBy(key).agg(F.min("ts").alias("result_ts"))
    j = (
        requested.select(F.col(req_key).alias(key))
        .join(done, key, "left")
        .join(latest, key, "left")
    )
    status = (
        F.when(F.col("result_ts").isNotNull(), F.lit("completed"))
        .when(F.col("event_id").isNotNull(), F.lit("running"))
        .otherwise(F.lit("not_found"))
    )
    running = status == "running"
    return j.select(
        F.col(key).alias(req_key),
        status.alias("status"),
        F.when(running, F.col(step)).alias("step"),
        F.when(running, F.col(progress)).alias("progress"),
    )


def session_timeout(events: DataFrame, limit_seconds: int = K.STREAM_TIMEOUT_SECONDS,
                    key: str = "user_id", step: str = "event_type",
                    terminal: str = K.TERMINAL_STEP) -> DataFrame:
    """Per key: ``completed`` when the first terminal record arrives less than
    ``limit_seconds`` after the key's first record, else ``timeout`` (also
    when no terminal record exists)."""
    t = events.groupBy(key).agg(
        F.min("ts").alias("first_ts"),
        F.min(F.when(F.col(step) == terminal, F.col("ts"))).alias("terminal_ts"),
    )
    secs = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("terminal_ts"))
    return t.select(
        key,
        "first_ts",
        "terminal_ts",
        F.when(F.col("terminal_ts").isNotNull() & (secs < F.lit(limit_seconds * 1_000_000)), F.lit("completed"))
        .otherwise(F.lit("timeout"))
        .alias("status"),
    )


def stage_timings(log: DataFrame, run: str = "user_id", stage: str = "event_type",
                  seconds: str = "value") -> DataFrame:
    """Run log ``(run, stage, seconds)`` -> per (run, stage) seconds and the
    run total, long form."""
    per = log.groupBy(run, stage).agg(F.sum(seconds).alias("seconds"))
    tot = log.groupBy(run).agg(F.sum(seconds).alias("total_seconds"))
    return per.join(tot, run).select(
        run, F.col(stage).alias("stage"), F.round("seconds", 6).alias("seconds"),
        F.round("total_seconds", 6).alias("total_seconds"),
    )


# ------------------------------------------------------------- session feed

FEED_SCHEMA = "user_id bigint, status string, event_id bigint, event_type string, value double"


def session_feed(events: DataFrame, delta: float = K.THROTTLE_DELTA,
                 limit_seconds: int = K.STREAM_TIMEOUT_SECONDS, key: str = "user_id",
                 ts: str = "ts", tie: str = "event_id", step: str = "event_type",
                 progress: str = "value", terminal: str = K.TERMINAL_STEP) -> DataFrame:
    """What a client following one session sees: throttled ``running``
    records, then either ``completed`` at the first terminal record (nothing
    after it) or ``timeout`` when no terminal record arrives within
    ``limit_seconds`` of the session's first record (records after the
    deadline are never seen).  Output ``(key, status, event_id, event_type,
    value)``; a ``timeout`` row carries nulls."""
    # the first terminal record ends the session iff it is before the deadline,
    # so one aggregation tells both
    order = F.struct(F.col(ts), F.col(tie))
    bounds = events.groupBy(key).agg(
        F.min(ts).alias("_first"), F.min(F.when(F.col(step) == terminal, order)).alias("_t"))
    deadline = F.col("_first") + F.make_dt_interval(secs=F.lit(limit_seconds))
    bounds = bounds.select(key, deadline.alias("_deadline"), F.when(F.col("_t")[ts] < deadline, F.col("_t")).alias("_t"))
    tagged = events.join(bounds, key).filter(F.col(ts) < F.col("_deadline"))
    before = tagged.filter(F.col("_t").isNull() | (order < F.col("_t")))
    running = throttle(before.select(*events.columns), delta, key, ts, tie, step, progress)
    cols = lambda status, df: df.select(
        F.col(key).cast("bigint").alias("user_id"), F.lit(status).alias("status"),
        F.col(tie).cast("bigint").alias("event_id"), F.col(step).alias("event_type"),
        F.col(progress).cast("double").alias("value"),
    )
    done = tagged.filter(order == F.col("_t"))
    timed_out = bounds.filter(F.col("_t").isNull()).select(
        F.col(key).cast("bigint").alias("user_id"), F.lit("timeout").alias("status"),
        F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("double").alias("value"),
    )
    return cols("running", running).unionByName(cols("completed", done)).unionByName(timed_out)


def session_feed_stream(events: DataFrame, delta: float = K.THROTTLE_DELTA,
                        limit_seconds: int = K.STREAM_TIMEOUT_SECONDS, watermark: str = "10 minutes",
                        key: str = "user_id", ts: str = "ts", tie: str = "event_id",
                        step: str = "event_type", progress: str = "value",
                        terminal: str = K.TERMINAL_STEP,
                        tombstone_seconds: int = TOMBSTONE_SECONDS) -> DataFrame:
    """:func:`session_feed` on a stream: ``applyInPandasWithState`` keyed by
    session with an event-time timeout at first record + ``limit_seconds``.
    State = (deadline, last emitted step, last emitted progress, done).  A
    session that completed or timed out keeps a tombstone, which drops its
    later records, until the watermark is ``tombstone_seconds`` beyond its
    end; a record after that starts the session anew."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    state_schema = T.StructType([
        T.StructField("deadline_ms", T.LongType()),
        T.StructField("last_step", T.StringType()),
        T.StructField("last_progress", T.DoubleType()),
        T.StructField("done", T.BooleanType()),
    ])
    limit_ms, kept_ms = limit_seconds * 1000, tombstone_seconds * 1000
    columns = ["user_id", "status", "event_id", "event_type", "value"]

    def remember(state, deadline, last_step, last, done):
        # a timeout must lie beyond the watermark, also for sessions behind it
        now = state.getCurrentWatermarkMs()
        state.update((deadline, last_step, last, done))
        state.setTimeoutTimestamp(max(deadline, now) + kept_ms if done else max(deadline, now + 1))

    def fn(keys, pdfs, state):
        k = int(keys[0])
        deadline, last_step, last, done = state.get if state.exists else (None, None, 0.0, False)
        if state.hasTimedOut:
            if done:
                state.remove()
            else:
                remember(state, deadline, last_step, last, True)
                yield pd.DataFrame([(k, "timeout", None, None, None)], columns=columns)
            return
        if done:
            for _ in pdfs:
                pass
            remember(state, deadline, last_step, last, True)
            return
        pdf = _gathered(pdfs, [ts, tie])
        t_ms = (pdf[ts].astype("datetime64[us]").astype("int64") // 1000).to_numpy()
        steps, vals, ids = pdf[step].to_numpy(), pdf[progress].to_numpy(dtype=np.float64), pdf[tie].to_numpy()
        if deadline is None:
            deadline = int(t_ms[0]) + limit_ms
        ends = np.flatnonzero((steps == terminal) | (t_ms >= deadline))
        end = int(ends[0]) if len(ends) else len(pdf)
        keep = np.flatnonzero(emissions(_step_starts(steps[:end], last_step), vals[:end], last, delta))
        out = [(k, "running", int(ids[i]), steps[i], float(vals[i])) for i in keep]
        if len(keep):
            last_step, last = steps[keep[-1]], float(vals[keep[-1]])
        if end < len(pdf):
            done = True
            out.append((k, "timeout", None, None, None) if t_ms[end] >= deadline else
                       (k, "completed", int(ids[end]), steps[end], float(vals[end])))
        remember(state, int(deadline), last_step, last, done)
        if out:
            yield pd.DataFrame(out, columns=columns)

    if events.schema[ts].dataType.typeName() == "timestamp_ntz":
        # watermarks need TIMESTAMP; wall-clock NTZ values map 1:1 under a
        # fixed-offset session zone (UTC here)
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        events.withWatermark(ts, watermark)
        .groupBy(key)
        .applyInPandasWithState(fn, FEED_SCHEMA, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    )


def latest_per_key_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest record per key on a stream, a ``max_by`` aggregation;
    :mod:`cadenza.streaming.upserts` stores it by the keys that change."""
    return latest_per_key(events, key, ts, tie)


def feed_payloads(feed: DataFrame) -> DataFrame:
    """Render feed records as the stream's text payloads
    ``data: {json}`` (null fields omitted)."""
    body = F.to_json(F.struct("status", "event_id", "event_type", "value"))
    return feed.select("user_id", "status", F.concat(F.lit("data: "), body).alias("payload"))
