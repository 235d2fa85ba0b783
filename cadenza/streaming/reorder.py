"""Streams whose rows come out of order: an event-time buffer before the rule.

Rows are kept in the state until the watermark is past them, then applied in
(ts, tie) order.  As no earlier row can follow, the result is that of the batch
operators on the same rows, however they were dealt over micro-batches, as long
as none is later than the watermark's delay (such rows are dropped).

State and timers belong to slots, which keys are dealt into by their hash: a call
of the state store costs far more than a row, and there are as many calls as
slots and time buckets, however many keys there are.  The state of a slot is a
map from (time bucket, number of the addition) to the packed rows that came
together: an addition writes its own entry and reads none, and when a bucket's
timer expires only the buckets that are over are read, once for all timers that
expired together.  What the rule carries on is a packed table, a row for each key.

``transformWithState`` needs the RocksDB state store; :func:`rocksdb_state`
sets it around the start of a query where the session has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cadenza import constants as K
from cadenza.streaming.progress import FEED_SCHEMA, TOMBSTONE_SECONDS, emissions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS_IN_DELAY = 4
SLOTS = 256  # a stream keeps its number for good, as it keeps its partitions
NO_KEY = -1  # the slot of the null key
NULL_OF = "null_of_"  # before a column's name: whether its value, here 0, is null (rows come as named tuples, whose names begin with a letter)
NONE = -1  # in the place of a deadline
FEED_COLUMNS = ["user_id", "status", "event_id", "event_type", "value"]


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Start streaming queries with the RocksDB state store, then put the session's own back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Buffered(StatefulProcessor):
    """Collects a slot's rows by time bucket and applies those of buckets that are over, in order."""

    def __init__(self, columns: dict[str, str], names: list[str], delta: float, bucket_ms: int):
        self.columns, self.names, self.delta, self.bucket_ms = columns, names, delta, bucket_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "bucket long, part long", "packed binary")
        self.parts = handle.getValueState("parts", "n long")
        self.carry = handle.getValueState("carry", "packed binary")
        self.applied: set = set()  # slots of this task

    def _over(self, ms):
        """When the bucket of a moment is over."""
        return (ms // self.bucket_ms + 1) * self.bucket_ms

    def _carried(self) -> pd.DataFrame:
        """A row for each key of the slot that something is known of."""
        if self.carry.exists():
            return _unpack(self.carry.get()[0]).set_index("key")
        return _fresh([])

    def _carry_on(self, carried: pd.DataFrame) -> None:
        self.carry.update((_pack(carried.rename_axis("key").reset_index()),))

    def _keys(self, slot: int, pdf: pd.DataFrame) -> pd.Series:
        key = pdf[self.columns["key"]]
        return pd.Series(np.zeros(len(pdf), dtype=np.int64), index=pdf.index) if slot == NO_KEY else key

    def _admitted(self, slot: int, pdf: pd.DataFrame, now: int) -> pd.DataFrame:
        """The rows to keep of those that come."""
        return pdf

    def handleInputRows(self, key, rows, timerValues):
        slot, now = int(key[0]), timerValues.getCurrentWatermarkInMs()
        part, buckets = self.parts.get()[0] if self.parts.exists() else 0, set()
        for pdf in rows:
            pdf = self._admitted(slot, pdf[self.names], now)
            if not len(pdf):
                continue
            bucket = _epoch_ms(pdf[self.columns["ts"]]) // self.bucket_ms
            for b in np.unique(bucket).tolist():
                self.rows.updateValue((b, part), (_pack(pdf[bucket == b]),))
                buckets.add(b)
            part += 1
        for b in buckets:
            self.handle.registerTimer((b + 1) * self.bucket_ms)
        self.parts.update((part,))
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        slot, now = int(key[0]), timerValues.getCurrentWatermarkInMs()
        if slot in self.applied:  # by the first of the timers that expired together
            return
        self.applied.add(slot)
        keys = sorted(self.rows.keys())
        ripe = [k for k in keys if (k[0] + 1) * self.bucket_ms <= now]
        held = [_unpack(self.rows.getValue(k)[0]) for k in ripe]
        for k in ripe:
            self.rows.removeKey(k)
        carried, of = self._carried(), np.zeros(0, dtype=np.int64)
        pdf = pd.concat(held, ignore_index=True) if held else None
        if pdf is not None:
            order = [*([NULL_OF + self.columns["tie"]] if NULL_OF + self.columns["tie"] in pdf else []), self.columns["tie"]]
            pdf = pdf.assign(_key=self._keys(slot, pdf)).sort_values(["_key", self.columns["ts"], *order]).reset_index(drop=True)
            code, users = pd.factorize(pdf["_key"])
            new = pd.Index(users)[~pd.Index(users).isin(carried.index)]
            carried = pd.concat([carried, _fresh(new)]) if len(carried) else _fresh(new)
            of = carried.index.get_indexer(users)[code]
        yield from self._apply(slot, pdf, of, carried, now, [k for k in keys if k not in set(ripe)])

    def _emitted(self, pdf: pd.DataFrame, of: np.ndarray, carried: pd.DataFrame) -> np.ndarray:
        """Places of the emitted rows, which are in order by key; ``of`` are
        their keys' places in ``carried``, which learns what was emitted last."""
        if not len(pdf):
            return np.zeros(0, dtype=np.int64)
        steps, vals = pdf[self.columns["step"]].to_numpy(dtype=object), pdf[self.columns["progress"]].to_numpy(dtype=np.float64)
        last_step, last = carried["step"].to_numpy(dtype=object, copy=True), carried["progress"].to_numpy(dtype=np.float64, copy=True)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        first = first[[last_step[u] is not None for u in of[first].tolist()]]
        # what a key emitted last goes before its rows, where the run may go on
        users, put = of[first], np.insert(np.zeros(len(of), dtype=bool), first, True)
        of_all, steps_all, vals_all = np.insert(of, first, users), np.insert(steps, first, last_step[users]), np.insert(vals, first, last[users])
        starts = np.ones(len(of_all), dtype=bool)
        starts[1:] = (of_all[1:] != of_all[:-1]) | (steps_all[1:] != steps_all[:-1]).astype(bool)
        at = np.flatnonzero(emissions(starts, vals_all, 0.0, self.delta)[~put])
        last_step[of[at]], last[of[at]] = steps[at], vals[at]  # of several the last
        carried["step"], carried["progress"] = last_step, last
        return at

    def _apply(self, slot: int, pdf: pd.DataFrame | None, of: np.ndarray, carried: pd.DataFrame, now: int, waiting: list):
        """What the slot gives at ``now``: ``pdf`` are the rows that are over,
        each with its key's place in ``carried``; ``waiting`` the entries that are not."""
        raise NotImplementedError


class _Throttle(_Buffered):
    def _apply(self, slot, pdf, of, carried, now, waiting):
        if pdf is None:
            return
        at = self._emitted(pdf, of, carried)
        self._carry_on(carried)
        if len(at):
            yield _with_nulls(pdf.iloc[at])


class _Feed(_Buffered):
    def __init__(self, columns, names, delta, bucket_ms, limit_seconds: int, terminal: str, tombstone_seconds: int):
        super().__init__(columns, names, delta, bucket_ms)
        self.limit_ms, self.terminal, self.kept_ms = limit_seconds * 1000, terminal, tombstone_seconds * 1000

    def _admitted(self, slot, pdf, now):
        if not len(pdf) or not self.carry.exists():
            return pdf
        carried, keys = self._carried(), self._keys(slot, pdf)
        late = keys.isin(carried.index[carried["done"]]).to_numpy()
        if late.any():  # dropped, and the tombstone lasts on
            carried.loc[carried.index.isin(keys[late]), "deadline"] = now + self.kept_ms
            self._carry_on(carried)
            self.handle.registerTimer(now + self.kept_ms)
        return pdf[~late]

    def _bury(self, slot: int, carried: pd.DataFrame, ended: np.ndarray, now: int, waiting: list) -> None:
        """Remember of keys only that they are done."""
        carried["step"] = carried["step"].where(~ended, None)
        carried["progress"] = carried["progress"].where(~ended, 0.0)
        carried["deadline"] = carried["deadline"].where(~ended, now + self.kept_ms)
        carried["done"] |= ended
        self.handle.registerTimer(now + self.kept_ms)
        for k in waiting:
            pdf = _unpack(self.rows.getValue(k)[0])
            gone = self._keys(slot, pdf).isin(carried.index[ended]).to_numpy()
            if gone.all():
                self.rows.removeKey(k)
            elif gone.any():
                self.rows.updateValue(k, (_pack(pdf[~gone]),))

    def _apply(self, slot, pdf, of, carried, now, waiting):
        over = (carried["done"] & (carried["deadline"] < now)).to_numpy()  # of the tombstone; such keys have no rows
        of, carried = (np.cumsum(~over) - 1)[of], carried[~over].copy()
        deadline, ended, out = carried["deadline"].to_numpy(copy=True), np.zeros(len(carried), dtype=bool), []
        if pdf is not None:
            ms = _epoch_ms(pdf[self.columns["ts"]])
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            new = begin[deadline[of[begin]] == NONE]
            deadline[of[new]] = ms[new] + self.limit_ms
            late = ms >= deadline[of]
            ends = late | (pdf[self.columns["step"]] == self.terminal).to_numpy(dtype=bool)
            end = np.minimum.reduceat(np.where(ends, np.arange(len(pdf)), len(pdf)), begin)
            before = np.flatnonzero(np.arange(len(pdf)) < np.repeat(end, np.diff(np.append(begin, len(pdf)))))
            at = before[self._emitted(pdf.iloc[before], of[before], carried)]
            end = end[end < len(pdf)]
            ended[of[end]] = True
            out = [self._shown(slot, pdf.iloc[at], "running"), self._shown(slot, pdf.iloc[end[~late[end]]], "completed"),
                   self._timeouts(slot, carried.index[of[end[late[end]]]])]
        carried["deadline"] = deadline
        due = ~carried["done"].to_numpy() & ~ended & (deadline != NONE) & (self._over(deadline) <= now)
        out.append(self._timeouts(slot, carried.index[due]))
        for moment in np.unique(self._over(deadline[~carried["done"].to_numpy() & ~ended & ~due & (deadline != NONE)])).tolist():
            self.handle.registerTimer(moment)
        ended |= due
        if ended.any():
            self._bury(slot, carried, ended, now, waiting)
        self._carry_on(carried)
        shown = [x for x in out if len(x)]
        if shown:
            yield pd.concat(shown)

    def _shown(self, slot: int, pdf: pd.DataFrame, status: str) -> pd.DataFrame:
        pdf = _with_nulls(pdf)
        key, tie, step, value = (pdf[self.columns[c]].astype(object) for c in ("key", "tie", "step", "progress"))
        return pd.DataFrame(dict(zip(FEED_COLUMNS, (key, status, tie, step, value))), dtype=object)

    def _timeouts(self, slot: int, keys) -> pd.DataFrame:
        users = [None] * len(keys) if slot == NO_KEY else keys.tolist()
        return pd.DataFrame([(u, "timeout", None, None, None) for u in users], columns=FEED_COLUMNS, dtype=object)


def _fresh(keys) -> pd.DataFrame:
    """What is carried for keys that nothing is known of."""
    n = len(keys)
    return pd.DataFrame({"step": np.full(n, None, dtype=object), "progress": np.zeros(n), "deadline": np.full(n, NONE, dtype=np.int64),
                         "done": np.zeros(n, dtype=bool)}, index=pd.Index(keys))


def _with_nulls(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows as they came, nulls in the place of marked values."""
    marks = {c: pdf[c].to_numpy(dtype=bool) for c in pdf.columns if c.startswith(NULL_OF)}
    pdf = pdf.drop(columns=[*marks, "_key"])
    return pdf.assign(**{c[len(NULL_OF):]: pdf[c[len(NULL_OF):]].astype(object).where(~m, None) for c, m in marks.items() if m.any()})


def _epoch_ms(ts: pd.Series) -> np.ndarray:
    return (ts.astype("datetime64[us]").astype("int64") // 1000).to_numpy()


def _pack(pdf: pd.DataFrame) -> bytes:
    table, sink = pa.RecordBatch.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_all().to_pandas()


def _seconds(delay: str) -> int:
    amount, unit = delay.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _watermarked(events: DataFrame, ts: str, delay: str) -> DataFrame:
    if events.schema[ts].dataType.typeName() == "timestamp_ntz":
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need TIMESTAMP
    return events.withWatermark(ts, delay)


def _slotted(source: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """``source`` by slots of its keys, and the columns to keep.  Integers have
    no nulls but a mark: in pandas a null makes numbers of a whole column doubles."""
    whole = [f.name for f in source.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    slot = F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(SLOTS))).cast("int")
    plain = source.select(*[F.coalesce(c, F.lit(0).cast(source.schema[c].dataType)).alias(c) if c in whole else F.col(c) for c in source.columns],
                          *[F.col(c).isNull().alias(NULL_OF + c) for c in whole], slot.alias("slot_of_keys"))
    return plain.groupBy("slot_of_keys"), plain.columns[:-1]


def _names(key: str, ts: str, tie: str, step: str, progress: str) -> dict[str, str]:
    return {"key": key, "ts": ts, "tie": tie, "step": step, "progress": progress}


def throttle_late(events: DataFrame, delay: str, delta: float = K.THROTTLE_DELTA, key: str = "user_id", ts: str = "ts",
                  tie: str = "event_id", step: str = "event_type", progress: str = "value") -> DataFrame:
    """:func:`~cadenza.streaming.progress.throttle` on a stream whose rows are
    at most ``delay`` ("10 minutes") behind the latest.  A row is emitted, if
    it is, when the watermark is past the end of its time bucket, a quarter of
    the delay long.  The state of a slot is its keys' rows within the delay and
    what each emitted last."""
    source = _watermarked(events, ts, delay)
    slots, names = _slotted(source, key)
    processor = _Throttle(_names(key, ts, tie, step, progress), names, delta, max(1, _seconds(delay) * 1000 // BUCKETS_IN_DELAY))
    return slots.transformWithStateInPandas(processor, source.schema, "Append", "EventTime")


def session_feed_late(events: DataFrame, delay: str, delta: float = K.THROTTLE_DELTA, limit_seconds: int = K.STREAM_TIMEOUT_SECONDS,
                      key: str = "user_id", ts: str = "ts", tie: str = "event_id", step: str = "event_type", progress: str = "value",
                      terminal: str = K.TERMINAL_STEP, tombstone_seconds: int = TOMBSTONE_SECONDS) -> DataFrame:
    """:func:`~cadenza.streaming.progress.session_feed` on a stream whose rows
    are at most ``delay`` behind the latest.  ``timeout`` comes when the
    watermark is past the deadline's time bucket; an ended session drops its
    later rows until ``tombstone_seconds`` without one."""
    slots, names = _slotted(_watermarked(events, ts, delay), key)
    processor = _Feed(_names(key, ts, tie, step, progress), names, delta, max(1, _seconds(delay) * 1000 // BUCKETS_IN_DELAY), limit_seconds, terminal,
                      tombstone_seconds)
    return slots.transformWithStateInPandas(processor, FEED_SCHEMA, "Append", "EventTime")
