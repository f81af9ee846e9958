"""Stateful streams over many keys: where their work is done, and that nothing is lost on the way."""

import pickle
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from detectframe.catalog import streams as C
from detectframe.streaming import streams as S

T0 = datetime(2024, 1, 1)


def in_batches(spark, schema, *batches):
    """A stream with one batch per list of rows, in this order, late rows and all."""
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    return C.as_batches(spark, frames, sum(map(len, batches)))


def run(spark, make):
    return sorted(map(tuple, C._stateful(spark, lambda: S.run_to_table(make(), "test")).collect()))


def micros(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_closed_slots_keep_python_out_and_late_rows_in(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [[("a", at(1)), ("a", at(1)), ("b", at(2))], [("c", at(150))], [("a", at(3)), ("b", at(40))], [("end", at(90_000))]]
    made = []

    def closed():
        made.append(S.event_count_closed(in_batches(spark, "k string, ts timestamp", *rows), F.lit(True), ["k"], 20, "gte", 1))
        return made[0]

    # slots of 160 s from T0 on; the third batch is older than the watermark, its slot is not over
    assert run(spark, closed) == [("a", micros(T0), 3, micros(at(3))), ("b", micros(T0), 1, micros(at(2))), ("c", micros(T0), 1, micros(at(150)))]
    assert "TransformWithState" not in made[0]._jdf.queryExecution().logical().toString()


class Store:
    """A state store of one grouping key, its calls counted."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return State(self, name)

    getListState = getMapState = getValueState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self):
        self.store.calls += 1
        return self.store.values

    def exists(self):
        return self.name in self._call()

    def get(self):
        return self._call().get(self.name, [])

    def update(self, value):
        self._call()[self.name] = value

    def appendValue(self, value):
        self._call().setdefault(self.name, []).append(value)

    def clear(self):
        self._call().pop(self.name, None)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def drive(machine, batches):
    """What a machine tells of one share, batch after batch; the watermark is the newest time of the batch before."""
    store, now, out = Store(), 0, []
    machine.init(store)
    for rows in [*batches, []]:
        if rows:
            list(machine.handleInputRows((0,), iter([pd.DataFrame(rows, columns=[*machine.keys, "us", "kind", "v"])]), Now(now)))
        for ms in sorted(t for t in store.timers if t <= now):
            store.timers.discard(ms)
            for pdf in machine.handleExpiredTimer((0,), Now(now), None):
                out += pdf.itertuples(index=False, name=None)
        now = max([now, *(-(-r[-3] // 1000) for r in rows)]) if rows else now
    return store, out


def test_a_share_of_many_processes_takes_few_state_calls():
    names = [(f"r{i % 3}" if i % 7 else None, f"p{i}") for i in range(500)]
    sec = 1_000_000
    first = [(*k, s * sec, kind, 0.0) for k in names for s, kind in ((1, "both"), (2, "call"), (3, "both"), (5, "host"))]
    then = [(*k, 6 * sec, "host", 0.0) for k in names[::2]] + [("r", "end", 50 * sec, "host", 0.0)]
    store, out = drive(S.Silence(3, 2, 10 * sec, 20 * sec), [first, then, [("r", "end", 90 * sec, "host", 0.0)]])
    assert sorted(out, key=str) == sorted([(*k, 3 * sec, 2, 6 * sec) for k in names[::2]], key=str)
    assert store.calls < 60 and len(pickle.loads(store.values["held"][0])) == 1  # the silent ones are forgotten


def test_a_share_of_many_runs_takes_few_state_calls():
    names = [(f"r{i}",) for i in range(500)]
    sec = 1_000_000
    started = [(*k, sec, "start", 60.0) for k in names] + [(*k, 2 * sec, "activity", 0.0) for k in names[::2]]
    then = [(*k, 20 * sec, "exit", 0.0) for k in names[1::2]] + [(*k, 31_500_000, "activity", 0.0) for k in names[::4]] + [("end", 200 * sec, "activity", 0.0)]
    store, out = drive(S.StopReason(30 * sec, 5 * sec, 3 * sec, 100 * sec), [started, then, [("end", 201 * sec, "activity", 0.0)]])
    want = [(k, "exit", 19.0) for k, in names[1::2]] + [(k, "timeout", 60.0) for k, in names[::4]] + [(k, "idle", 31.0) for k, in names[2::4]]
    assert sorted(out) == sorted(want)
    assert store.calls < 60 and len(pickle.loads(store.values["held"][0])) == 1
