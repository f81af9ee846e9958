"""Event-time operators tell the same whatever the batches are; expected rows by plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from detectframe.catalog import streams as C
from detectframe.streaming import streams as S

T0 = datetime(2024, 1, 1)


def micros(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def told(spark, df, batches, closing, make):
    return sorted(map(tuple, C._stateful(spark, lambda: S.run_to_table(make(C.as_stream(df, batches, closing)), "test")).collect()))


def test_stop_reasons(spark):
    rnd = random.Random(1)
    rows, want = [], []
    for r in range(25):
        start = T0 + timedelta(seconds=rnd.randrange(50))
        timeout = rnd.choice([60, 120, 200])
        acts = sorted(start + timedelta(seconds=rnd.randrange(rnd.choice([60, 240]))) for _ in range(rnd.randrange(12)))
        exited = start + timedelta(seconds=rnd.randrange(-5, 150)) if rnd.random() < 0.5 else None
        rows += [(f"r{r}", start, "start", float(timeout))] + [(f"r{r}", a, "activity", None) for a in acts] + ([(f"r{r}", exited, "exit", None)] if exited else [])
        stops = [(timeout, 2, "timeout")]
        if exited:
            stops.append((max((exited - start).total_seconds(), 30), 0, "exit"))
        for a, b in zip(acts, [*acts[1:], None]):
            idle = max((a - start).total_seconds() + 30, 45)
            if b is None or (b - start).total_seconds() >= idle:
                stops.append((idle, 1, "idle"))
                break
        at, _, why = min(stops)
        want.append((f"r{r}", why, float(at)))
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, kind string, timeout_s double")
    for batches in (1, 5):
        assert told(spark, df, batches, {"kind": "activity"}, S.stop_reasons_stream) == sorted(want)


@pytest.mark.parametrize("op, n", [("gte", 3), ("lte", 2), ("eq", 2), ("gt", 1), ("lt", 2)])
def test_closed_slots(spark, op, n):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), T0 + timedelta(milliseconds=rnd.randrange(0, 120_000, 500))) for _ in range(90)]
    width, slot, want = 4_000_000, 4_000_000 * S.SLOT, {}
    for k, t in rows:
        us = micros(t)
        c = sum(k2 == k and us - width <= micros(t2) <= us for k2, t2 in rows)
        key = (k, us - us % slot)
        want[key] = max(want.get(key, (0, 0)), (c, -us))
    test = {"gte": lambda c: c >= n, "lte": lambda c: c <= n, "eq": lambda c: c == n, "gt": lambda c: c > n, "lt": lambda c: c < n}[op]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = told(spark, df, 4, {"k": "end"}, lambda s: S.event_count_closed(s, F.lit(True), ["k"], 4, op, n))
    assert got == sorted((k, s, c, -us) for (k, s), (c, us) in want.items() if test(c))


def plain_silence(rows, min_calls, min_events, span):
    out = []
    for p in sorted({r[1] for r in rows}):
        mine = [(micros(t), source, api) for _, q, t, source, api in rows if q == p]
        both = sorted({us for us, source, api in mine if source == "apitrace" and api == "B"})
        for us, nxt in zip(both, [*both[1:], None]):
            if nxt is not None and nxt - us <= span:
                continue
            seen = [m for m in mine if m[0] <= us + span]
            hosts = [m[0] for m in seen if m[1] == "sysmon" and m[0] > us]
            calls = sum(m[1] == "apitrace" and m[2] != "__event_cap_reached__" for m in seen)
            if calls >= min_calls and len(hosts) >= min_events and not any(m[2] == "__event_cap_reached__" for m in seen):
                out.append(("r", p, us, len(hosts), max(hosts)))
    return out


def test_silence(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        source = rnd.choice(["apitrace", "sysmon", "sysmon"])
        rows.append(("r", f"p{rnd.randrange(6)}", T0 + timedelta(milliseconds=rnd.randrange(0, 300_000, 250)), source, rnd.choice("BBA") if source == "apitrace" else None))
    rows.append(("r", "p5", T0 + timedelta(seconds=100), "apitrace", "__event_cap_reached__"))
    df = spark.createDataFrame(rows, "run_id string, ProcessId string, ts timestamp, source string, Api string")
    want = plain_silence(rows, 3, 2, 12_000_000)
    assert want
    for batches in (1, 6):
        assert told(spark, df, batches, {"source": "sysmon", "ProcessId": "end"}, lambda s: S.silence_stream(s, ["B"], 3, 2, 12)) == want


def test_forgotten_process_starts_anew(spark):
    rows = [("r", "p", T0 + timedelta(seconds=s), "apitrace", "B") for s in (0, 1, 2)] + [("r", "p", T0 + timedelta(seconds=s), "sysmon", None) for s in (5, 6, 900, 905, 906)]
    rows += [("r", "p", T0 + timedelta(seconds=901), "apitrace", "B"), ("r", "q", T0 + timedelta(seconds=400), "sysmon", None)]
    df = spark.createDataFrame(rows, "run_id string, ProcessId string, ts timestamp, source string, Api string")
    for keep, n in ((60, 1), (5000, 2)):
        got = told(spark, df, 5, {"source": "sysmon", "ProcessId": "end"}, lambda s: S.silence_stream(s, ["B"], 3, 2, 20, keep_s=keep))
        assert [g[2] for g in got] == [micros(T0 + timedelta(seconds=s)) for s in (2, 901)][:n]
