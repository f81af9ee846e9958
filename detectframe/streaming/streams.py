"""Streams with Structured Streaming; file sources, no sockets."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from detectframe import fixed
from detectframe.functions.scalar import micros
from detectframe.operators.rules import _OPS as COMPARE
from detectframe.operators.rules import RuleSet, apply_rules
from detectframe.operators.windows import SLOT
from detectframe.scale import scratch_path
from detectframe.schema import fld

#: Provider the stateful operators here need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Shares the keys of an ordered stream are dealt to.
SHARES = 1024


def tail(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """M1: JSON lines of every new complete file; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def cursor_read(events: DataFrame, offset: int, limit: int, q: str | None = None) -> DataFrame:
    """M2: up to ``limit`` rows after a cursor; ``q`` filters on the row's text.

    ``next_offset`` is the position after the last row looked at; rows the
    filter skips move the cursor too.
    """
    from detectframe.operators.browse import page
    from detectframe.functions.scalar import row_contains

    rest = events.filter(F.col("seq") >= offset)
    return page(rest.filter(row_contains(q)) if q else rest, 0, limit, ["seq"])


def cursor_next(events: DataFrame, offset: int, limit: int, q: str | None = None) -> DataFrame:
    """M2: the cursor after :func:`cursor_read`: past the page if it is full, else past the end."""
    got = cursor_read(events, offset, limit, q).agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    end = events.agg(F.max("seq").alias("end"))
    one = got.unionByName(end, allowMissingColumns=True).agg(F.max("n").alias("n"), F.max("last").alias("last"), F.max("end").alias("end"))
    full = F.col("n") >= limit
    return one.select(
        F.greatest(F.lit(offset), F.when(full, F.col("last") + 1).otherwise(F.col("end") + 1)).alias("next_offset"), F.col("n").alias("returned"))


def sse_events(lines: DataFrame, schema: str) -> DataFrame:
    """M3: ``data:`` lines to events; other lines and bad payloads are dropped.

    ``lines(value)`` may be a stream of captured text files or a batch table.
    """
    payload = F.trim(F.substring("value", 6, 2**30))
    x = lines.filter(F.col("value").startswith("data:") & (payload != ""))
    parsed = F.from_json(payload, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return x.select(parsed.alias("e")).filter(F.col("e").isNotNull() & F.col("e._bad").isNull()).select("e.*").drop("_bad")


def activity_sessions(events: DataFrame, grace: str = "30 seconds", watermark: str = "1 minute") -> DataFrame:
    """M4: stretches of activity per run separated by at least ``grace`` of silence."""
    src = events.withWatermark("ts", watermark) if events.isStreaming else events
    return src.groupBy("run_id", F.session_window("ts", grace).alias("w")).agg(
        F.count("*").alias("n"), F.max("ts").alias("last")
    ).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("idle_from"), "n", "last")


def stop_reasons(sessions: DataFrame, runs: DataFrame, min_window_s=45, min_runtime_s=30) -> DataFrame:
    """M4: why each run stopped: exit, idle or timeout, and when (seconds after start).

    ``runs(run_id, started, exited, timeout_s)``.  Idle is the first silence of the
    grace length seen at or after the minimum window; sessions per run are few,
    as each is at least a grace period after the one before.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("start")
    x = sessions.withColumn("next_start", F.lead("start").over(w)).join(runs, "run_id")
    at = lambda c: (micros(c) - micros(F.col("started"))) / 1e6
    idle = F.greatest(at(F.col("idle_from")), F.lit(float(min_window_s)))
    x = x.withColumn("__idle", F.when(F.col("next_start").isNull() | (idle <= at(F.col("next_start"))), idle))
    first = x.groupBy("run_id").agg(F.min("__idle").alias("idle_s"))
    y = runs.join(first, "run_id", "left").withColumn("exit_s", F.when(F.col("exited").isNotNull(), F.greatest(at(F.col("exited")), F.lit(float(min_runtime_s)))))
    never = F.lit(float("inf"))
    e, i, t = F.coalesce("exit_s", never), F.coalesce("idle_s", never), F.col("timeout_s").cast("double")
    stop = F.least(e, i, t)
    return y.select("run_id", F.when(e == stop, "exit").when(i == stop, "idle").otherwise("timeout").alias("reason"), stop.alias("stop_s"))


class Ordered(StatefulProcessor):
    """Rows of each key in order of event time, looked at once the watermark has passed them.

    What a subclass tells depends on event times only, never on how the input was cut into batches.  Waiting rows are
    counts per ``(us, kind)``; ``facts`` is the subclass's own state of fixed size.  ``deadline`` gives the next time at
    which something happens without a row.  A key silent for ``keep_us`` is forgotten; rows after that start anew.

    A call serves a share of the keys (see ``_machine``), as a key alone is too little work for a call of Python and
    of the state store: a batch appends its rows to ``arrived``, and when the share's alarm rings, its keys are read from
    ``held``, those that are due go on, and the rest is held again.
    """

    RANKS: tuple[str, ...] = ()  # order of kinds at one time

    def __init__(self, keys: list[str], columns: list[str], keep_us: int):
        self.keys, self.columns, self.keep_us = keys, columns, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = handle.getListState("arrived", "waiting binary")
        self.held = handle.getValueState("held", "keys binary")
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ranks = {kind: i for i, kind in enumerate(self.RANKS)}
        waiting: dict[tuple, dict] = {}
        for pdf in rows:
            names = zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in self.keys))
            for k, us, kind, v in zip(names, pdf["us"].tolist(), pdf["kind"].tolist(), pdf["v"].tolist()):
                _add(waiting.setdefault(k, {}), (us, ranks[kind]), 1, max(0.0, v))
        if waiting:
            self.arrived.appendValue((pickle.dumps(waiting, protocol=5),))
            self._ring(min(us for of in waiting.values() for us, _ in of))
        return iter(())

    def _ring(self, us: int) -> None:
        """One alarm for a share: at ``us``, if it is not set to an earlier time."""
        ms, old = -(-us // 1000), self.alarm.get() if self.alarm.exists() else None
        if old is None or ms < old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.alarm.update((ms,))
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # per key: when something is due, its facts (or None), its waiting rows
        keys = pickle.loads(self.held.get()[0]) if self.held.exists() else {}
        for (part,) in self.arrived.get():
            for k, rows in pickle.loads(part).items():
                due, facts, waiting = keys.get(k) or (None, None, {})
                for at, (c, v) in rows.items():
                    _add(waiting, at, c, v)
                first = min(us for us, _ in rows)
                keys[k] = (first if due is None else min(first, due), facts, waiting)
        out = []
        for k, (due, facts, waiting) in list(keys.items()):
            if due <= now:
                keys[k] = self._pass(k, facts, waiting, now, out)
                if keys[k] is None:
                    del keys[k]
        self.arrived.clear()
        self.alarm.clear()
        if keys:
            self.held.update((pickle.dumps(keys, protocol=5),))
            self._ring(min(due for due, _, _ in keys.values()))
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _pass(self, key, facts: list | None, waiting: dict, now: int, out: list) -> tuple | None:
        """One key after the watermark passed ``now``: when it is due again, its facts and waiting rows; None: forgotten."""
        for us, rank in sorted(at for at in waiting if at[0] <= now):
            c, v = waiting.pop((us, rank))
            if facts is not None:
                self._until(key, facts, us, self.RANKS[rank], out)
                if us > facts[0] + self.keep_us and self.deadline(facts) is None:
                    facts = None
            if facts is None:
                facts = [us, *self.fresh()]
            facts[0] = us
            self.row(facts, us, self.RANKS[rank], c, v)
        next_times = [us for us, _ in waiting]
        if facts is not None:
            self._until(key, facts, now + 1, "", out)
            due = self.deadline(facts)
            # gone once nothing can happen any more; else looked at again when something can
            if due is None and now >= facts[0] + self.keep_us:
                facts = None
            else:
                next_times.append(facts[0] + self.keep_us if due is None else due)
        return (min(next_times), facts, waiting) if next_times else None

    def _until(self, key, facts: list, us: int, kind: str, out: list) -> None:
        """Everything due before a row of this time and kind happens."""
        while (due := self.deadline(facts)) is not None and self.before(due, us, kind):
            told = self.due(facts, due)
            if told is not None:
                out.append((*key, *told))

    def before(self, due: int, us: int, kind: str) -> bool:
        return due < us

    def fresh(self) -> tuple:
        raise NotImplementedError

    def row(self, facts: list, us: int, kind: str, c: int, v: float) -> None:
        raise NotImplementedError

    def deadline(self, facts: list) -> int | None:
        raise NotImplementedError

    def due(self, facts: list, us: int) -> tuple | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _add(waiting: dict, at: tuple[int, int], c: int, v: float) -> None:
    """``c`` more rows at a time and kind; their value is the largest."""
    old = waiting.get(at)
    waiting[at] = (c, v) if old is None else (old[0] + c, max(old[1], v))


def _machine(x: DataFrame, proc: Ordered, schema: str) -> DataFrame:
    """Runs a machine over its keys and ``ts, us, kind, v``; ``ts`` is carried so that late rows are known as such.

    Keys are dealt by hash to ``SHARES`` shares, each with one state; the number must stay for the life of a checkpoint.
    """
    share = F.pmod(F.hash(*proc.keys), F.lit(SHARES))
    return x.withColumn("__share", share).groupBy("__share").transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="append", timeMode="eventtime")


class StopReason(Ordered):
    """Exit, idle or timeout of one run, whichever comes first."""

    # facts: seen, started, timeout, exited, last, told
    RANKS = ("start", "exit", "activity")

    def __init__(self, grace: int, min_window: int, min_runtime: int, keep_us: int):
        super().__init__(["run_id"], ["run_id", "reason", "stop_s"], keep_us)
        self.grace, self.min_window, self.min_runtime = grace, min_window, min_runtime

    def fresh(self) -> tuple:
        return -1, -1, -1, -1, False

    def row(self, facts, us, kind, c, v):
        if kind == "start":
            facts[1], facts[2] = us, us + int(v * 1_000_000)
        elif kind == "exit":
            facts[3] = us if facts[3] < 0 else facts[3]
        else:
            facts[4] = us

    def before(self, due, us, kind):
        # activity at the very time comes too late, an exit does not
        return due < us or (due == us and kind == "activity")

    def _stops(self, facts) -> list[tuple[int, int, str]]:
        _, started, timeout, exited, last, told = facts
        if started < 0 or told:
            return []
        out = [(timeout, 2, "timeout")]
        if exited >= 0:
            out.append((max(exited, started + self.min_runtime), 0, "exit"))
        if last >= 0:
            out.append((max(last + self.grace, started + self.min_window), 1, "idle"))
        return out

    def deadline(self, facts):
        return min(self._stops(facts))[0] if self._stops(facts) else None

    def due(self, facts, us):
        reason = min(self._stops(facts))[2]
        facts[5] = True
        return reason, (us - facts[1]) / 1e6


def stop_reasons_stream(stream: DataFrame, grace_s: float = 30, min_window_s: float = 45, min_runtime_s: float = 30, watermark: str = "1 minute", keep_s: float = 86_400) -> DataFrame:
    """M4: why and when each run stopped, told once the watermark has passed that time.

    ``stream(run_id, ts, kind, timeout_s)`` has a ``start`` row per run (with its timeout), ``activity`` rows and at most
    one ``exit``.  Later rows of any run move the watermark and so settle the runs before.
    """
    us = lambda seconds: int(round(seconds * 1_000_000))
    x = stream.withWatermark("ts", watermark).filter(F.col("kind").isin(*StopReason.RANKS) & F.col("ts").isNotNull()).select(
        F.col("run_id").cast("string").alias("run_id"), "ts", micros(F.col("ts")).alias("us"), "kind", F.coalesce(F.col("timeout_s").cast("double"), F.lit(0.0)).alias("v"))
    return _machine(x, StopReason(us(grace_s), us(min_window_s), us(min_runtime_s), us(keep_s)), "run_id string, reason string, stop_s double")


def rules_stream(stream: DataFrame, ruleset: RuleSet) -> DataFrame:
    """M5: the batch rule pass on a stream; it is stateless, so the code is the same."""
    return apply_rules(stream, ruleset)


class SlidingCount(StatefulProcessor):
    """Times of one (key, slot); tells once when some window reaches the threshold."""

    def __init__(self, width: int, n: int, slot: int, columns: list[str]):
        self.width, self.n, self.slot, self.columns = width, n, slot, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "us bigint", "c bigint")
        self.done = handle.getValueState("done", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = False
        for pdf in rows:
            for us, c in pdf.groupby("us")["us"].size().items():
                old = self.times.getValue((int(us),)) if self.times.containsKey((int(us),)) else (0,)
                self.times.updateValue((int(us),), (int(old[0]) + int(c),))
                fresh = True
        if not fresh or self.done.exists():
            return
        # the state is dropped once no window of this slot can grow any more
        self.handle.registerTimer((int(key[-1]) + 2 * self.slot) // 1000)
        pts = sorted((k[0], v[0]) for k, v in self.times.iterator())
        total, j = 0, 0
        for us, c in pts:
            total += c
            while us - pts[j][0] > self.width:
                total -= pts[j][1]
                j += 1
            if total >= self.n and us >= int(key[-1]):
                self.done.update((us,))
                yield pd.DataFrame([(*key[:-1], int(key[-1]), us, total)], columns=self.columns)
                return

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.done.clear()
        return iter(())

    def close(self) -> None:
        pass


def event_count_stream(stream: DataFrame, hit: Column, keys: list[str], seconds: float, n: int, watermark: str = "1 minute") -> DataFrame:
    """M6: C9 on a stream, exact: one row per (keys, time slot) whose densest window reaches ``n``.

    Rows go to their slot and, near its end, also to the next one, exactly as in
    the batch form, so the state of a busy key is spread over slots and is
    dropped when the watermark has passed.
    """
    width = int(round(seconds * 1_000_000))
    slot = max(1, width * SLOT)
    us = micros(F.col("ts"))
    own = us - F.pmod(us, F.lit(slot))
    tail_ = F.pmod(us, F.lit(slot)) >= slot - width
    x = stream.withWatermark("ts", watermark).filter(hit & F.col("ts").isNotNull()).select(
        *[F.coalesce(fld(stream, k).cast("string"), F.lit("")).alias(k) for k in keys], "ts", us.alias("us"),
        F.explode(F.when(tail_, F.array(own, own + slot)).otherwise(F.array(own))).alias("slot"))
    schema = ", ".join(f"{k} string" for k in keys) + ", slot bigint, reached_us bigint, n bigint"
    proc = SlidingCount(width, n, slot, [*keys, "slot", "reached_us", "n"])
    return x.groupBy(*keys, "slot").transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="append", timeMode="eventtime")


def _densest(points: str, own: str, width: int) -> str:
    """SQL of ``total, best, at``: the densest window of ``points(us, c)`` that ends at ``own`` or later, and its first end.

    A point counts from its time on until ``width`` after it, so the running sum over starts and ends, ends first, is
    the window's count; one pass after a sort.
    """
    steps = f"sort_array(flatten(transform({points}, p -> array(struct(p.us AS us, p.c AS c), struct(p.us + {width + 1}L AS us, -p.c AS c)))))"
    more = f"e.c > 0 AND e.us >= {own} AND a.total + e.c > a.best"
    return f"""aggregate({steps}, struct(0L AS total, 0L AS best, 0L AS at),
        (a, e) -> struct(a.total + e.c AS total, if({more}, a.total + e.c, a.best) AS best, if({more}, e.us, a.at) AS at))"""


def event_count_closed(stream: DataFrame, hit: Column, keys: list[str], seconds: float, op: str, n: int, watermark: str = "1 minute") -> DataFrame:
    """M6 for every comparison: per (keys, time slot) the densest window that ends there, if ``op n`` holds.

    A slot is told once, when the watermark has passed it, so the rows do not depend on the batches, and its state goes
    with it.  ``latest_us`` is the first time at which that count was reached.  Built-in aggregations hold the state: the
    first counts equal times, one row per (keys, slot, time) wherever its hash puts it, and passes a slot on when it is
    over; the second gathers its times, once.  No row meets Python.  A row that comes late still counts in a slot that has
    not been told.
    """
    width = int(round(seconds * 1_000_000))
    slot = max(1, width * SLOT)
    # a slot's stretch begins one width before it, so rows near a slot's end are in two
    stretch = F.window("ts", f"{slot + width} microseconds", f"{slot} microseconds", f"{(slot - width) % slot} microseconds")
    x = stream.withWatermark("ts", watermark).filter(hit & F.col("ts").isNotNull())
    key = [F.coalesce(fld(stream, k).cast("string"), F.lit("")).alias(k) for k in keys]
    points = x.groupBy(stretch.alias("__stretch"), *key, micros(F.col("ts")).alias("__us")).agg(F.count("*").alias("__c"))
    slots = points.groupBy("__stretch", *keys).agg(F.collect_list(F.struct(F.col("__us").alias("us"), F.col("__c").alias("c"))).alias("__points"))
    slots = slots.select(*keys, (micros(F.col("__stretch.end")) - slot).alias("slot"), "__points")
    best = slots.select(*keys, "slot", F.explode(F.array(F.expr(_densest("__points", "slot", width)))).alias("__best"))
    out = best.filter("__best.best > 0").select(*keys, "slot", F.col("__best.best").alias("n"), F.col("__best.at").alias("latest_us"))
    return out.filter(COMPARE[op](F.col("n"), F.lit(n)))


def event_count_tumbling(stream: DataFrame, hit: Column, keys: list[str], seconds: int, n: int, watermark: str = "1 minute", slide: int | None = None) -> DataFrame:
    """M6, weaker form on built-in windows: a burst is seen only if one window of the grid holds it."""
    w = F.window("ts", f"{seconds} seconds", f"{slide or seconds} seconds")
    return stream.withWatermark("ts", watermark).filter(hit).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).filter(F.col("n") >= n).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup_stream(stream: DataFrame, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """M7: rows replayed after a restart are dropped within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


class Silence(Ordered):
    """Counts of one process around its last dual-covered call."""

    # facts: seen, calls, capped, last, hosts, newest, told
    RANKS = ("cap", "call", "both", "host")

    def __init__(self, min_calls: int, min_events: int, span: int, keep_us: int):
        super().__init__(["run_id", "pid"], ["run_id", "pid", "last_call_us", "host_events", "last_event_us"], keep_us)
        self.min_calls, self.min_events, self.span = min_calls, min_events, span

    def fresh(self) -> tuple:
        return 0, False, -1, 0, -1, True

    def row(self, facts, us, kind, c, v):
        if kind == "cap":
            facts[2] = True
        elif kind == "host":
            if facts[3] >= 0 and us > facts[3] and not facts[6]:
                facts[4], facts[5] = facts[4] + c, us
        else:
            facts[1] += c
            if kind == "both":
                facts[3:7] = [us, 0, -1, False]

    def deadline(self, facts):
        return None if facts[6] else facts[3] + self.span

    def due(self, facts, us):
        facts[6] = True
        if not facts[2] and facts[1] >= self.min_calls and facts[4] >= self.min_events:
            return facts[3], facts[4], facts[5]
        return None


def silence_stream(
    stream: DataFrame, both_apis: list[str], min_calls=fixed.SILENCE_MIN_CALLS, min_events=fixed.SILENCE_MIN_EVENTS, min_s=fixed.SILENCE_MIN_S,
    watermark: str = "1 minute", keep_s: float = 86_400,
) -> DataFrame:
    """M8: G16 on a stream: a row for every stretch of ``min_s`` without a dual-covered call in which the host still saw the process.

    Told when the watermark passes the end of that stretch: ``host_events`` of the stretch, the newest of them, and the
    call before it.  Processes with too few calls or a capped trace until then are not told.  State per process is a
    few numbers and the rows the watermark has not passed; it goes ``keep_s`` after the last row.
    """
    api = fld(stream, "Api")
    trace = F.col("source") == "apitrace"
    kind = F.when(trace & (api == fixed.META_CAP), "cap").when(trace & api.isin(both_apis), "both").when(
        trace & ~api.isin(fixed.META_WOW64, fixed.META_ATTACHED), "call").when(F.col("source") == "sysmon", "host")
    x = stream.withWatermark("ts", watermark).filter(F.col("ts").isNotNull()).select(
        F.col("run_id").cast("string").alias("run_id"), fld(stream, "ProcessId").cast("string").alias("pid"), "ts", micros(F.col("ts")).alias("us"), kind.alias("kind"), F.lit(0.0).alias("v"))
    x = x.filter(F.col("kind").isNotNull() & F.col("pid").isNotNull())
    span, keep = int(min_s * 1_000_000), int(max(keep_s, min_s) * 1_000_000)
    return _machine(x, Silence(min_calls, min_events, span, keep), "run_id string, pid string, last_call_us bigint, host_events bigint, last_event_us bigint")


def late_events(stream: DataFrame, path: str, delay_s: float, checkpoint: str):
    """M9: a query that writes every row once, under ``is_late`` true or false.

    The bound is the newest time of the batches before, minus ``delay_s``; rows without a time are on time.  The bounds
    are a small table beside the rows, so a restart continues with them.
    """
    spark = stream.sparkSession
    bounds = path.rstrip("/") + "_bounds"

    def split(batch: DataFrame, batch_id: int) -> None:
        old = spark.read.schema("us bigint, batch int").parquet(bounds) if _exists(spark, bounds) else None
        bound = None if old is None else old.filter(F.col("batch") < batch_id).agg(F.max("us").alias("us")).first()["us"]
        is_late = F.lit(False) if bound is None else F.coalesce(micros(F.col("ts")) < bound - int(delay_s * 1_000_000), F.lit(False))
        # one folder per batch: a batch run again replaces its own rows
        own = f"{path}/batch={batch_id}"
        batch.withColumn("is_late", is_late).write.mode("overwrite").partitionBy("is_late").parquet(own)
        newest = spark.read.schema(batch.schema).parquet(own).agg(F.max(micros(F.col("ts"))).alias("us"))
        newest.write.mode("overwrite").parquet(f"{bounds}/batch={batch_id}")

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is and read its result back (shared folder)."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out)
    else:
        q = stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    q = q.option("checkpointLocation", scratch_path(spark, name + "-ckpt")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
