"""Queries of SURVEY 2.M: each stream reads files written from the tables and runs to the end of its input."""

from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import ORACLES, adapter, query, table
from detectframe.catalog.joins import trace_and_host
from detectframe.catalog.rules import MATCHES, ruleset
from detectframe.functions.scalar import micros
from detectframe.scale import scratch_path
from detectframe.streaming import streams as S


#: How much later than all others a closing row is: ten years.
CLOSING_US = 3650 * 86_400_000_000

#: Rows of a batch for which one more file, and so one more task, is worth it.
FILE_ROWS = 10_000


def n_files(spark, rows: int, batches: int) -> int:
    """Files of a batch, and so its tasks: more for more rows, up to the session's partitions."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (batches * FILE_ROWS))))


def as_batches(spark, frames: list, rows: int):
    """Write frames, one after the other, and open them as a stream with one batch for each.

    A file source reads files by modification time, so the frames are written in
    order; each has equally many files (up to the session's partitions; empty
    ones fill up), and a batch takes so many.
    """
    path = scratch_path(spark, "in")
    files = n_files(spark, rows, len(frames))
    schema = frames[0].schema
    for i, frame in enumerate(frames):
        frame.repartition(files).write.mode("append").parquet(path)
        for _ in range(files * (i + 1) - len(spark.read.schema(schema).parquet(path).inputFiles())):
            spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def as_stream(df, batches: int = 4, closing: dict | None = None):
    """A table as a stream, one stretch of time after the other, so no row is late.

    Rows without a time come in the first batch; an empty table has empty batches.  ``closing`` are the values of one
    more row, years later, that moves the watermark over everything before it.
    """
    x = df.withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi, rows = x.agg(F.min(micros(F.col("ts"))), F.max(micros(F.col("ts"))), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    part = F.coalesce(F.floor((micros(F.col("ts")) - lo) / ((hi - lo) // batches + 1)), F.lit(0))
    frames = [x.filter(part == i) for i in range(batches)]
    if closing is not None:
        end = {"ts": F.lit(hi + CLOSING_US), **{c: F.lit(v) for c, v in closing.items()}}
        row = df.sparkSession.range(1).select(*[
            (F.timestamp_micros(end[c]) if c == "ts" else end.get(c, F.lit(None)).cast(t)).alias(c) for c, t in x.dtypes])
        frames.append(row)
    return as_batches(df.sparkSession, frames, rows)


def _stateful(spark, run):
    """Run a stateful stream with the state store it needs; the session's settings are put back.

    In local mode the state has as many partitions as there are threads; on a
    cluster the session's own number stays.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": S.ROCKSDB}
    if spark.sparkContext.master.startswith("local"):
        wanted["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query("m1_tail", oracle="SELECT event_id, user_id, event_type FROM events")
def m1(spark, d):
    path, e = scratch_path(spark, "tail"), table(spark, d, "events").select("event_id", "user_id", "event_type")
    files = n_files(spark, e.count(), 2)
    e.repartition(2 * files, "event_id").write.json(path)
    return S.run_to_table(S.tail(spark, path, "event_id bigint, user_id bigint, event_type string", files), "tail")


@query("m3_sse_events", oracle="SELECT event_id, user_id FROM events")
def m3(spark, d):
    """Captured event-stream lines: payloads, comments, broken payloads."""
    e = table(spark, d, "events")
    line = F.concat(F.lit("data: "), F.to_json(F.struct("event_id", "user_id")))
    path = scratch_path(spark, "sse")
    e.select(F.explode(F.array(line, F.lit(": ping"), F.lit("data:"), F.concat(F.lit("data: {bad"), F.col("event_id")), F.lit(""))).alias("value")).repartition(4 * n_files(spark, e.count(), 4)).write.text(path)
    lines = spark.readStream.text(path)
    return S.run_to_table(S.sse_events(lines, "event_id bigint, user_id bigint"), "sse")


@query("m4_activity_sessions", oracle="""
WITH x AS (SELECT concat('run', user_id % 10) AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM events), y AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT run_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS idle_us, count(*) AS n FROM y GROUP BY run_id, g""")
def m4(spark, d):
    """Sessions of activity per run (batch form of the same operator the stream uses)."""
    e = table(spark, d, "events").select(F.concat(F.lit("run"), F.col("user_id") % 10).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    s = S.activity_sessions(e, "2 hours")
    return s.select("run_id", micros(F.col("start")).alias("start_us"), micros(F.col("idle_from")).alias("idle_us"), "n")


@query("m4_stop_reasons", oracle="""
WITH r AS (SELECT concat('run', user_id) AS run_id, min(ts) AS started, CASE WHEN user_id % 3 = 0 THEN max(ts) - INTERVAL 20 DAY END AS exited, CASE WHEN user_id % 4 = 0 THEN 86400.0 ELSE 2592000.0 END AS timeout_s FROM events GROUP BY user_id),
x AS (SELECT concat('run', user_id) AS run_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events), i AS (SELECT x.run_id, min(greatest((epoch_us(x.ts) - epoch_us(r.started)) / 1e6 + 86400, 172800.0)) AS idle_s FROM x JOIN r ON r.run_id = x.run_id
 WHERE (nxt IS NULL OR nxt - x.ts >= INTERVAL 1 DAY) AND (nxt IS NULL OR greatest((epoch_us(x.ts) - epoch_us(r.started)) / 1e6 + 86400, 172800.0) <= (epoch_us(nxt) - epoch_us(r.started)) / 1e6) GROUP BY 1),
z AS (SELECT r.run_id, CASE WHEN exited IS NULL THEN 1e18 ELSE greatest((epoch_us(exited) - epoch_us(started)) / 1e6, 3600) END AS e, coalesce(idle_s, 1e18) AS i, timeout_s AS t FROM r LEFT JOIN i ON r.run_id = i.run_id)
SELECT run_id, CASE WHEN e <= i AND e <= t THEN 'exit' WHEN i <= t AND i <= e THEN 'idle' ELSE 'timeout' END AS reason, round(least(e, i, t), 3) AS stop_s FROM z""")
def m4_stop(spark, d):
    e, runs = _runs(spark, d)
    s = S.activity_sessions(e.select("run_id", "ts"), "1 day")
    return S.stop_reasons(s, runs, 2 * 86400, 3600).withColumn("stop_s", F.round("stop_s", 3))


def _runs(spark, d):
    """Activity of every user as a run, and the runs' starts, exits and timeouts."""
    e = table(spark, d, "events").select(F.concat(F.lit("run"), F.col("user_id")).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    runs = e.groupBy("run_id", "user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last")).select(
        "run_id", "started", F.when(F.col("user_id") % 3 == 0, F.col("last") - F.expr("INTERVAL 20 DAYS")).alias("exited"), F.when(F.col("user_id") % 4 == 0, 86400.0).otherwise(2592000.0).alias("timeout_s"))
    return e, runs


@query("m4_sessions_stream", oracle=ORACLES["m4_activity_sessions"])
def m4_stream(spark, d):
    """The same sessions from a stream; a closing row lets the last ones end."""
    e = table(spark, d, "events").select(F.concat(F.lit("run"), F.col("user_id") % 10).alias("run_id"), "ts")
    out = _stateful(spark, lambda: S.run_to_table(S.activity_sessions(as_stream(e, closing={}), "2 hours", "1 minute"), "sessions"))
    return out.select("run_id", micros(F.col("start")).alias("start_us"), micros(F.col("idle_from")).alias("idle_us"), "n")


@query("m4_stop_reasons_stream", oracle=ORACLES["m4_stop_reasons"])
def m4_stop_stream(spark, d):
    """Why each run stopped, from starts, exits and activity in order of time."""
    e, runs = _runs(spark, d)
    acts = e.select("run_id", "ts", F.lit("activity").alias("kind"), F.lit(None).cast("double").alias("timeout_s"))
    marks = runs.select("run_id", F.explode(F.array(
        F.struct(F.col("started").alias("ts"), F.lit("start").alias("kind"), F.col("timeout_s")), F.struct(F.col("exited").alias("ts"), F.lit("exit").alias("kind"), F.lit(None).cast("double").alias("timeout_s")))).alias("x"))
    rows = acts.unionByName(marks.select("run_id", "x.*").filter(F.col("ts").isNotNull()))
    run = lambda: S.run_to_table(S.stop_reasons_stream(as_stream(rows, closing={"kind": "activity"}), 86400, 2 * 86400, 3600, keep_s=40 * 86400), "stops")
    return _stateful(spark, run).withColumn("stop_s", F.round("stop_s", 3))


@query("m5_rules_stream", using="tel", oracle=f"WITH {MATCHES.strip()} SELECT run_id, seq, rule_id FROM matches")
def m5(spark, d):
    t = adapter(spark, d, "tel")
    return S.run_to_table(S.rules_stream(as_stream(t), ruleset()).select("run_id", "seq", "rule_id"), "rules")


@query("m6_event_count_stream", using="tel", oracle="""
WITH c AS (SELECT run_id, ProcessId, count(*) OVER (PARTITION BY run_id, ProcessId ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM tel WHERE event_type = 'FileCreate') SELECT run_id, ProcessId AS pid FROM c GROUP BY 1, 2 HAVING max(n) >= 3""")
def m6(spark, d):
    """Keys that reach three writes within a day, told by the stream as they do."""
    t = adapter(spark, d, "tel").select("run_id", "ProcessId", "event_type", "ts")
    hit = F.col("event_type") == "FileCreate"
    out = _stateful(spark, lambda: S.run_to_table(S.event_count_stream(as_stream(t), hit, ["run_id", "ProcessId"], 86400, 3), "counts"))
    return out.select("run_id", F.col("ProcessId").alias("pid")).distinct()


@query("m6_event_count_closed", using="tel", oracle="""
WITH c AS (SELECT run_id, ProcessId, epoch_us(ts) AS us, count(*) OVER (PARTITION BY run_id, ProcessId ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM tel WHERE event_type = 'FileCreate'),
s AS (SELECT run_id, ProcessId AS pid, us // 691200000000 * 691200000000 AS slot, max(n) AS n, arg_min(us, us - n * 10000000000000000) AS latest_us FROM c GROUP BY 1, 2, 3)
SELECT op, run_id, pid, slot, n, latest_us FROM s, (VALUES ('gte'), ('eq'), ('lt')) o(op) WHERE CASE op WHEN 'gte' THEN n >= 3 WHEN 'eq' THEN n = 2 ELSE n < 2 END""")
def m6_closed(spark, d):
    """Every (process, eight days) with its densest day of writes, told when these days are over."""
    t = adapter(spark, d, "tel").select("run_id", "ProcessId", "event_type", "ts")
    hit, out = F.col("event_type") == "FileCreate", None
    stream = as_stream(t, closing={"event_type": "FileCreate"})  # written once, read by three streams
    for op, n in (("gte", 3), ("eq", 2), ("lt", 2)):
        run = lambda: S.run_to_table(S.event_count_closed(stream, hit, ["run_id", "ProcessId"], 86400, op, n), "closed")  # noqa: B023, E731
        one = _stateful(spark, run).withColumn("op", F.lit(op))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("run_id") != "").select("op", "run_id", F.col("ProcessId").alias("pid"), "slot", "n", "latest_us")


@query("m6_event_count_tumbling", using="tel", oracle="""
SELECT run_id, ProcessId AS pid, epoch_us(ts) // 86400000000 * 86400000000 AS start_us, count(*) AS n FROM tel WHERE event_type = 'FileCreate' GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def m6_tumbling(spark, d):
    """The weaker form on built-in windows; a closing row lets the last ones end."""
    t = adapter(spark, d, "tel").select("run_id", "ProcessId", "event_type", "ts")
    hit = F.col("event_type") == "FileCreate"
    out = _stateful(spark, lambda: S.run_to_table(S.event_count_tumbling(as_stream(t, closing={"event_type": "FileCreate"}), hit, ["run_id", "ProcessId"], 86400, 3), "tumbling"))
    return out.select("run_id", F.col("ProcessId").alias("pid"), micros(F.col("start")).alias("start_us"), "n")


@query("m7_dedup_stream", oracle="SELECT event_id, user_id FROM events")
def m7(spark, d):
    """Every row delivered twice, as after a restart."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    twice = e.unionByName(e.select("event_id", "user_id", "ts"))
    return _stateful(spark, lambda: S.run_to_table(S.dedup_stream(as_stream(twice), ["event_id"], "1 day").select("event_id", "user_id"), "dedup"))


@query("m8_silence_stream", oracle="""
WITH x AS (SELECT concat('run', user_id % 5) AS run_id, CAST(user_id AS varchar) AS pid, epoch_us(ts) AS us, event_type IN ('click', 'purchase') AS traced, event_type AS e, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k, user_id AS u FROM events),
t AS (SELECT *, traced AND e = 'click' AND k = 99 AND u % 3 = 0 AS cap, traced AND (e = 'purchase' OR k % 4 < 3 OR NOT ((k = 99 AND u % 3 = 0) OR k = 95)) AS call FROM x),
l AS (SELECT DISTINCT run_id, pid, us, lead(us) OVER (PARTITION BY run_id, pid ORDER BY us) AS nxt FROM (SELECT DISTINCT run_id, pid, us FROM t WHERE call) y),
g AS (SELECT l.run_id, l.pid, l.us AS last_call_us, count(*) FILTER (WHERE t.call) AS n_calls, count(*) FILTER (WHERE t.cap) AS n_caps, count(*) FILTER (WHERE NOT t.traced AND t.us > l.us) AS host_events, max(t.us) FILTER (WHERE NOT t.traced AND t.us > l.us) AS last_event_us
  FROM l JOIN t ON t.run_id = l.run_id AND t.pid = l.pid AND t.us <= l.us + 21600000000 WHERE l.nxt IS NULL OR l.nxt - l.us > 21600000000 GROUP BY 1, 2, 3)
SELECT run_id, pid, last_call_us, host_events, last_event_us FROM g WHERE n_calls >= 5 AND n_caps = 0 AND host_events >= 2""")
def m8(spark, d):
    """Stretches of six hours without calls of a process that the host sensor still saw."""
    t = trace_and_host(spark, d).withColumn("ProcessId", F.coalesce("SourceProcessId", "ProcessId"))
    both = sorted({a for apis in fixed.EVENT_CALLS.values() for a in apis})
    rows = t.select("run_id", "ts", "source", "Api", "ProcessId")
    run = lambda: S.run_to_table(S.silence_stream(as_stream(rows, closing={"source": "sysmon", "ProcessId": ""}), both, min_events=2, min_s=6 * 3600, keep_s=400 * 86400), "silence")
    return _stateful(spark, run)


@query("m9_late_events", oracle="SELECT count(*) AS total, count(DISTINCT event_id) AS distinct_ids, count(*) FILTER (WHERE event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00') > 0 AS some_late FROM events")
def m9(spark, d):
    """Every fiftieth row arrives last; late rows are kept beside the on-time ones."""
    return _late(spark, d).agg(F.count("*").alias("total"), F.countDistinct("event_id").alias("distinct_ids"), F.max("is_late").alias("some_late"))


def _late(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    path, ck = scratch_path(spark, "by-time"), scratch_path(spark, "by-time-ckpt")
    held = F.coalesce(F.col("event_id") % 50 == 0, F.lit(False))
    s = as_batches(spark, [e.filter(~held), e.filter(held)], e.count())
    S.late_events(s, path, 3600.0, ck).start().awaitTermination()
    return spark.read.schema("event_id bigint, ts timestamp, batch int, is_late boolean").parquet(path)


@query("m9_late_ids", oracle="""
WITH b AS (SELECT max(ts) AS newest FROM events WHERE event_id % 50 <> 0) SELECT event_id, event_id % 50 = 0 AND ts < newest - INTERVAL 1 HOUR AS is_late FROM events, b""")
def m9_ids(spark, d):
    """Which rows are late: the exact ids."""
    return _late(spark, d).select("event_id", "is_late")
