"""Queries of SURVEY 2.H and E5."""

from pyspark.sql import functions as F

from detectframe.catalog.base import adapter, query, table
from detectframe.functions.scalar import micros
from detectframe.operators import windows as W



@query("h1_densest_window", using="tel", oracle="""
WITH c AS (SELECT run_id, ProcessId, ts, count(*) OVER w AS n, min(ts) OVER w AS start FROM tel WHERE event_type = 'FileCreate'
  WINDOW w AS (PARTITION BY run_id, ProcessId ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, ProcessId ORDER BY n DESC, ts) AS rn FROM c)
SELECT run_id, ProcessId AS pid, epoch_us(start) AS start_us, epoch_us(ts) AS end_us, n FROM r WHERE rn = 1""")
def h1(spark, d):
    t = adapter(spark, d, "tel").filter(F.col("event_type") == "FileCreate").withColumnRenamed("ProcessId", "pid")
    w = W.densest_window(t, ["run_id", "pid"], "ts", 2 * 86400)
    return w.select("run_id", "pid", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"), "n")


_LIFE = """
life AS (SELECT run_id, CAST(ProcessId AS bigint) AS pid, arg_max(ts, seq) FILTER (WHERE event_type = 'ProcessCreate') AS start, arg_max(ts, seq) FILTER (WHERE event_type = 'ProcessTerminate') AS "end",
  arg_max(ParentProcessId, seq) FILTER (WHERE event_type = 'ProcessCreate') AS ppid FROM tel WHERE event_type IN ('ProcessCreate', 'ProcessTerminate') GROUP BY 1, 2)"""


@query("e5_pair_start_end", using="tel", oracle=f"""
WITH {_LIFE.strip()} SELECT run_id, pid, ppid, epoch_us(start) AS start_us, epoch_us("end") AS end_us, (epoch_us("end") - epoch_us(start)) / 1000000.0::DOUBLE AS lifetime_s FROM life""")
def e5(spark, d):
    return W.pair_start_end(adapter(spark, d, "tel")).select("run_id", "pid", "ppid", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"), "lifetime_s")


_BURST = f"""
{_LIFE.strip()}, short AS (SELECT run_id, ppid, pid, start AS ts FROM life WHERE ppid <> '' AND epoch_us("end") - epoch_us(start) BETWEEN 0 AND 20 * 86400000000),
c AS (SELECT *, count(*) OVER (PARTITION BY run_id, ppid ORDER BY ts RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW) AS n FROM short),
best AS (SELECT run_id, ppid, n, ts AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY run_id, ppid ORDER BY n DESC, ts) AS rn FROM c) r WHERE rn = 1 AND n >= 2)"""


@query("h2_process_burst", using="tel", oracle=f"WITH {_BURST.strip()} SELECT run_id, ppid, n, epoch_us(\"end\") AS end_us FROM best")
def h2(spark, d):
    b = W.process_burst(adapter(spark, d, "tel"), lived_s=20 * 86400, window_s=4 * 86400, min_count=2)
    return b.select("run_id", "ppid", "n", micros(F.col("end")).alias("end_us"))


@query("h2_process_burst_members", using="tel", oracle=f"""
WITH {_BURST.strip()} SELECT s.run_id, s.ppid, s.pid FROM short s JOIN best b ON s.run_id = b.run_id AND s.ppid = b.ppid AND s.ts <= b."end" AND s.ts >= b."end" - INTERVAL 4 DAY""")
def h2_members(spark, d):
    t = adapter(spark, d, "tel")
    b = W.process_burst(t, lived_s=20 * 86400, window_s=4 * 86400, min_count=2)
    return W.process_burst_members(t, b, lived_s=20 * 86400).select("run_id", "ppid", "pid")


_CONN = """
con AS (SELECT run_id, concat('p', CAST(ProcessId AS bigint) % 3) AS pid, ts, DestinationIp AS ip, DestinationPort AS port FROM tel WHERE event_type = 'NetworkConnect' AND coalesce(Initiated, 'true') = 'true'),
c AS (SELECT *, count(*) OVER (PARTITION BY run_id, pid ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS n FROM con),
best AS (SELECT run_id, pid, n, ts AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pid ORDER BY n DESC, ts) AS rn FROM c) r WHERE rn = 1),
mem AS (SELECT con.*, best."end" AS e FROM con JOIN best ON con.run_id = best.run_id AND con.pid = best.pid AND con.ts <= best."end" AND con.ts >= best."end" - INTERVAL 3 DAY),
ports AS (SELECT run_id, pid, ip, count(DISTINCT port) AS n, max(e) AS e FROM mem WHERE ip <> '' AND port <> '' GROUP BY 1, 2, 3),
scans AS (SELECT * FROM ports WHERE n >= 3),
floods AS (SELECT * FROM best WHERE n >= 8 AND NOT EXISTS (SELECT 1 FROM scans s WHERE s.run_id = best.run_id AND s.pid = best.pid))"""


def _conns(spark, d):
    t = adapter(spark, d, "tel")
    return t.withColumn("ProcessId", F.concat(F.lit("p"), F.col("ProcessId").cast("bigint") % 3))


@query("h3_network_burst", using="tel", oracle=f"""
WITH {_CONN.strip()} SELECT run_id, pid, 'port_scan' AS kind, ip, n AS count, epoch_us(e) AS end_us FROM scans UNION ALL SELECT run_id, pid, 'connection_flood', NULL, n, epoch_us("end") FROM floods""")
def h3(spark, d):
    b = W.network_burst(_conns(spark, d), window_s=3 * 86400, scan_min=3, flood_min=8)
    return b.select("run_id", "pid", "kind", "ip", "count", micros(F.col("end")).alias("end_us"))


@query("h3_burst_destinations", using="tel", oracle=f"""
WITH {_CONN.strip()}, k AS (SELECT m.run_id, m.pid, m.ip, count(*) AS count FROM mem m JOIN floods f ON m.run_id = f.run_id AND m.pid = f.pid WHERE ip <> '' GROUP BY 1, 2, 3)
SELECT run_id, pid, ip, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pid ORDER BY count DESC, ip) AS rank FROM k) r WHERE rank <= 5""")
def h3_top(spark, d):
    c = _conns(spark, d)
    b = W.network_burst(c, window_s=3 * 86400, scan_min=3, flood_min=8)
    return W.burst_top(c, b, window_s=3 * 86400).withColumn("rank", F.col("rank").cast("bigint"))


@query("h3_dns_burst", using="dns", oracle="""
WITH q AS (SELECT run_id, ProcessId AS pid, ts, QueryName AS name FROM dns),
c AS (SELECT *, count(*) OVER (PARTITION BY run_id, pid ORDER BY ts RANGE BETWEEN INTERVAL 90 SECOND PRECEDING AND CURRENT ROW) AS n FROM q),
best AS (SELECT run_id, pid, n, ts AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pid ORDER BY n DESC, ts) AS rn FROM c) r WHERE rn = 1),
s AS (SELECT q.run_id, q.pid, max(n) AS count, epoch_us(max("end")) AS end_us, count(DISTINCT name) / count(*) AS u, sum(length(name)) / count(*) AS l FROM q JOIN best b ON q.run_id = b.run_id AND q.pid = b.pid AND q.ts <= b."end" AND q.ts >= b."end" - INTERVAL 90 SECOND WHERE name <> '' GROUP BY 1, 2)
SELECT run_id, pid, CASE WHEN count >= 6 AND l >= 20 AND u >= 0.8 THEN 'dns_tunnel_suspect' ELSE 'dns_flood' END AS kind, count, end_us, round(l, 6) AS avg_len FROM s WHERE count >= 6""")
def h3_dns(spark, d):
    b = W.dns_burst(adapter(spark, d, "dns"), window_s=90, flood_min=6, tunnel_min=6, tunnel_len=20)
    return b.select("run_id", "pid", "kind", "count", micros(F.col("end")).alias("end_us"), F.round("avg_len", 6).alias("avg_len"))


@query("h4_first_per_key", oracle="""
SELECT user_id, event_type, event_id AS first_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) r WHERE rn = 1""")
def h4(spark, d):
    f = W.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return f.select("user_id", "event_type", F.col("event_id").alias("first_id"), "value")


@query("h5_latest_per_key", using="runs", oracle="""
WITH x AS (SELECT *, priority = '1-URGENT' AS pinned FROM runs), w AS (SELECT sha256, arg_max(run_id, struct_pack(t := ts, r := run_id)) AS winner FROM x WHERE NOT pinned GROUP BY 1)
SELECT x.run_id, pinned OR x.run_id = w.winner AS kept, CASE WHEN NOT (pinned OR x.run_id = w.winner) THEN w.winner END AS superseded_by FROM x LEFT JOIN w ON x.sha256 = w.sha256""")
def h5(spark, d):
    return W.latest_per_key(adapter(spark, d, "runs"), "sha256", "ts", "run_id", F.col("priority") == "1-URGENT").select("run_id", "kept", "superseded_by")


@query("h6_triage_rank", using="alerts", oracle="""
WITH x AS (SELECT rtrim(QueryName, '.') AS host, priority, priority_reason, seq FROM alerts WHERE event_type = 'DnsQuery' AND priority_reason IS NOT NULL)
SELECT host, priority, priority_reason FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN priority = 'high' THEN 0 ELSE 1 END, seq) AS rn FROM x) r WHERE rn = 1""")
def h6(spark, d):
    return W.triage_rank(adapter(spark, d, "alerts"))
