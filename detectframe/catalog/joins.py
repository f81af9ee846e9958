"""Queries of SURVEY 2.E and 2.I."""

from pyspark.sql import functions as F

from detectframe.catalog.base import adapter, query, table
from detectframe.catalog.rules import MATCHES, ruleset
from detectframe.functions.scalar import micros
from detectframe.operators import joins as J
from detectframe.operators import lineage as L
from detectframe.operators import rules as R
from detectframe.operators import rollup as U


@query("e1_resolve_labels", using="runs", oracle="""
WITH l AS (SELECT kind, val, arg_max(label, ord) AS label, arg_max(family, ord) AS family FROM (
  SELECT 'report' AS kind, concat('rep', c_custkey * 7) AS val, 'malicious' AS label, c_mktsegment AS family, c_custkey AS ord FROM customer
  UNION ALL SELECT 'sha256', concat('sha', c_custkey % 400), 'benign', c_mktsegment, c_custkey FROM customer
  UNION ALL SELECT 'filename', concat('file', c_custkey % 90, '.exe'), 'malicious', 'byname', c_custkey FROM customer) x GROUP BY 1, 2)
SELECT r.run_id, coalesce(a.label, b.label, c.label) AS label, CASE WHEN a.label IS NOT NULL THEN a.family WHEN b.label IS NOT NULL THEN b.family ELSE c.family END AS family,
  CASE WHEN a.label IS NOT NULL THEN 'report' WHEN b.label IS NOT NULL THEN 'sha256' WHEN c.label IS NOT NULL THEN 'filename' END AS label_by
FROM runs r LEFT JOIN l a ON a.kind = 'report' AND a.val = r.run_id LEFT JOIN l b ON b.kind = 'sha256' AND b.val = r.sha256 LEFT JOIN l c ON c.kind = 'filename' AND c.val = r.filename""")
def e1(spark, d):
    return J.resolve_labels(adapter(spark, d, "runs"), labels_of(spark, d)).select("run_id", "label", "family", "label_by")


def labels_of(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    row = lambda kind, val, label, fam: c.select(F.lit(kind).alias("match_kind"), val.alias("match_value"), F.lit(label).alias("label"), fam.alias("family"), k.alias("ord"))
    return row("report", F.concat(F.lit("rep"), k * 7), "malicious", F.col("c_mktsegment")).unionByName(
        row("sha256", F.concat(F.lit("sha"), k % 400), "benign", F.col("c_mktsegment"))).unionByName(
        row("filename", F.concat(F.lit("file"), k % 90, F.lit(".exe")), "malicious", F.lit("byname")))


_DOWN = """
WITH RECURSIVE t AS (SELECT event_id AS n FROM events), down(n, depth) AS (SELECT 5::BIGINT, 0 UNION ALL SELECT t.n, down.depth + 1 FROM t JOIN down ON CAST(floor((t.n - 1) / 2) AS bigint) = down.n AND t.n > 0 AND t.n <> down.n)"""


def _root_runs(spark, d):
    """The tree's root process: guid g5's image and pid 5."""
    t = adapter(spark, d, "tree").filter(F.col("seq") == 5)
    return t.select("run_id", F.lit(5).cast("bigint").alias("root_pid"), F.col("Image").alias("root_image"))


@query("i1_root_guids", using="tree", oracle="""
WITH w AS (SELECT Image FROM tree WHERE seq = 5) SELECT ProcessGuid AS guid FROM tree WHERE ProcessId = '5' AND Image IN (SELECT Image FROM w)""")
def i1(spark, d):
    return L.root_guids(adapter(spark, d, "tree"), _root_runs(spark, d)).select("guid")


@query("i1_root_guids_fallbacks", using="tree", oracle="""
SELECT 'by-children' AS step, ParentProcessGuid AS guid FROM tree WHERE ParentProcessId = '7' AND ParentProcessGuid IS NOT NULL GROUP BY 2""")
def i1_fallbacks(spark, d):
    """No launcher image known: the parent GUIDs that children name."""
    t = adapter(spark, d, "tree")
    runs = _root_runs(spark, d).select("run_id", F.lit(7).cast("bigint").alias("root_pid"), F.lit("C:\\bin\\other.exe").alias("root_image"))
    return L.root_guids(t, runs).select(F.lit("by-children").alias("step"), "guid")


@query("i2_closure_guid", oracle=_DOWN + " SELECT concat('g', n) AS guid, CAST(depth AS bigint) AS depth FROM down")
def i2(spark, d):
    t = adapter(spark, d, "tree")
    roots = t.filter(F.col("ProcessGuid") == "g5").select("run_id", F.col("ProcessGuid").alias("guid"))
    return L.closure_guid(t, roots).select("guid", F.col("depth").cast("bigint").alias("depth"))


@query("i3_lineage_pids", oracle=_DOWN + " SELECT DISTINCT n % 997 AS pid FROM down UNION SELECT 5")
def i3(spark, d):
    t = adapter(spark, d, "tree")
    roots = t.filter(F.col("ProcessGuid") == "g5").select("run_id", F.col("ProcessGuid").alias("guid"))
    return L.lineage_pids(t, L.closure_guid(t, roots), _root_runs(spark, d)).select("pid")


@query("i4_closure_pid_timed", using="tree", oracle="""
WITH RECURSIVE born AS (SELECT CAST(ProcessId AS bigint) AS pid, min(ts) AS born FROM tree GROUP BY 1), died AS (SELECT CAST(ProcessId AS bigint) AS pid, max(ts) - INTERVAL 3 DAY AS died FROM tree GROUP BY 1),
e AS (SELECT DISTINCT CAST(ParentProcessId AS bigint) AS p, CAST(ProcessId AS bigint) AS c FROM tree), ok AS (SELECT e.p, e.c FROM e JOIN born ON born.pid = e.c LEFT JOIN died ON died.pid = e.p WHERE NOT coalesce(born.born > died.died + INTERVAL 1 SECOND, false)),
r(pid) AS (SELECT 5::BIGINT UNION SELECT ok.c FROM ok JOIN r ON ok.p = r.pid) SELECT pid FROM r""")
def i4(spark, d):
    """Pids are reused and form cycles; each pid ends three days before its last sight."""
    t = adapter(spark, d, "tree")
    ends = t.groupBy("run_id", "ProcessId").agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("ts"), F.max("seq").alias("seq")).withColumn("event_type", F.lit("ProcessTerminate"))
    ev = t.unionByName(ends, allowMissingColumns=True)
    return L.closure_pid_timed(ev, _root_runs(spark, d)).select("pid")


@query("i5_process_tree", using="tree", oracle="""
WITH RECURSIVE p AS (SELECT CAST(ProcessId AS bigint) AS pid, arg_max(CAST(ParentProcessId AS bigint), seq) AS ppid, arg_max(Image, seq) AS image, arg_max(CommandLine, seq) AS command_line, max(ts) AS start FROM tree GROUP BY 1),
l AS (SELECT p.*, q.pid AS parent_pid FROM p LEFT JOIN p q ON q.pid = p.ppid AND p.ppid <> 0 AND p.ppid <> p.pid),
r(pid, depth, path) AS (SELECT pid, 0, CAST(pid AS varchar) FROM l WHERE parent_pid IS NULL UNION ALL SELECT l.pid, r.depth + 1, concat(r.path, '/', l.pid) FROM l JOIN r ON l.parent_pid = r.pid)
SELECT l.pid, l.ppid, l.image, l.command_line, epoch_us(start) AS start_us, parent_pid, CAST(r.depth AS bigint) AS depth, r.path FROM l LEFT JOIN r ON l.pid = r.pid""")
def i5(spark, d):
    t = L.process_tree(adapter(spark, d, "tree"))
    return t.select("pid", "ppid", "image", "command_line", micros(F.col("start_time")).alias("start_us"), "parent_pid", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", "/").alias("path"))


@query("i6_interesting_subtree", oracle="""
WITH RECURSIVE t AS (SELECT event_id AS n, CASE WHEN event_id > 0 THEN CAST(floor((event_id - 1) / 2) AS bigint) END AS p, event_type AS e, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM events),
down(n) AS (SELECT 40::BIGINT UNION ALL SELECT t.n FROM t JOIN down ON t.p = down.n), seed AS (SELECT n FROM down UNION SELECT n FROM t WHERE k = 77 AND e = 'signup'),
up(n) AS (SELECT n FROM seed UNION SELECT t.p FROM t JOIN up ON t.n = up.n WHERE t.p IS NOT NULL) SELECT n AS pid FROM up""")
def i6(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    links = e.select(F.lit("r").alias("run_id"), n.alias("pid"), F.when(n > 0, F.floor((n - 1) / 2).cast("bigint")).alias("parent_pid"))
    marked = e.filter((F.regexp_extract("props", "[0-9]+", 0) == "77") & (F.col("event_type") == "signup")).select(F.lit("r").alias("run_id"), n.alias("pid"))
    return L.interesting_subtree(links, links.filter(F.col("pid") == 40).select("run_id", "pid"), marked).select("pid")


def lineage_of(spark, d):
    t = adapter(spark, d, "tree")
    runs = _root_runs(spark, d)
    roots = t.filter(F.col("ProcessGuid") == "g5").select("run_id", F.col("ProcessGuid").alias("guid"))
    guids = L.closure_guid(t, roots).select("run_id", "guid")
    return guids, L.lineage_pids(t, guids, runs)


@query("e2_scope", oracle=_DOWN + """, a AS (SELECT event_id AS seq, user_id AS u, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN NULL ELSE event_id + 1000000 END AS g, CASE WHEN event_id % 7 = 0 THEN true END AS preset FROM events)
SELECT seq, coalesce(preset, CASE WHEN g IS NOT NULL THEN g IN (SELECT n FROM down) ELSE u IN (SELECT n % 997 FROM down UNION SELECT 5) END) AS in_scope FROM a""")
def e2(spark, d):
    guids, pids = lineage_of(spark, d)
    n = F.col("event_id")
    a = table(spark, d, "events").select(
        F.lit("r").alias("run_id"), n.alias("seq"), F.col("user_id").cast("string").alias("SourceProcessId"),
        F.when(n % 3 == 0, F.concat(F.lit("g"), n)).when(n % 3 == 2, F.concat(F.lit("g"), n + 1000000)).otherwise("").alias("ProcessGuid"), F.when(n % 7 == 0, F.lit(True)).alias("in_scope"))
    return L.scope(a, guids, pids).select("seq", "in_scope")


@query("i7_dropped_files", oracle=_DOWN + """, f AS (SELECT event_id AS seq, user_id AS u, CASE WHEN event_id % 3 = 0 THEN event_id END AS g, concat(CASE WHEN event_id % 11 = 0 THEN 'c:/AGENT/x' ELSE 'C:/u/' END, event_id % 800) AS path FROM events WHERE event_type = 'signup'),
i AS (SELECT path, min(seq) AS first_seq FROM f WHERE path NOT LIKE 'c:/AGENT%' AND CASE WHEN g IS NOT NULL THEN g IN (SELECT n FROM down) ELSE u IN (SELECT n % 997 FROM down UNION SELECT 5) END GROUP BY 1)
SELECT path, first_seq FROM i ORDER BY first_seq LIMIT 50""")
def i7(spark, d):
    guids, pids = lineage_of(spark, d)
    n = F.col("event_id")
    path = F.concat(F.when(n % 11 == 0, "c:/AGENT/x").otherwise("C:/u/"), n % 800)
    ev = table(spark, d, "events").filter(F.col("event_type") == "signup").select(
        F.lit("r").alias("run_id"), n.alias("seq"), F.lit("FileCreate").alias("event_type"), F.when(n % 3 == 0, F.concat(F.lit("g"), n)).alias("ProcessGuid"), F.col("user_id").cast("string").alias("ProcessId"),
        F.translate(path, "/", "\\").alias("TargetFilename"))
    out = L.dropped_files(ev, guids, pids, "C:\\Agent\\", 50)
    return out.select(F.translate("path", "\\", "/").alias("path"), "first_seq")


@query("i8_deleted_hashes", oracle=_DOWN + """, f AS (SELECT event_id AS seq, md5(CAST(event_id % 500 AS varchar)) AS m, md5(CAST(event_id % 300 AS varchar)) AS s FROM events WHERE event_type = 'error' AND event_id IN (SELECT n FROM down)),
h AS (SELECT seq, 0 AS pos, 'md5' AS algo, m AS hash FROM f UNION ALL SELECT seq, 1, 'sha256', s FROM f), first AS (SELECT hash, min(seq) AS first_seq, arg_min(algo, seq * 2 + pos) AS algo FROM h GROUP BY 1),
lim AS (SELECT max(first_seq) AS last FROM (SELECT first_seq FROM first ORDER BY first_seq, hash LIMIT 40) x) SELECT hash, algo, first_seq FROM first, lim WHERE first_seq <= last""")
def i8(spark, d):
    guids, pids = lineage_of(spark, d)
    n = F.col("event_id")
    h = F.concat(F.lit("MD5="), F.upper(F.md5((n % 500).cast("string"))), F.lit(", SHA256="), F.md5((n % 300).cast("string")), F.lit(",IMPHASH=1,junk"))
    ev = table(spark, d, "events").filter(F.col("event_type") == "error").select(
        F.lit("r").alias("run_id"), n.alias("seq"), F.lit("FileDelete").alias("event_type"), F.concat(F.lit("g"), n).alias("ProcessGuid"), F.lit(None).cast("string").alias("ProcessId"), F.lit("f").alias("TargetFilename"), h.alias("Hashes"))
    return L.deleted_hashes(ev, guids, pids, 40).select("hash", "algo", "first_seq")


_MISS = """
x AS (SELECT concat('run', user_id % 5) AS run_id, user_id AS u, event_id AS n, ts, event_type AS e, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM events),
calls AS (SELECT *, CASE e WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'CreateFileW' WHEN 1 THEN 'NtSetValueKey' WHEN 2 THEN 'LdrLoadDll' ELSE CASE WHEN k = 99 AND u % 3 = 0 THEN '__event_cap_reached__' WHEN k = 95 THEN '__wow64_follow__' ELSE 'NtCreateFile' END END WHEN 'purchase' THEN 'NtCreateUserProcess' END AS api FROM x WHERE e IN ('click', 'purchase')),
facts AS (SELECT run_id, u, min(ts) FILTER (WHERE api NOT LIKE '\\_\\_%' ESCAPE '\\') AS first_call, bool_or(api = '__event_cap_reached__') AS capped FROM calls GROUP BY 1, 2),
host AS (SELECT *, CASE e WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 11 ELSE 13 END WHEN 'signup' THEN 7 WHEN 'error' THEN 8 END AS eid FROM x WHERE e IN ('view', 'signup') OR (e = 'error' AND u <> 0)),
r AS (SELECT h.* FROM host h JOIN facts f ON f.run_id = h.run_id AND f.u = h.u WHERE f.first_call <= h.ts AND NOT f.capped AND NOT (eid = 13 AND k % 10 = 1)),
g AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.run_id = r.run_id AND c.u = r.u AND c.api = '__wow64_follow__' AND abs(epoch_us(c.ts) - epoch_us(r.ts)) <= 3600000000)),
o AS (SELECT g.* FROM g WHERE NOT (eid = 8 AND EXISTS (SELECT 1 FROM calls c WHERE c.run_id = g.run_id AND c.u = g.u AND c.api = 'NtCreateUserProcess' AND c.n % 12 = g.n % 12 AND c.n % 12 <> 0))),
m AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.run_id = o.run_id AND c.u = o.u AND abs(epoch_us(c.ts) - epoch_us(o.ts)) <= 43200000000
  AND CASE o.eid WHEN 11 THEN c.api IN ('CreateFileW', 'NtCreateFile') WHEN 13 THEN c.api = 'NtSetValueKey' WHEN 7 THEN c.api = 'LdrLoadDll' ELSE c.api IN ('NtCreateThreadEx', 'NtResumeThread') END))"""


def trace_and_host(spark, d):
    e, n, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    t = F.col("event_type")
    click = F.when(k % 4 == 0, "CreateFileW").when(k % 4 == 1, "NtSetValueKey").when(k % 4 == 2, "LdrLoadDll").when((k == 99) & (u % 3 == 0), "__event_cap_reached__").when(k == 95, "__wow64_follow__").otherwise("NtCreateFile")
    traced = t.isin("click", "purchase")
    return e.select(
        F.concat(F.lit("run"), u % 5).alias("run_id"), n.alias("seq"), "ts", F.when(traced, "apitrace").otherwise("sysmon").alias("source"),
        F.when(traced, 9200).when(t == "view", F.when(k % 2 == 0, 11).otherwise(13)).when(t == "signup", 7).otherwise(8).alias("event_id"),
        F.when(traced, "ApiCall").otherwise("Host").alias("event_type"), F.when(t == "click", click).when(t == "purchase", "NtCreateUserProcess").alias("Api"),
        F.when(t == "purchase", F.concat(F.lit("child_pid="), n % 12)).alias("Arg0"), F.when(t != "error", u.cast("string")).otherwise("424242").alias("ProcessId"),
        F.when(t == "error", u.cast("string")).alias("SourceProcessId"), F.when(t == "error", (n % 12).cast("string")).alias("TargetProcessId"),
        F.when((t == "view") & (k % 10 == 1), "HKLM\\Services\\BAM\\x").alias("TargetObject"))


@query("e3_counterpart_misses", oracle=f"""
WITH {_MISS.strip()} SELECT run_id, u AS pid, CASE eid WHEN 11 THEN 'CreateFileW' WHEN 13 THEN 'NtSetValueKey' WHEN 7 THEN 'LdrLoadDll' ELSE 'NtCreateThreadEx' END AS hook, count(*) AS misses, min(n) AS first_seq FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def e3(spark, d):
    m = J.counterpart_misses(trace_and_host(spark, d), window_s=43200, min_misses=2, wow64_s=3600)
    return m.select("run_id", "pid", "hook", "misses", "first_seq")


@query("g15_blind_spot", oracle=f"""
WITH {_MISS.strip()} SELECT run_id, count(*) AS n_hooks, CAST(sum(misses) AS bigint) AS misses FROM (SELECT run_id, u, eid, count(*) AS misses FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 5) x GROUP BY 1""")
def g15(spark, d):
    m = J.counterpart_misses(trace_and_host(spark, d), window_s=43200, min_misses=5, wow64_s=3600)
    return m.groupBy("run_id").agg(F.count("*").alias("n_hooks"), F.sum("misses").alias("misses"))


@query("e4_same_value_sequence", using="calls", oracle="""
WITH c AS (SELECT run_id, CAST(ProcessId AS bigint) AS pid, seq, Api AS api, regexp_extract(Arg0, 'executable=(\\d)', 1) AS ex, regexp_extract(Arg0, 'base=(\\S+)', 1) AS base, regexp_extract(Arg0, 'start=(\\S+)', 1) AS start FROM calls),
a AS (SELECT run_id, pid, base, min(seq) AS first_seq FROM c WHERE api = 'NtAllocateVirtualMemory' AND ex = '1' AND base <> '0x0' GROUP BY 1, 2, 3)
SELECT c.run_id, c.pid, c.seq, c.start AS addr, a.first_seq FROM c JOIN a ON a.run_id = c.run_id AND a.pid = c.pid AND a.base = c.start WHERE c.api IN ('NtCreateThreadEx', 'NtResumeThread', 'NtQueueApcThread') AND c.seq > a.first_seq""")
def e4(spark, d):
    return J.alloc_then_start(adapter(spark, d, "calls")).select("run_id", "pid", "seq", "addr", "first_seq")


@query("e6_exclude_own_children", oracle="""
SELECT DISTINCT l_suppkey AS actor, l_partkey % 50 AS target FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS p FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) b WHERE b.s = a.l_suppkey AND b.p = a.l_partkey % 50)""")
def e6(spark, d):
    li = table(spark, d, "lineitem")
    row = lambda f, name: li.filter(f).select(F.lit("r").alias("run_id"), F.col("l_suppkey").alias("pid"), (F.col("l_partkey") % 50).alias(name)).distinct()
    return J.exclude_own_children(row(F.col("l_returnflag") == "A", "target"), row((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "child")).select(F.col("pid").alias("actor"), "target")


IOC = """
known AS (SELECT concat('s', l_suppkey) AS sha256, CASE l_linenumber % 5 WHEN 0 THEN 'domain' WHEN 1 THEN 'IP:port' WHEN 2 THEN 'ip' WHEN 3 THEN 'url' ELSE 'md5_hash' END AS ioc_type, l_linenumber % 5 AS j, l_partkey % 60 AS p, l_orderkey % 3 AS q, CAST(l_quantity AS int) + 20 AS confidence FROM lineitem WHERE l_returnflag = 'A'),
conns AS (SELECT DISTINCT concat('s', l_suppkey) AS sha256, concat('10.0.0.', l_partkey % 60) AS ip, CAST(l_orderkey % 3 AS varchar) AS port FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_suppkey % 4 > 0),
doms AS (SELECT DISTINCT concat('s', l_suppkey) AS sha256, concat('h', l_partkey % 60, '.org') AS domain FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 2 AND l_suppkey % 4 > 0),
good AS (SELECT *, CASE WHEN j = 1 THEN CASE WHEN EXISTS (SELECT 1 FROM conns c WHERE c.sha256 = known.sha256 AND c.ip = concat('10.0.0.', p) AND c.port = CAST(q AS varchar)) THEN 'connection' END
  WHEN j = 2 THEN CASE WHEN EXISTS (SELECT 1 FROM conns c WHERE c.sha256 = known.sha256 AND c.ip = concat('10.0.0.', p)) THEN 'connection' END
  WHEN EXISTS (SELECT 1 FROM doms m WHERE m.sha256 = known.sha256 AND m.domain = concat('h', p, '.org')) THEN 'dns_query' END AS match_kind FROM known WHERE j < 4 AND confidence >= 50)"""


def iocs(spark, d):
    li = table(spark, d, "lineitem")
    sha, p, q, j = F.concat(F.lit("s"), F.col("l_suppkey")), F.col("l_partkey") % 60, F.col("l_orderkey") % 3, F.col("l_linenumber") % 5
    ioc = F.when(j == 0, F.concat(F.lit(" H"), p, F.lit(".org "))).when(j == 1, F.concat(F.lit("10.0.0."), p, F.lit(":"), q)).when(j == 2, F.concat(F.lit("10.0.0."), p)).when(
        j == 3, F.concat(F.lit("http://h"), p, F.lit(".org:80/a/b"))).otherwise("00ff")
    kind = F.when(j == 0, "domain").when(j == 1, "IP:port").when(j == 2, "ip").when(j == 3, "url").otherwise("md5_hash")
    known = li.filter(F.col("l_returnflag") == "A").select(sha.alias("sha256"), kind.alias("ioc_type"), ioc.alias("ioc"), (F.col("l_quantity").cast("int") + 20).alias("confidence"))
    seen = F.col("l_suppkey") % 4 > 0
    conns = li.filter((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1) & seen).select(sha.alias("sha256"), F.concat(F.lit("10.0.0."), p).alias("ip"), q.cast("string").alias("port"))
    doms = li.filter((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 2) & seen).select(sha.alias("sha256"), F.concat(F.lit("H"), p, F.lit(".org.")).alias("domain"))
    return known, conns, doms


@query("e7_ioc_matches", oracle=f"WITH {IOC.strip()} SELECT sha256, ioc_type, match_kind, match_kind IS NOT NULL AS matched, count(*) AS n FROM good GROUP BY 1, 2, 3, 4")
def e7(spark, d):
    m = J.ioc_matches(*iocs(spark, d))
    return m.groupBy("sha256", "ioc_type", "match_kind", "matched").agg(F.count("*").alias("n"))


VERD = IOC + """, samples AS (SELECT concat('s', s_suppkey) AS sha256, concat('n', s_nationkey) AS family FROM supplier UNION ALL SELECT concat('none', r_regionkey), 'n0' FROM region),
verd AS (SELECT s.*, count(g.sha256) AS total, count(g.match_kind) AS hit, CASE WHEN count(g.sha256) = 0 THEN 'no_groundtruth_iocs' WHEN count(g.match_kind) > 0 THEN 'observed'
  WHEN s.sha256 IN (SELECT sha256 FROM conns UNION SELECT sha256 FROM doms) THEN 'missed' ELSE 'inconclusive' END AS verdict FROM samples s LEFT JOIN good g ON g.sha256 = s.sha256 GROUP BY 1, 2)"""


def ioc_verdict_rows(spark, d):
    known, conns, doms = iocs(spark, d)
    samples = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("sha256"), F.concat(F.lit("n"), "s_nationkey").alias("family")).unionByName(
        table(spark, d, "region").select(F.concat(F.lit("none"), "r_regionkey").alias("sha256"), F.lit("n0").alias("family")))
    return J.ioc_verdicts(samples, J.ioc_matches(known, conns, doms), conns, doms)


@query("e7_ioc_verdicts", oracle=f"WITH {VERD.strip()} SELECT sha256, family, verdict, hit AS matched, total AS total_iocs FROM verd")
def e7_verdicts(spark, d):
    return ioc_verdict_rows(spark, d)


_TECH = """
obs AS (SELECT DISTINCT l_suppkey AS k, concat('T', 1000 + l_partkey % 40, CASE WHEN l_linenumber > 4 THEN concat('.00', l_linenumber) ELSE '' END) AS t FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 6),
ex AS (SELECT DISTINCT l_suppkey AS k, concat('T', 1000 + l_partkey % 40, CASE WHEN l_linenumber > 2 THEN concat('.00', l_linenumber) ELSE '' END) AS t FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 8)"""


def _tech_rows(spark, d):
    li = table(spark, d, "lineitem")
    t = lambda lim: F.concat(F.lit("T"), 1000 + F.col("l_partkey") % 40, F.when(F.col("l_linenumber") > lim, F.concat(F.lit(".00"), F.col("l_linenumber"))).otherwise(""))
    key = F.col("l_suppkey").alias("run_id")
    return (li.filter((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 6)).select(key, t(4).alias("technique")),
            li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 8)).select(key, t(2).alias("technique")))


@query("e8_technique_overlap", oracle=f"""
WITH {_TECH.strip()}, k AS (SELECT k FROM obs UNION SELECT k FROM ex), a AS (SELECT obs.k, count(*) AS n FROM obs JOIN ex ON obs.k = ex.k AND obs.t = ex.t GROUP BY 1),
b AS (SELECT o.k, count(*) AS n FROM (SELECT DISTINCT k, split_part(t, '.', 1) AS p FROM obs) o JOIN (SELECT DISTINCT k, split_part(t, '.', 1) AS p FROM ex) e ON o.k = e.k AND o.p = e.p GROUP BY 1)
SELECT k.k AS run_id, coalesce(a.n, 0) AS overlap, coalesce(b.n, 0) AS parent_overlap, coalesce(b.n, 0) >= 2 AS behavior_ok FROM k LEFT JOIN a ON a.k = k.k LEFT JOIN b ON b.k = k.k""")
def e8(spark, d):
    return J.technique_overlap(*_tech_rows(spark, d))


@query("e9_technique_covered", oracle=f"""
WITH {_TECH.strip()} SELECT ex.k AS run_id, ex.t AS technique, EXISTS (SELECT 1 FROM obs WHERE obs.k = ex.k AND (obs.t = ex.t OR starts_with(ex.t, concat(obs.t, '.')) OR starts_with(obs.t, concat(ex.t, '.')))) AS covered FROM ex""")
def e9(spark, d):
    obs, ex = _tech_rows(spark, d)
    return J.technique_covered(ex.distinct(), obs).select("run_id", "technique", "covered")


AUDIT = """
man AS (SELECT concat('file', p_partkey % 900, '.exe') AS file, concat('T', 1000 + p_size, CASE WHEN p_partkey % 2 = 0 THEN concat('.00', p_size % 4) ELSE '' END) AS technique, CASE p_partkey % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'clean' END AS expected_min FROM part),
latest AS (SELECT filename AS file, arg_max(run_id, struct_pack(t := ts, r := run_id)) AS run_id, arg_max(level, struct_pack(t := ts, r := run_id)) AS level, arg_max(score, struct_pack(t := ts, r := run_id)) AS score FROM runs GROUP BY 1),
aud AS (SELECT man.file, man.technique, CASE WHEN run_id IS NULL THEN 'NO-REPORT' ELSE concat(level, '/', score) END AS verdict,
  CASE WHEN run_id IS NULL THEN '-' WHEN (CASE level WHEN 'malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END) >= (CASE coalesce(expected_min, 'suspicious') WHEN 'malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END) THEN 'yes' ELSE 'NO' END AS band_ok,
  run_id IS NOT NULL AND EXISTS (SELECT 1 FROM runs s WHERE s.run_id = latest.run_id AND (s.technique = man.technique OR starts_with(man.technique, concat(s.technique, '.')) OR starts_with(s.technique, concat(man.technique, '.')))) AS technique_hit FROM man LEFT JOIN latest ON man.file = latest.file)"""


def audit_rows(spark, d):
    r, k = adapter(spark, d, "runs"), F.col("p_partkey")
    man = table(spark, d, "part").select(
        F.concat(F.lit("file"), k % 900, F.lit(".exe")).alias("file"), F.concat(F.lit("T"), 1000 + F.col("p_size"), F.when(k % 2 == 0, F.concat(F.lit(".00"), F.col("p_size") % 4)).otherwise("")).alias("technique"),
        F.when(k % 3 == 0, "malicious").when(k % 3 == 1, "clean").alias("expected_min"))
    latest = r.groupBy(F.col("filename").alias("file")).agg(F.max_by(F.struct("run_id", "level", "score"), F.struct("ts", "run_id")).alias("b")).select("file", "b.*")
    return J.manifest_audit(man, latest, r.select("run_id", "technique"))


@query("e10_manifest_audit", using="runs", oracle=f"WITH {AUDIT.strip()} SELECT * FROM aud")
def e10(spark, d):
    return audit_rows(spark, d)


@query("e11_enrich_techniques", using="tel", oracle=f"""
WITH {MATCHES.strip()} SELECT seq, rule_id, CASE event_type WHEN 'NetworkConnect' THEN 'T1071' WHEN 'ProcessCreate' THEN 'T1059' WHEN 'ImageLoad' THEN 'T1073' WHEN 'FileCreate' THEN CASE rule_id WHEN 'r-file' THEN 'T1486' END END AS primary_id,
  concat_ws(',', CASE event_type WHEN 'ProcessCreate' THEN 'T1218' WHEN 'ImageLoad' THEN 'T1129' END, CASE rule_id WHEN 'r-ports' THEN 'T1071' WHEN 'r-net' THEN 'T1046' WHEN 'r-cmd' THEN 'T1059.001' WHEN 'r-re' THEN 'T1059' WHEN 'r-load' THEN 'T1129' END) AS rest FROM matches""")
def e11(spark, d):
    rs = ruleset()
    m = R.build_alert(R.apply_rules(adapter(spark, d, "tel"), rs, keep=["seq", "event_type"]), R.rule_table(spark, rs))
    x = J.enrich_techniques(m, J.technique_map(spark), F.col("rule_techniques"))
    return x.select("seq", "rule_id", F.col("primary_tech.technique_id").alias("primary_id"), F.array_join(F.transform("candidates", lambda c: c["technique_id"]), ",").alias("rest"))


@query("e12_process_names", using="tel", oracle="""
SELECT run_id, CAST(ProcessId AS bigint) AS pid, concat('app', arg_min(k % 9, seq), '.exe') AS process_name FROM tel WHERE event_type = 'ProcessCreate' AND ProcessId <> '0' GROUP BY 1, 2""")
def e12(spark, d):
    return J.process_names(adapter(spark, d, "tel"))


@query("f12_iocs_network", oracle=_DOWN + """, c AS (SELECT event_id AS n, user_id AS u, concat('10.0.0.', user_id % 30) AS ip, CAST(event_id % 20 AS varchar) AS port FROM events WHERE event_type = 'click')
SELECT ip, port, bool_or(CASE WHEN n % 2 = 0 THEN n IN (SELECT n FROM down) ELSE u IN (SELECT n % 997 FROM down UNION SELECT 5) END) AS in_scope FROM c GROUP BY 1, 2""")
def f12(spark, d):
    guids, pids = lineage_of(spark, d)
    n, u = F.col("event_id"), F.col("user_id")
    ev = table(spark, d, "events").filter(F.col("event_type") == "click").select(
        F.lit("r").alias("run_id"), F.lit("NetworkConnect").alias("event_type"), F.when(n % 2 == 0, F.concat(F.lit("g"), n)).alias("ProcessGuid"), u.cast("string").alias("ProcessId"),
        F.concat(F.lit("10.0.0."), u % 30).alias("DestinationIp"), (n % 20).cast("string").alias("DestinationPort"))
    return U.iocs_network(ev, guids, pids).select("ip", "port", "in_scope")
