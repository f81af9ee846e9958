"""Queries of SURVEY 2.A."""

from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import adapter, query, table
from detectframe.functions.scalar import micros
from detectframe.scale import scratch_path
from detectframe.sources import normalize as N
from detectframe.sources import readers as R


def _files(df, kind):
    """Write a table as text files for a reader to read; the table decides the size."""
    path = scratch_path(df.sparkSession, kind)
    return path, df


@query("a1_read_events", using="tel", oracle="""
SELECT run_id, seq, event_type, CAST(event_id AS bigint) AS event_id, ProcessId AS pid, epoch_us(ts) AS us FROM tel""")
def a1(spark, d):
    """Events written as JSON lines, some lines cut in half, read back."""
    t = adapter(spark, d, "tel")
    data = F.create_map(F.lit("ProcessId"), F.col("ProcessId"), F.lit("n"), F.col("seq").cast("string"))
    line = F.to_json(F.struct("run_id", "source", "provider_name", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "event_type", data.alias("data")))
    path, _ = _files(t, "jsonl")
    broken = t.select(F.explode(F.array(line, F.substring(line, 1, 40), F.lit(""))).alias("value"))
    broken.write.text(path)
    e = R.read_events(spark, path)
    return e.select("run_id", F.col("data")["n"].cast("bigint").alias("seq"), "event_type", F.col("event_id").cast("bigint").alias("event_id"), F.col("data")["ProcessId"].alias("pid"), micros(F.col("ts")).alias("us"))


@query("a1_malformed_lines", oracle="""
SELECT count(*) * 2 AS n_lines, count(*) AS n_malformed FROM events""")
def a1_bad(spark, d):
    t = table(spark, d, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    path, _ = _files(t, "jsonl")
    t.select(F.explode(F.array(line, F.substring(line, 1, 12))).alias("value")).write.text(path)
    return R.count_malformed(spark, path).agg(F.sum("n_lines").alias("n_lines"), F.sum("n_malformed").alias("n_malformed"))


@query("a2_read_winevent_xml", using="tel", oracle="""
SELECT seq, CAST(CASE WHEN seq % 11 = 0 THEN 0 ELSE event_id END AS bigint) AS event_id,
  CASE WHEN seq % 11 = 0 THEN 'SysmonEvent0' ELSE event_type END AS event_type, epoch_us(ts) AS us, ProcessId AS pid, Image AS image FROM tel""")
def a2(spark, d):
    """Events written as <Event> XML, a missing id in some, read back."""
    t = adapter(spark, d, "tel")
    tag = lambda n, c: F.concat(F.lit(f'<Data Name="{n}">'), c, F.lit("</Data>"))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="host"/>'),
        F.when(F.col("seq") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("<EventID>"), F.col("event_id").cast("string"), F.lit("</EventID>"))),
        F.lit('<TimeCreated SystemTime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z"/><Computer>pc</Computer></System><EventData>'),
        tag("ProcessId", F.col("ProcessId")), tag("Image", F.col("Image")), tag("n", F.col("seq").cast("string")), F.lit("<Data>nameless</Data></EventData></Event>"),
    )
    path, _ = _files(t, "xml")
    t.select(xml.alias("value")).write.text(path)
    e = R.read_winevent_xml(spark, path, "sysmon")
    return e.select(F.col("data")["n"].cast("bigint").alias("seq"), F.col("event_id").cast("bigint").alias("event_id"), "event_type", micros(F.col("ts")).alias("us"),
                    F.col("data")["ProcessId"].alias("pid"), F.col("data")["Image"].alias("image"))


_A3 = " ".join(f"WHEN s = '{s}' AND i = {i} THEN '{n}'" for s, ids in fixed.EVENT_TYPES.items() for i, n in ids.items())
_A3F = " ".join(f"WHEN s = '{s}' THEN concat('{p}', i)" for s, p in fixed.EVENT_TYPE_FALLBACK.items())


@query("a3_classify_event_id", oracle=f"""
WITH x AS (SELECT event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'sysmon' WHEN 1 THEN 'security' WHEN 2 THEN 'system' WHEN 3 THEN 'windefend' WHEN 4 THEN 'powershell' WHEN 5 THEN 'other' ELSE 'wmi_etw' END AS s,
  CAST(CASE event_id % 7 WHEN 0 THEN event_id % 35 WHEN 1 THEN 4690 + event_id % 60 WHEN 2 THEN 7020 + event_id % 30 WHEN 3 THEN 5000 + event_id % 20 WHEN 4 THEN 4100 + event_id % 9 ELSE 5855 + event_id % 9 END AS bigint) AS i FROM events)
SELECT seq, CASE {_A3} {_A3F} WHEN s = 'other' THEN concat('OtherEvent', i) ELSE concat('Wmi_etwEvent', i) END AS event_type FROM x""")
def a3(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    m = n % 7
    src = F.when(m == 0, "sysmon").when(m == 1, "security").when(m == 2, "system").when(m == 3, "windefend").when(m == 4, "powershell").when(m == 5, "other").otherwise("wmi_etw")
    i = F.when(m == 0, n % 35).when(m == 1, 4690 + n % 60).when(m == 2, 7020 + n % 30).when(m == 3, 5000 + n % 20).when(m == 4, 4100 + n % 9).otherwise(5855 + n % 9)
    return e.select(n.alias("seq"), N.classify_event_id(src, i).alias("event_type"))


@query("a4_filter_event_ids", using="tel", oracle="""
SELECT seq, CAST(event_id AS bigint) AS event_id FROM tel WHERE event_id IN (1, 3, 25)""")
def a4(spark, d):
    return N.filter_event_ids(adapter(spark, d, "tel"), [1, 3, 25]).select("seq", F.col("event_id").cast("bigint").alias("event_id"))


@query("a5_since_baseline", oracle="""
SELECT event_type, count(*) AS n_new, min(event_id) AS first_id FROM events WHERE event_id > 1234 GROUP BY 1""")
def a5(spark, d):
    new = N.since_baseline(table(spark, d, "events"), record_id=1234, record_col="event_id")
    return new.groupBy("event_type").agg(F.count("*").alias("n_new"), F.min("event_id").alias("first_id"))


@query("a5_since_time", oracle="""
SELECT event_type, count(*) AS n_new FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1""")
def a5_time(spark, d):
    return N.since_baseline(table(spark, d, "events"), ts="2024-01-15 00:00:00").groupBy("event_type").agg(F.count("*").alias("n_new"))


@query("a6_normalize_api_trace", using="calls", oracle="""
SELECT seq, 'apitrace' AS source, CAST(9200 AS bigint) AS event_id, epoch_us(ts) // 1000 * 1000 AS us, Api AS api, ProcessId AS pid, Arg0 AS arg FROM calls""")
def a6(spark, d):
    c = adapter(spark, d, "calls")
    raw = c.select("run_id", "seq", (F.floor(micros(F.col("ts")) / 1000).cast("bigint").cast("string")).alias("ms"), "Api", "Category", "ProcessId", "ThreadId", "Arg0")
    raw = raw.select("run_id", "seq", F.concat(F.expr("substr(ms, 1, length(ms) - 3)"), F.lit("."), F.expr("right(ms, 3)")).alias("ts"), F.col("Api").alias("api"),
                     F.col("Category").alias("category"), F.col("ProcessId").alias("pid"), F.col("ThreadId").alias("tid"), F.col("Arg0").alias("arg0"))
    e = N.normalize_api_trace(raw)
    # the epoch passes through a double, so it is compared in whole milliseconds
    return e.select("seq", "source", F.col("event_id").cast("bigint").alias("event_id"), (F.round(micros(F.col("ts")) / 1000).cast("bigint") * 1000).alias("us"), F.col("Api").alias("api"), F.col("ProcessId").alias("pid"), F.col("Arg0").alias("arg"))


@query("a7_unify", using="tel calls", oracle="""
SELECT source, event_type, count(*) AS n, min(seq) AS first_seq, count(Api) AS with_api, count(Image) AS with_image
FROM (SELECT source, event_type, seq, NULL AS Api, Image FROM tel UNION ALL SELECT source, event_type, seq, Api, NULL FROM calls) u GROUP BY 1, 2""")
def a7(spark, d):
    u = N.unify(adapter(spark, d, "tel"), adapter(spark, d, "calls"))
    return u.groupBy("source", "event_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.count("Api").alias("with_api"), F.count("Image").alias("with_image"))


@query("a7_time_order", using="tel calls", oracle="""
SELECT row_number() OVER (ORDER BY ts NULLS FIRST, source, seq) AS pos, source, seq FROM (SELECT ts, source, seq FROM tel UNION ALL SELECT ts, source, seq FROM calls) u""")
def a7_order(spark, d):
    """The whole merged time line with its positions."""
    u = N.unify(adapter(spark, d, "tel").select("ts", "source", "seq"), adapter(spark, d, "calls").select("ts", "source", "seq"))
    return N.positions(u, N.time_order()).select("pos", "source", "seq")


@query("a8_source_health", oracle="""
WITH e AS (SELECT concat('run', user_id % 10) AS run_id, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2),
x AS (SELECT r.run_id, s.source FROM (SELECT DISTINCT run_id FROM e) r, (VALUES ('view'), ('click'), ('guardian')) s(source))
SELECT x.run_id, x.source, coalesce(e.n, 0) AS n, e.n IS NULL AS empty FROM x LEFT JOIN e ON x.run_id = e.run_id AND x.source = e.source""")
def a8(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("run"), F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("source"))
    expected = e.select("run_id").distinct().select("run_id", F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("guardian"))).alias("source"))
    return N.source_health(e, expected)


_OPS = ["Start", "DCStop", "Thread_Start", "SetInformation", "OpenKey", "TcpSendIPV4", "Services", "cpu", "weird-op x", ""]
_OPS_SQL = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_OPS))
_CLS = ["ProcessStart", "ProcessDcStop", "ThreadStart", "FileIo", "Registry", "Network", "Services", "Meta", "Weird-Op X", "Unknown"]
_CLS_SQL = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_CLS))


@query("a9_classify_trace_opcode", oracle=f"""
SELECT CASE event_id % 10 {_CLS_SQL} END AS class, count(*) AS n FROM events GROUP BY 1""")
def a9(spark, d):
    n = F.col("event_id") % 10
    op = F.when(n == 0, _OPS[0])
    for i, o in enumerate(_OPS[1:], 1):
        op = op.when(n == i, o)
    return table(spark, d, "events").select(N.classify_trace_opcode(op).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("a10_decode_scan_content", oracle="""
SELECT doc_id, CASE WHEN length(text) > 4000 THEN concat(left(text, 4000), '...(truncated)') ELSE text END AS content FROM documents""")
def a10(spark, d):
    """Texts as the sensor's hex of UTF-16LE, decoded with the sensor's own length limit."""
    doc = table(spark, d, "documents")
    hexed = F.concat(F.lit("0x"), F.hex(F.encode("text", "UTF-16LE")))
    return doc.select("doc_id", N.decode_scan_content(hexed).alias("content"))


@query("a11_provider_fields", oracle="""
SELECT event_id AS seq, concat('op', event_id % 3) AS operation, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS string) ELSE concat('alt', user_id) END AS target, CAST(3 AS bigint) AS n_fields FROM events""")
def a11(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    raw = F.create_map(F.lit("Operation"), F.concat(F.lit("op"), n % 3), F.lit("User"), F.lit("x"), F.lit("Noise"), F.lit("y"), F.lit("Query"), F.lit("q"))
    ti = F.when(n % 2 == 0, F.create_map(F.lit("TargetProcessId"), F.col("user_id").cast("string"))).otherwise(F.create_map(F.lit("TargetPid"), F.concat(F.lit("alt"), F.col("user_id"))))
    kept = N.keep_fields(raw)
    return e.select(n.alias("seq"), kept["Operation"].alias("operation"), N.alias_field(ti, "TargetProcessId", fixed.TARGET_PID_SPELLINGS)["TargetProcessId"].alias("target"), F.size(kept).cast("bigint").alias("n_fields"))


@query("a12_filetime_to_ts", oracle="SELECT event_id AS seq, epoch_us(ts) AS us FROM events")
def a12(spark, d):
    ticks = micros(F.col("ts")) * 10 + 116_444_736_000_000_000
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), micros(N.filetime_to_ts(ticks)).alias("us"))


@query("a13_cap_events", using="tel", oracle="""
SELECT run_id, seq, c > 100 AS truncated FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY run_id) AS c FROM tel) x WHERE r <= 100""")
def a13(spark, d):
    return N.cap_events(adapter(spark, d, "tel").select("run_id", "seq"), 100).select("run_id", "seq", "truncated")


@query("a14_run_summary", using="runs", oracle="""
WITH e AS (SELECT concat('rep', l_orderkey) AS run_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 2) AS t FROM lineitem GROUP BY 1)
SELECT r.run_id, epoch_us(r.ts) AS us, filename, left(sha256, 12) AS sha256_short, status, coalesce(e.n, 0) AS total_events, coalesce(e.a, 0) AS alert_count, coalesce(e.t, 0) AS tampering_count, level AS verdict_level, score AS verdict_score
FROM runs r LEFT JOIN e ON r.run_id = e.run_id""")
def a14(spark, d):
    r = adapter(spark, d, "runs")
    li = table(spark, d, "lineitem").select(F.concat(F.lit("rep"), F.col("l_orderkey")).alias("run_id"), F.when(F.col("l_linenumber") == 2, 25).otherwise(1).alias("event_id"), "l_returnflag")
    s = R.run_summary(r.drop("score", "level"), li, li.filter(F.col("l_returnflag") == "R"), r.select("run_id", "score", "level"))
    return s.withColumn("us", micros(F.col("ts"))).drop("ts")


@query("a14_write_run", using="tel", oracle="""
SELECT run_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM tel WHERE run_id = 'run3' GROUP BY 1""")
def a14_write(spark, d):
    """All runs stored in buckets, one run read back through partition pruning."""
    path = scratch_path(spark, "runs")
    R.write_run(adapter(spark, d, "tel").select("run_id", "seq", "event_type"), path)
    return R.read_run(spark, path, "run3").groupBy("run_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("a15_run_identity", using="runs", oracle="SELECT run_id, sha256, filename, epoch_us(ts) AS us FROM runs")
def a15(spark, d):
    return R.run_identity(adapter(spark, d, "runs")).select("run_id", "sha256", "filename", micros(F.col("ts")).alias("us"))


@query("a16_read_manifest", oracle="""
SELECT concat('sha', c_custkey) AS sha256, CASE WHEN c_custkey % 4 = 0 THEN concat('fam', c_nationkey % 5) ELSE c_mktsegment END AS family FROM customer""")
def a16(spark, d):
    """Customers as manifest lines in one folder per family, some without a family."""
    c = table(spark, d, "customer")
    path = scratch_path(spark, "manifest")
    line = F.to_json(F.struct(F.concat(F.lit("SHA"), F.col("c_custkey")).alias("sha256"), F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("family")))
    folder = F.concat(F.lit("fam"), F.col("c_nationkey") % 5)
    c.select(F.explode(F.array(line, F.lit("{broken"), F.lit(""))).alias("value"), folder.alias("family_dir")).write.partitionBy("family_dir").text(path)
    m = R.read_manifest(spark, path)
    return m.withColumn("family", F.regexp_replace("family", "^family_dir=", ""))


@query("a17_labels_from_manifest", using="runs", oracle="""
SELECT DISTINCT 'sha256' AS match_kind, concat('sha', c_custkey) AS match_value, 'malicious' AS label, c_mktsegment AS family FROM customer
WHERE concat('sha', c_custkey) IN (SELECT sha256 FROM runs) AND c_custkey % 5 <> 0""")
def a17(spark, d):
    c = table(spark, d, "customer")
    m = c.select(F.concat(F.lit("sha"), F.col("c_custkey")).alias("sha256"), F.col("c_mktsegment").alias("family"))
    have = c.filter(F.col("c_custkey") % 5 == 0).select(F.lit("sha256").alias("match_kind"), F.concat(F.lit("SHA"), F.col("c_custkey")).alias("match_value"))
    return R.labels_from_manifest(adapter(spark, d, "runs"), m, have)


def _objects(spark, d):
    """Parts, suppliers and line items as an ATT&CK style object list."""
    from pyspark.sql.types import StructType

    ref = lambda src, i: F.struct(F.lit(src).alias("source_name"), i.alias("external_id"))
    none = lambda t: F.lit(None).cast(t)
    p, s, li = (table(spark, d, x) for x in ("part", "supplier", "lineitem"))
    refs, ph = "array<struct<source_name:string,external_id:string>>", "array<struct<kill_chain_name:string,phase_name:string>>"
    k = F.col("p_partkey")
    tech = p.select(
        F.lit("attack-pattern").alias("type"), F.concat(F.lit("p"), k).alias("id"), F.col("p_name").alias("name"), (k % 9 == 0).alias("revoked"), (k % 11 == 0).alias("x_mitre_deprecated"),
        none("string").alias("relationship_type"), none("string").alias("source_ref"), none("string").alias("target_ref"),
        F.array(ref("other", F.lit("x")), ref("mitre-attack", F.concat(F.when(k % 13 == 0, "Q").otherwise("T"), k))).alias("external_references"),
        F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.col("p_type").alias("phase_name")), F.struct(F.lit("other").alias("kill_chain_name"), F.lit("x").alias("phase_name"))).alias("kill_chain_phases"))
    soft = s.select(F.lit("malware").alias("type"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), none("boolean").alias("revoked"), none("boolean").alias("x_mitre_deprecated"),
                    none("string").alias("relationship_type"), none("string").alias("source_ref"), none("string").alias("target_ref"),
                    F.array(ref("mitre-attack", F.concat(F.lit("S"), F.col("s_suppkey")))).alias("external_references"), none(ph).alias("kill_chain_phases"))
    rel = li.select(F.lit("relationship").alias("type"), F.concat(F.lit("r"), F.col("l_orderkey")).alias("id"), none("string").alias("name"), none("boolean").alias("revoked"), none("boolean").alias("x_mitre_deprecated"),
                    F.when(F.col("l_returnflag") == "A", "uses").otherwise("mitigates").alias("relationship_type"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_ref"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target_ref"),
                    none(refs).alias("external_references"), none(ph).alias("kill_chain_phases"))
    assert isinstance(tech.schema, StructType)
    return tech.unionByName(soft).unionByName(rel)


@query("a18_attack_techniques", oracle="""
SELECT concat('T', p_partkey) AS technique_id, p_name AS name, p_type AS tactics FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0""")
def a18(spark, d):
    return R.attack_techniques(_objects(spark, d)).select("technique_id", "name", F.array_join("tactics", ",").alias("tactics"))


@query("a19_family_techniques", oracle="""
SELECT DISTINCT lower(s_name) AS family, concat('S', s_suppkey) AS attack_id, concat(CASE WHEN l_partkey % 13 = 0 THEN 'Q' ELSE 'T' END, l_partkey) AS technique
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'""")
def a19(spark, d):
    fam = table(spark, d, "supplier").select(F.lower("s_name").alias("family"), F.upper("s_name").alias("attack_name"))
    return R.family_techniques(_objects(spark, d), fam)


@query("a20_vendor_filter", oracle="""
WITH x AS (SELECT CASE p_size % 4 WHEN 0 THEN 'process_creation' WHEN 1 THEN 'builtin/system' WHEN 2 THEN 'builtin/system/netlogon' ELSE 'linux' END AS dir,
  CASE p_partkey % 5 WHEN 0 THEN 'stable' WHEN 1 THEN 'test' WHEN 2 THEN 'experimental' WHEN 3 THEN NULL ELSE 'Deprecated' END AS status, p_partkey % 17 = 0 AS corr FROM part)
SELECT CASE WHEN corr THEN 'correlation' WHEN lower(coalesce(status, 'test')) NOT IN ('stable', 'test') THEN 'status' ELSE 'kept' END AS reason, count(*) AS n
FROM x WHERE dir IN ('process_creation', 'builtin/system') GROUP BY 1""")
def a20(spark, d):
    k = F.col("p_partkey") % 5
    dir_ = F.when(F.col("p_size") % 4 == 0, "process_creation").when(F.col("p_size") % 4 == 1, "builtin/system").when(F.col("p_size") % 4 == 2, "builtin/system/netlogon").otherwise("linux")
    rules = table(spark, d, "part").select(
        F.concat(dir_, F.lit("/"), F.col("p_partkey"), F.lit(".yml")).alias("path"),
        F.when(k == 0, "stable").when(k == 1, "test").when(k == 2, "experimental").when(k == 4, "Deprecated").alias("status"), (F.col("p_partkey") % 17 == 0).alias("is_correlation"))
    return R.vendor_counts(R.vendor_filter(rules, ["process_creation", "builtin/system"], ["builtin/system/netlogon"]))


