"""Queries of SURVEY F1-F6, F10-F18, 2.L and 2.J."""

from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import adapter, query, table
from detectframe.catalog.scoring import alerts
from detectframe.functions.scalar import micros
from detectframe.operators import browse as B
from detectframe.operators import joins as J
from detectframe.operators import rollup as U
from detectframe.streaming import streams as S


@query("f1_event_histogram", using="tel", oracle="SELECT run_id, event_type, count(*) AS n FROM tel GROUP BY 1, 2")
def f1(spark, d):
    return U.event_histogram(adapter(spark, d, "tel"))


@query("f2_source_list", using="tel calls", oracle="SELECT DISTINCT run_id, source FROM (SELECT run_id, source FROM tel UNION ALL SELECT run_id, source FROM calls) x")
def f2(spark, d):
    return U.source_list(adapter(spark, d, "tel").select("run_id", "source").unionByName(adapter(spark, d, "calls").select("run_id", "source")))


@query("f2_type_groups", using="tel", oracle="""
SELECT run_id, count(*) FILTER (WHERE starts_with(event_type, 'Process')) AS process, count(*) FILTER (WHERE event_type IN ('NetworkConnect', 'DnsQuery')) AS network, CAST(0 AS bigint) AS logs FROM tel GROUP BY 1""")
def f2_groups(spark, d):
    return U.type_group_counts(adapter(spark, d, "tel"), {"process": "^Process", "network": "^(NetworkConnect|DnsQuery)$", "logs": "^(Security|System|Defender)"})


@query("f3_trace_summary", using="calls", oracle="""
SELECT run_id, ProcessId AS pid, min(seq) FILTER (WHERE Api = '__monitor_attached__') AS attached_seq, count(*) FILTER (WHERE Api NOT IN ('__monitor_attached__', '__event_cap_reached__')) AS calls, count(*) FILTER (WHERE Api = '__event_cap_reached__') AS cap_marks
FROM (SELECT run_id, seq, ProcessId, CASE WHEN Api = 'NtCreateTransaction' THEN '__monitor_attached__' ELSE Api END AS Api FROM calls) x GROUP BY 1, 2""")
def f3(spark, d):
    c = adapter(spark, d, "calls")
    return U.trace_summary(c.withColumn("Api", F.when(F.col("Api") == "NtCreateTransaction", "__monitor_attached__").otherwise(F.col("Api"))))


_TT = " ".join(f"WHEN '{t}' THEN '{','.join(x[0] for x in v)}'" for t, v in fixed.TYPE_TECHNIQUES.items())


@query("f4_coverage_matrix", using="tel alerts", oracle=f"""
WITH e AS (SELECT run_id, event_type, count(*) AS n FROM tel GROUP BY 1, 2), a AS (SELECT run_id, event_type, count(*) AS n FROM alerts GROUP BY 1, 2),
x AS (SELECT coalesce(e.run_id, a.run_id) AS run_id, coalesce(e.event_type, a.event_type) AS event_type, coalesce(e.n, 0) + coalesce(a.n, 0) AS count, CASE WHEN e.n IS NULL THEN 'alert' END AS source FROM e FULL JOIN a ON e.run_id = a.run_id AND e.event_type = a.event_type)
SELECT *, coalesce(CASE event_type {_TT} END, '') AS techniques FROM x UNION ALL SELECT concat('run', s_suppkey), 'capa (static capabilities)', s_nationkey, 'static', 'T1055' FROM supplier""")
def f4(spark, d):
    static = table(spark, d, "supplier").select(F.concat(F.lit("run"), "s_suppkey").alias("run_id"), F.col("s_nationkey").cast("bigint").alias("capability_count"), F.array(F.lit("T1055")).alias("attack"))
    m = U.coverage_matrix(adapter(spark, d, "tel"), alerts(spark, d), J.technique_map(spark), static)
    return m.withColumn("techniques", F.array_join("techniques", ","))


@query("f5_detections_fired", using="alerts", oracle="""
SELECT run_id, CASE WHEN rule_id IS NOT NULL THEN 'sigma' WHEN event_type = 'DmpYaraMatch' THEN 'yara' WHEN source = 'cape' THEN 'cape' WHEN source = 'apitrace' THEN 'behavioral' ELSE 'heuristic' END AS family,
  CASE WHEN rule_id IS NOT NULL THEN rule_id WHEN event_type = 'DmpYaraMatch' THEN concat(Rule, '@process dump') WHEN source = 'cape' THEN Name WHEN source = 'apitrace' THEN event_type ELSE coalesce(priority_reason, event_type) END AS label, count(*) AS n FROM alerts GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT concat('run', l_suppkey), 'yara', concat('r', l_linenumber, '@sample'), CAST(1 AS bigint) FROM lineitem WHERE l_quantity = 1""")
def f5(spark, d):
    st = table(spark, d, "lineitem").filter(F.col("l_quantity") == 1).select(F.concat(F.lit("run"), "l_suppkey").alias("run_id"), F.concat(F.lit("r"), "l_linenumber").alias("rule"))
    return U.detections_fired(alerts(spark, d), st)


@query("f6_alerts_per_process", using="alerts", oracle="SELECT run_id, CAST(ProcessId AS bigint) AS pid, count(*) AS n_alerts FROM alerts GROUP BY 1, 2")
def f6(spark, d):
    return U.alerts_per_process(alerts(spark, d))


_NAMES = ["inject thread", "read file", "packed with upx", "hash data", "keylog via hook"]


def _cap_docs(spark, d):
    """Each part as a result document with five capabilities."""
    s, k = F.col("p_size"), F.col("p_partkey")
    rules = []
    for i, name in enumerate(_NAMES):
        meta = F.struct((s % 7 == i).alias("is_subscope_rule"), F.lit(False).alias("lib"), F.array(F.struct(F.concat(F.lit("T"), F.when(s % 3 == i % 3, 1027).otherwise(2000 + i), F.lit(".001")).alias("id"), F.col("p_type").alias("tactic"))).alias("attack"))
        rules += [F.lit(name), F.struct(meta.alias("meta"), F.concat(F.lit("rule:\n  namespace: ns/"), k % 4, F.lit("\n  x: y")).alias("source"), F.array_repeat(F.lit("m"), (s % 5).cast("int")).alias("matches"))]
    return table(spark, d, "part").select(k.alias("run_id"), F.to_json(F.struct(F.create_map(*rules).alias("rules"))).alias("doc"))


_CAPS = """
cap AS (SELECT p_partkey AS run_id, n.name, concat('ns/', p_partkey % 4) AS namespace, concat('T', CASE WHEN p_size % 3 = n.i % 3 THEN 1027 ELSE 2000 + n.i END, '.001') AS tech, p_size % 5 AS match_count, n.i IN (0, 2, 4) OR p_size % 3 = n.i % 3 AS high_signal
FROM part, (VALUES (0, 'inject thread'), (1, 'read file'), (2, 'packed with upx'), (3, 'hash data'), (4, 'keylog via hook')) n(i, name) WHERE p_size % 7 <> n.i)"""


@query("f10_capabilities", oracle=f"WITH {_CAPS.strip()} SELECT run_id, name, namespace, tech, CAST(match_count AS bigint) AS match_count, high_signal FROM cap")
def f10(spark, d):
    c = U.capabilities(_cap_docs(spark, d))
    return c.select("run_id", "name", "namespace", F.array_join("attack", ",").alias("tech"), F.col("match_count").cast("bigint").alias("match_count"), "high_signal")


@query("f10_capability_summary", oracle=f"WITH {_CAPS.strip()} SELECT run_id, count(*) AS capability_count, count(*) FILTER (WHERE high_signal) AS high_signal_count, string_agg(DISTINCT tech, ',' ORDER BY tech) AS attack FROM cap GROUP BY 1")
def f10_summary(spark, d):
    return U.capability_summary(U.capabilities(_cap_docs(spark, d))).withColumn("attack", F.array_join("attack", ","))


@query("f11_script_blocks", oracle="""
SELECT conv_id, (turn) // 3 AS part, count(*) AS n_fragments, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text, coalesce((SELECT arg_min(c2.role, c2.turn) FROM conversations c2 WHERE c2.conv_id = c.conv_id AND c2.role <> 'system'), '') AS path FROM conversations c GROUP BY 1, 2""")
def f11(spark, d):
    """Turns as fragments of one script per conversation, parts of three fragments."""
    c = table(spark, d, "conversations").select(
        F.lit("r").alias("run_id"), F.col("conv_id").alias("block_id"), (F.col("turn") + 1).alias("number"), "text", F.when(F.col("role") != "system", F.col("role")).alias("path"), F.col("turn").alias("seq"))
    b = U.script_block_parts(c, 3)
    return b.select(F.col("block_id").alias("conv_id"), "part", F.col("n_fragments").cast("bigint").alias("n_fragments"), "text", "path")


@query("f11_script_blocks_whole", oracle="""
SELECT conv_id, count(*) AS n_fragments, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text, coalesce(arg_min(role, turn) FILTER (WHERE role <> 'system'), '') AS path FROM conversations GROUP BY 1""")
def f11_whole(spark, d):
    """One joined script per conversation."""
    c = table(spark, d, "conversations").select(
        F.lit("r").alias("run_id"), F.col("conv_id").alias("block_id"), (F.col("turn") + 1).alias("number"), "text", F.when(F.col("role") != "system", F.col("role")).alias("path"), F.col("turn").alias("seq"))
    return U.script_blocks(c).select(F.col("block_id").alias("conv_id"), F.col("n_fragments").cast("bigint").alias("n_fragments"), "text", "path")


@query("f13_iocs_registry", using="alerts", oracle="SELECT run_id, concat('key', k % 9) AS target_object, priority_reason FROM alerts WHERE event_type = 'RegistryValueSet' AND priority = 'high'")
def f13(spark, d):
    a = alerts(spark, d).withColumn("TargetObject", F.concat(F.lit("key"), F.col("k") % 9))
    return U.iocs_registry(a).select("run_id", "target_object", "priority_reason")


@query("f13_iocs_dropped", oracle="SELECT concat('r', doc_id % 7) AS run_id, concat('f', doc_id) AS filename, source AS original_path, sha256(text) AS sha256 FROM documents WHERE lang = 'en'")
def f13_dropped(spark, d):
    doc = table(spark, d, "documents").select(F.concat(F.lit("r"), F.col("doc_id") % 7).alias("run_id"), F.concat(F.lit("f"), "doc_id").alias("filename"), F.col("source").alias("original_path"), F.sha2("text", 256).alias("sha256"),
                                              F.when(F.col("lang") == "en", "retrieved").otherwise("failed").alias("status"))
    return U.iocs_dropped(doc)


@query("f14_packet_totals", using="packets", oracle="""
SELECT run_id, count(*) AS total_packets, CAST(sum(length) AS bigint) AS total_bytes, round((epoch_us(arg_max(ts, idx)) - epoch_us(arg_min(ts, idx))) / 1e6, 3) AS duration_s
FROM (SELECT run_id, idx, max(ts) AS ts, max(length) AS length FROM packets GROUP BY 1, 2) x GROUP BY 1""")
def f14(spark, d):
    return U.packet_totals(_packets(spark, d)).select("run_id", "total_packets", "total_bytes", "duration_s")


def _packets(spark, d):
    """Packets with a unique index (line keys can repeat)."""
    p = adapter(spark, d, "packets")
    return p.groupBy("run_id", "idx").agg(F.max("ts").alias("ts"), F.max("length").alias("length"))


@query("f14_protocol_counts", using="packets", oracle="SELECT run_id, protocol, count(*) AS n FROM packets GROUP BY 1, 2")
def f14_protocols(spark, d):
    return U.protocol_counts(adapter(spark, d, "packets"))


@query("f14_dns_counts", using="packets", oracle="SELECT run_id, dns_qname, count(*) AS n FROM packets WHERE dns_qname IS NOT NULL GROUP BY 1, 2")
def f14_dns(spark, d):
    return U.dns_counts(adapter(spark, d, "packets"))


@query("f14_http_counts", using="packets", oracle="SELECT run_id, http_method AS method, http_host AS host, http_path AS path, count(*) AS n FROM packets WHERE http_host IS NOT NULL GROUP BY 1, 2, 3, 4")
def f14_http(spark, d):
    return U.http_counts(adapter(spark, d, "packets"))


_CONV = """
conv AS (SELECT run_id, protocol, least(x, y) AS a, greatest(x, y) AS b, CAST(sum(length) AS bigint) AS bytes, count(*) AS packets FROM (SELECT *, concat(src, coalesce(concat(':', nullif(CAST(sport AS varchar), '')), '')) AS x, concat(dst, coalesce(concat(':', nullif(CAST(dport AS varchar), '')), '')) AS y FROM
  (SELECT run_id, protocol, length, src, dst, sport, dport FROM packets) q) z GROUP BY 1, 2, 3, 4)"""
_CONV = _CONV.replace("concat(src, coalesce(concat(':', nullif(CAST(sport AS varchar), '')), ''))", "CASE WHEN sport IS NULL THEN src ELSE concat(src, ':', sport) END").replace(
    "concat(dst, coalesce(concat(':', nullif(CAST(dport AS varchar), '')), ''))", "CASE WHEN dport IS NULL THEN dst ELSE concat(dst, ':', dport) END")


@query("f15_conversations", using="packets", oracle=f"WITH {_CONV.strip()} SELECT * FROM conv")
def f15(spark, d):
    return U.conversations(adapter(spark, d, "packets"))


@query("f15_top_conversations", using="packets", oracle=f"""
WITH {_CONV.strip()} SELECT run_id, protocol, a, b, bytes, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY bytes DESC, protocol, a, b) AS rank FROM conv) x WHERE rank <= 10""")
def f15_top(spark, d):
    t = U.top_per_run(U.conversations(adapter(spark, d, "packets")), [F.desc("bytes"), "protocol", "a", "b"], 10)
    return t.select("run_id", "protocol", "a", "b", "bytes", F.col("rank").cast("bigint").alias("rank"))


_BASE = """
now AS (SELECT run_id, 'total_events' AS metric, count(*) AS v FROM tel GROUP BY 1 UNION ALL SELECT run_id, 'alert_count', count(*) FROM tel WHERE event_type = 'NetworkConnect' GROUP BY 1 UNION ALL SELECT run_id, concat('type:', event_type), count(*) FROM tel GROUP BY 1, event_type)"""


@query("f16_baseline_counts", using="tel", oracle=f"WITH {_BASE.strip()} SELECT run_id, metric, v AS value FROM now")
def f16(spark, d):
    t = adapter(spark, d, "tel")
    return U.baseline_counts(t, t.filter(F.col("event_type") == "NetworkConnect"))


@query("f16_baseline_drift", using="tel", oracle=f"""
WITH {_BASE.strip()}, saved AS (SELECT run_id, 'total_events' AS metric, count(*) AS v FROM tel WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1 UNION ALL SELECT run_id, concat('type:', event_type), count(*) FROM tel WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, event_type UNION ALL SELECT 'gone', 'total_events', count(*) FROM nation)
SELECT coalesce(n.run_id, s.run_id) AS run_id, coalesce(n.metric, s.metric) AS metric, coalesce(s.v, 0) AS baseline, coalesce(n.v, 0) AS current, coalesce(n.v, 0) - coalesce(s.v, 0) AS delta FROM now n FULL JOIN saved s ON n.run_id = s.run_id AND n.metric = s.metric""")
def f16_drift(spark, d):
    t = adapter(spark, d, "tel")
    old = t.filter(F.col("ts") < "2024-01-16 00:00:00")
    gone = table(spark, d, "nation").agg(F.count("*").alias("value")).select(F.lit("gone").alias("run_id"), F.lit("total_events").alias("metric"), "value")
    saved = U.baseline_counts(old, old.filter(F.lit(False))).unionByName(gone)
    return U.baseline_drift(U.baseline_counts(t, t.filter(F.col("event_type") == "NetworkConnect")), saved)


@query("f17_process_profile", using="tel", oracle="""
WITH x AS (SELECT run_id, ProcessId AS pid, seq, CASE event_type WHEN 'NetworkConnect' THEN 'network' WHEN 'FileCreate' THEN 'file' ELSE 'process' END AS kind, CASE event_type WHEN 'NetworkConnect' THEN DestinationIp WHEN 'FileCreate' THEN TargetFilename ELSE CommandLine END AS fact FROM tel WHERE event_type IN ('NetworkConnect', 'FileCreate', 'ProcessCreate'))
SELECT run_id, pid, kind, fact, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pid, kind ORDER BY seq) AS pos FROM x) y WHERE pos <= 10""")
def f17(spark, d):
    kinds = {"NetworkConnect": ("network", "DestinationIp"), "FileCreate": ("file", "TargetFilename"), "ProcessCreate": ("process", "CommandLine")}
    return U.per_process_profile(adapter(spark, d, "tel"), kinds).withColumn("pos", F.col("pos").cast("bigint"))


@query("f18_hook_inventory", oracle="""
WITH h AS (SELECT p_name AS api, coalesce(nullif(CASE WHEN p_size % 6 = 0 THEN '' ELSE p_type END, ''), 'misc') AS category FROM part), c AS (SELECT p_type AS category, min(p_size) AS ord FROM part WHERE p_type <> 'SMALL' GROUP BY 1)
SELECT h.category, CAST(coalesce(c.ord, 99) AS bigint) AS ord, count(*) AS n_hooks FROM h LEFT JOIN c ON h.category = c.category GROUP BY 1, 2""")
def f18(spark, d):
    p = table(spark, d, "part")
    hooks = p.select(F.col("p_name").alias("api"), F.when(F.col("p_size") % 6 == 0, "").otherwise(F.col("p_type")).alias("category"))
    cats = p.filter(F.col("p_type") != "SMALL").groupBy(F.col("p_type").alias("category")).agg(F.min("p_size").alias("order")).withColumn("description", F.lit("about"))
    return U.hook_categories(U.hook_inventory(hooks, cats)).select("category", F.col("order").cast("bigint").alias("ord"), "n_hooks")


_HALF = "2024-01-16 00:00:00"


def _halves(spark, d):
    t = adapter(spark, d, "tel").withColumn("event_id", F.when(F.col("k") == 3, F.col("event_id") + 100).otherwise(F.col("event_id")))
    old, new = t.filter(F.col("ts") < _HALF), t.filter(F.col("ts") >= _HALF)
    return old.filter(F.col("event_type") != "FileCreate"), new.filter((F.col("event_type") != "ProcessTerminate"))


@query("l1_compare_runs", using="tel", oracle=f"""
WITH o AS (SELECT event_type, count(*) AS n FROM tel WHERE ts < TIMESTAMP '{_HALF}' AND event_type <> 'FileCreate' GROUP BY 1), n AS (SELECT event_type, count(*) AS n FROM tel WHERE ts >= TIMESTAMP '{_HALF}' AND event_type <> 'ProcessTerminate' GROUP BY 1)
SELECT coalesce(o.event_type, n.event_type) AS event_type, coalesce(o.n, 0) AS old, coalesce(n.n, 0) AS new, coalesce(n.n, 0) - coalesce(o.n, 0) AS delta FROM o FULL JOIN n ON o.event_type = n.event_type""")
def l1(spark, d):
    return U.compare_runs(*_halves(spark, d))


@query("l2_appeared", using="tel", oracle=f"""
WITH t AS (SELECT *, CASE WHEN k = 3 THEN event_id + 100 ELSE event_id END AS eid FROM tel), o AS (SELECT DISTINCT eid FROM t WHERE ts < TIMESTAMP '{_HALF}' AND event_type <> 'FileCreate')
SELECT DISTINCT CAST(eid AS bigint) AS event_id, Image AS image FROM t WHERE ts >= TIMESTAMP '{_HALF}' AND event_type <> 'ProcessTerminate' AND eid NOT IN (SELECT eid FROM o)""")
def l2(spark, d):
    return U.appeared(*_halves(spark, d)).select(F.col("event_id").cast("bigint").alias("event_id"), "image")


@query("l2_disappeared", using="tel", oracle=f"""
WITH t AS (SELECT *, CASE WHEN k = 3 THEN event_id + 100 ELSE event_id END AS eid FROM tel), n AS (SELECT DISTINCT eid FROM t WHERE ts >= TIMESTAMP '{_HALF}' AND event_type <> 'ProcessTerminate')
SELECT DISTINCT CAST(eid AS bigint) AS event_id, Image AS image FROM t WHERE ts < TIMESTAMP '{_HALF}' AND event_type <> 'FileCreate' AND eid NOT IN (SELECT eid FROM n)""")
def l2_gone(spark, d):
    old, new = _halves(spark, d)
    return U.appeared(new, old).select(F.col("event_id").cast("bigint").alias("event_id"), "image")


@query("l3_iocs_domains", using="dns packets", oracle="""
SELECT run_id, QueryName AS domain FROM dns WHERE QueryName <> '' UNION SELECT run_id, dns_qname FROM packets WHERE dns_qname <> ''""")
def l3(spark, d):
    return U.iocs_domains(adapter(spark, d, "dns"), adapter(spark, d, "packets"))


def _map_rows(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    api = F.concat(F.lit("api"), k)
    hooks = p.filter(k % 10 != 0).select(api.alias("api"), F.col("p_brand").alias("hook_module"))
    entries = p.filter(k % 11 != 0).select(
        api.alias("api"), F.when(k % 13 == 0, "other").otherwise(F.col("p_brand")).alias("hook_module"), F.when(k % 7 == 0, "hook_only").when(k % 17 == 0, "maybe").otherwise("both").alias("coverage"),
        F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((k % 40).cast("int"), F.lit(100))).alias("counterparts"))
    enabled = table(spark, d, "nation").select(F.col("n_nationkey").alias("event_id")).unionByName(table(spark, d, "nation").select(F.lit(100).alias("event_id"))).distinct()
    return hooks, entries, enabled


_MAP = """
h AS (SELECT concat('api', p_partkey) AS api, p_partkey AS k FROM part WHERE p_partkey % 10 <> 0), e AS (SELECT concat('api', p_partkey) AS api, p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'hook_only' WHEN p_partkey % 17 = 0 THEN 'maybe' ELSE 'both' END AS coverage FROM part WHERE p_partkey % 11 <> 0)"""


@query("l4_validate_map", oracle=f"""
WITH {_MAP.strip()} SELECT api, 'no map entry' AS error FROM h WHERE k % 11 = 0 UNION ALL SELECT api, 'names no real hook' FROM e WHERE k % 10 = 0 UNION ALL SELECT api, 'hook_module differs' FROM e WHERE k % 10 <> 0 AND k % 13 = 0
UNION ALL SELECT api, 'coverage must be both or hook_only' FROM e WHERE coverage = 'maybe' UNION ALL SELECT api, 'both without counterparts' FROM e WHERE coverage = 'both' AND k % 5 = 0
UNION ALL SELECT api, 'hook_only with counterparts' FROM e WHERE coverage = 'hook_only' AND k % 5 <> 0 UNION ALL SELECT api, concat('counterpart not enabled: ', k % 40) FROM e WHERE k % 5 <> 0 AND k % 40 >= 25""")
def l4(spark, d):
    return U.validate_map(*_map_rows(spark, d))


@query("l5_invert_map", oracle=f"""
WITH {_MAP.strip()} SELECT k % 40 AS event_id, api FROM e WHERE coverage = 'both' AND k % 5 <> 0 UNION ALL SELECT 100, api FROM e WHERE coverage = 'both' AND k % 5 <> 0""")
def l5(spark, d):
    return U.invert_map(_map_rows(spark, d)[1]).select(F.col("event_id").cast("bigint").alias("event_id"), "api")


@query("l5_one_sided_ids", oracle=f"""
WITH {_MAP.strip()} SELECT CAST(n_nationkey AS bigint) AS event_id FROM nation WHERE n_nationkey NOT IN (SELECT k % 40 FROM e WHERE coverage = 'both' AND k % 5 <> 0)""")
def l5_one(spark, d):
    _, entries, enabled = _map_rows(spark, d)
    return U.one_sided_ids(enabled, entries).select(F.col("event_id").cast("bigint").alias("event_id"))


# ------------------------------------------------------------------ 2.J


@query("j1_page_events", using="tel", oracle="""
SELECT seq, event_type FROM tel WHERE event_type IN ('FileCreate', 'ImageLoad') AND source IN ('sysmon', 'x') AND contains(lower(concat(Image, '|', TargetFilename)), 'app3.exe') ORDER BY seq LIMIT 50 OFFSET 20""")
def j1(spark, d):
    t = adapter(spark, d, "tel").select("seq", "source", "event_type", "Image", "TargetFilename")
    return B.page_events(t, 20, 50, " FileCreate, ImageLoad,", "sysmon,x", "APP3.exe").select("seq", "event_type")


@query("j1_page_totals", using="tel", oracle="SELECT count(*) AS total, count(*) FILTER (WHERE k % 9 = 3 OR CommandLine LIKE '%app3.exe%') AS filtered_total FROM tel")
def j1_totals(spark, d):
    t = adapter(spark, d, "tel").select("seq", "source", "event_type", "Image", "CommandLine")
    return B.page_totals(t, B.filter_events(t, q="app3.EXE"))


@query("j2_page_alerts", using="alerts", oracle="SELECT seq, event_type FROM alerts WHERE coalesce(in_scope, true) AND event_type = 'DnsQuery' ORDER BY seq LIMIT 40 OFFSET 10")
def j2(spark, d):
    return B.page_alerts(alerts(spark, d), 10, 40, "sample", "DnsQuery").select("seq", "event_type")


@query("j3_page_packets", using="packets", oracle="""
SELECT DISTINCT idx, src, dst FROM (SELECT idx, src, dst, run_id FROM packets WHERE protocol = 'TCP' AND (src = '10.0.0.7' OR dst = '10.0.0.7') AND (sport = 1 OR dport = 1) AND contains(lower(summary), 'f 7')) x""")
def j3(spark, d):
    p = B.filter_packets(adapter(spark, d, "packets"), "TCP", "10.0.0.7", 1, "F 7")
    return p.select("idx", "src", "dst").distinct()


@query("j3_page", using="packets", oracle="""
SELECT run_id, idx, src, dst, length FROM packets WHERE protocol = 'TCP' AND (src = '10.0.0.7' OR dst = '10.0.0.7') ORDER BY run_id, idx, ts, src, dst, sport, dport, length, summary LIMIT 60 OFFSET 25""")
def j3_page(spark, d):
    """The page itself: sixty packets of one address after the first twenty-five."""
    return B.page_packets(adapter(spark, d, "packets"), 25, 60, "TCP", "10.0.0.7").select("run_id", "idx", "src", "dst", "length")


@query("j3_packet_totals", using="packets", oracle="SELECT count(*) AS total, count(*) FILTER (WHERE protocol = 'DNS' AND contains(dns_qname, 'h7.')) AS filtered_total, true AS filtered_total_is_exact FROM packets")
def j3_totals(spark, d):
    p = adapter(spark, d, "packets")
    return B.packet_totals_exact(p, B.filter_packets(p, "DNS", q="H7."))


@query("j4_trim_run", using="alerts tel", oracle="""
SELECT t.run_id, a.kept AS alerts_kept, a.env AS environment_alerts_total, t.n AS events_total FROM (SELECT run_id, count(*) AS n FROM tel GROUP BY 1) t FULL JOIN (SELECT run_id, count(*) FILTER (WHERE coalesce(in_scope, true)) AS kept, count(*) FILTER (WHERE NOT coalesce(in_scope, true)) AS env FROM alerts WHERE run_id IN (SELECT run_id FROM tel) GROUP BY 1) a ON t.run_id = a.run_id""")
def j4(spark, d):
    t = adapter(spark, d, "tel")
    return B.trim_counts(alerts(spark, d).join(t.select("run_id").distinct(), "run_id", "left_semi"), t)


@query("j4_trim_alerts", using="alerts", oracle="SELECT seq FROM alerts WHERE in_scope IS NULL OR in_scope")
def j4_alerts(spark, d):
    return B.trim_alerts(alerts(spark, d)).select("seq")


@query("j5_list_runs", using="runs", oracle="""
SELECT run_id, epoch_us(ts) AS us FROM runs WHERE ts >= TIMESTAMP '1997-01-01 00:00:00' AND status = 'completed' AND level = 'malicious' AND contains(lower(concat(filename, ' ', left(sha256, 12), ' ', run_id)), 'file12') ORDER BY ts DESC NULLS LAST, run_id LIMIT 100""")
def j5(spark, d):
    r = adapter(spark, d, "runs").withColumn("sha256_short", F.substring("sha256", 1, 12)).withColumn("verdict_level", F.col("level"))
    return B.list_runs(r, 100, "1997-01-01 00:00:00", "FILE12", "completed", "malicious").select("run_id", micros(F.col("ts")).alias("us"))


@query("j6_top_destinations", using="tel", oracle="""
SELECT run_id, DestinationIp AS ip, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, DestinationIp) AS rank FROM (SELECT run_id, DestinationIp, count(*) AS n FROM tel WHERE event_type = 'NetworkConnect' GROUP BY 1, 2) x) y WHERE rank <= 5""")
def j6(spark, d):
    c = adapter(spark, d, "tel").filter(F.col("event_type") == "NetworkConnect").groupBy("run_id", F.col("DestinationIp").alias("ip")).agg(F.count("*").alias("n"))
    return U.top_per_run(c, [F.desc("n"), "ip"], 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("m2_cursor_read", oracle="SELECT event_id AS seq, user_id FROM events WHERE event_id >= 300 AND contains(props, '42') ORDER BY event_id LIMIT 25")
def m2(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "props")
    # the needle is looked for in the payload's own text
    return S.cursor_read(e.filter(F.col("props").contains("42")), 300, 25).select("seq", "user_id")


@query("m2_cursor_next", oracle="""
WITH p AS (SELECT event_id FROM events WHERE event_id >= 300 AND event_type = 'view' ORDER BY event_id LIMIT 25) SELECT max(event_id) + 1 AS next_offset, count(*) AS returned FROM p""")
def m2_next(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type")
    return S.cursor_next(e, 300, 25, '"event_type":"view"')


