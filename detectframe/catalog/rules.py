"""Queries of SURVEY 2.C and the flagship."""

from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import adapter, query, table
from detectframe.functions.scalar import micros
from detectframe.operators import rules as R
from detectframe.operators import scoring as S
from detectframe.operators.joins import enrich_techniques, technique_map

# A small rule set of our own over the telemetry adapter; every leaf kind occurs.
RULES = [
    {"id": "r-ports", "title": "High port", "level": "high", "status": "test", "tags": ["attack.t1071", "attack.command-and-control"],
     "logsource": {"category": "network_connection"}, "detection": {"sel": {"DestinationPort|gte": 1090}, "flt": {"Initiated": "false"}, "condition": "sel and not flt"}},
    {"id": "r-net", "title": "Internal range", "level": "medium", "status": "stable", "tags": ["attack.t1046"],
     "logsource": {"category": "network_connection"}, "detection": {"sel": {"DestinationIp|cidr": "10.2.0.0/16"}, "opt": {"Image|endswith": ["\\APP1.exe", "\\app2.exe"]}, "condition": "sel and opt"}},
    {"id": "r-cmd", "title": "Command words", "level": "critical", "status": "test", "tags": ["attack.t1059.001", "attack.execution"],
     "logsource": {"category": "process_creation"}, "detection": {"sel": {"CommandLine|contains|all": ["-run 7", "/Q"]}, "condition": "sel"}},
    {"id": "r-re", "title": "Two digits alike", "level": "medium", "status": "test", "tags": ["attack.t1059"],
     "logsource": {"category": "process_creation"}, "detection": {"sel_a": {"CommandLine|re": "-run (11|22|33) "}, "sel_b": {"CommandLine|re|i": "APP0\\.EXE -RUN 9"}, "condition": "1 of sel_*"}},
    {"id": "r-load", "title": "Unsigned load", "level": "low", "status": "test", "tags": ["attack.t1129"],
     "logsource": {"category": "image_load"}, "detection": {"sel": {"Signed": "false"}, "empty": {"ImageLoaded": None}, "condition": "sel and not empty"}},
    {"id": "r-file", "title": "Document write", "level": "medium", "status": "test", "tags": ["attack.t1486"],
     "logsource": {"category": "file_event"}, "detection": {"sel": {"TargetFilename|startswith": "c:\\users\\u1", "TargetFilename|endswith": "5.TXT"}, "condition": "all of sel*"}},
    {"id": "r-svc", "title": "Listed ids", "level": "high", "status": "test", "tags": [],
     "logsource": {"service": "sysmon"}, "detection": {"sel": {"EventID": [1, 5], "Level": 13}, "condition": "sel"}},
    {"id": "r-ref", "title": "Own parent", "level": "informational", "status": "test", "tags": [],
     "logsource": {"service": "sysmon"}, "detection": {"sel": {"ProcessId|fieldref": "ParentProcessId"}, "ex": {"Initiated|exists": False}, "condition": "sel and ex"}},
    {"id": "r-never", "title": "Never", "level": "high", "status": "test", "tags": ["attack.t1003"],
     "logsource": {"category": "process_creation"}, "detection": {"sel": {"CommandLine|contains": "no such text"}, "condition": "sel"}},
    {"id": "r-key", "title": "Keyword", "level": "high", "status": "test", "tags": [],
     "logsource": {"category": "file_event"}, "detection": {"words": ["*\\doc77.txt"], "condition": "words"}},
    {"id": "r-bad", "title": "Broken", "level": "high", "status": "test", "tags": [],
     "logsource": {"category": "process_creation"}, "detection": {"sel": {"CommandLine|nosuch": "x"}, "condition": "sel"}},
    {"id": "r-base", "name": "base", "title": "Any write", "level": "low", "status": "test", "tags": [],
     "logsource": {"category": "file_event"}, "detection": {"sel": {"TargetFilename|contains": "\\doc"}, "typ": {"EventID": 11}, "condition": "sel and typ"}},
    {"id": "r-mass", "title": "Mass write", "level": "high", "status": "test", "tags": ["attack.t1485"],
     "correlation": {"type": "event_count", "rules": ["base"], "group-by": ["ProcessId"], "timespan": "1d", "condition": {"gte": 3}}},
    {"id": "r-time", "title": "Other kind", "level": "high", "correlation": {"type": "temporal", "rules": ["base"], "timespan": "1d"}},
]

# the same rules, written by hand for the oracle
MATCHES = """
matches AS (
  SELECT run_id, seq, event_type, event_id, ts, ProcessId, ProcessGuid, r.rule_id FROM tel, (VALUES ('r-ports'), ('r-net'), ('r-cmd'), ('r-re'), ('r-load'), ('r-file'), ('r-svc'), ('r-ref'), ('r-key')) r(rule_id)
  WHERE CASE r.rule_id
    WHEN 'r-ports' THEN event_type = 'NetworkConnect' AND k >= 90 AND coalesce(Initiated, '') <> 'false'
    WHEN 'r-net' THEN event_type = 'NetworkConnect' AND DestinationIp LIKE '10.2.%' AND k % 9 IN (1, 2)
    WHEN 'r-cmd' THEN event_type = 'ProcessCreate' AND (k = 7 OR k BETWEEN 70 AND 79)
    WHEN 'r-re' THEN event_type = 'ProcessCreate' AND (k IN (11, 22, 33) OR (k % 9 = 0 AND (k = 9 OR k BETWEEN 90 AND 99)))
    WHEN 'r-load' THEN event_type = 'ImageLoad' AND k % 3 = 0 AND k % 4 <> 1
    WHEN 'r-file' THEN event_type = 'FileCreate' AND k % 6 <> 0 AND regexp_matches(lower(TargetFilename), 'users.u1') AND k % 10 = 5
    WHEN 'r-svc' THEN event_id IN (1, 5) AND k = 13
    WHEN 'r-ref' THEN ProcessId = ParentProcessId AND Initiated IS NULL
    WHEN 'r-key' THEN event_type = 'FileCreate' AND k = 77 END)"""


def ruleset(min_level="informational"):
    return R.compile_rules(RULES, min_level)


KEEP = ["run_id", "seq", "event_type", "event_id", "ts", "ProcessId", "ProcessGuid"]


@query("c1_compile_rules", using="tel", oracle="""
WITH m(rule_id, error) AS (VALUES ('r-bad', true), ('r-ports', false), ('r-net', false), ('r-cmd', false), ('r-re', false), ('r-load', false), ('r-file', false), ('r-svc', false), ('r-ref', false), ('r-never', false), ('r-key', false), ('r-mass', false))
SELECT m.rule_id, m.error, t.n_events FROM m, (SELECT count(*) AS n_events FROM tel) t""")
def c1(spark, d):
    rs = ruleset()
    rows = [(i, True) for i, _ in rs.errors] + [(r.rule_id, False) for r in rs.rules] + [(c["rule"]["id"], False) for c in rs.correlations]
    n = adapter(spark, d, "tel").agg(F.count("*").alias("n_events"))
    found = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(bad).alias("error")) for i, bad in rows])
    return n.select("n_events", F.explode(found).alias("x")).select("x.rule_id", "x.error", "n_events")


@query("c2_active_rules", using="tel", oracle=f"""
WITH {MATCHES.strip()} SELECT rule_id, count(*) AS hits FROM matches WHERE rule_id IN ('r-ports', 'r-cmd', 'r-key', 'r-net', 'r-re', 'r-file') AND rule_id NOT IN ('r-ports') GROUP BY 1""")
def c2(spark, d):
    """Level floor medium, one service and one id excluded."""
    rs = R.compile_rules(RULES, "medium", excluded=("sysmon",), disabled=("r-ports",))
    return R.apply_rules(adapter(spark, d, "tel"), rs, keep=["seq"]).groupBy("rule_id").agg(F.count("*").alias("hits"))


@query("c3_dispatch", using="tel", oracle=f"""
WITH {MATCHES.strip()} SELECT event_type, count(DISTINCT rule_id) AS n_rules, count(*) AS hits FROM matches GROUP BY 1""")
def c3(spark, d):
    m = R.apply_rules(adapter(spark, d, "tel"), ruleset(), keep=["event_type"])
    g = m.groupBy("event_type", "rule_id").agg(F.count("*").alias("c"))
    return g.groupBy("event_type").agg(F.count("*").alias("n_rules"), F.sum("c").alias("hits"))


@query("c4_static_event_ids", using="tel", oracle="""
SELECT 'r-svc' AS rule_id, count(*) FILTER (WHERE event_id IN (1, 5)) AS candidates, count(*) AS all_events FROM tel""")
def c4(spark, d):
    rs = {r.rule_id: r for r in ruleset().rules}
    ids = sorted(rs["r-svc"].event_ids)
    return adapter(spark, d, "tel").agg(F.lit("r-svc").alias("rule_id"), F.count_if(F.col("event_id").isin(ids)).alias("candidates"), F.count("*").alias("all_events")).select("rule_id", "candidates", "all_events")


@query("c5_prefilter", using="tel", oracle=f"""
WITH {MATCHES.strip()} SELECT rule_id, count(*) AS hits, count(*) AS unfiltered FROM matches GROUP BY 1""")
def c5(spark, d):
    """Matches with and without the literal prefilter are the same."""
    t = adapter(spark, d, "tel")
    on = R.apply_rules(t, ruleset(), True, keep=["seq"]).select("seq", "rule_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    off = R.apply_rules(t, ruleset(), False, keep=["seq"]).select("seq", "rule_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return on.unionByName(off).groupBy("rule_id").agg(F.sum("a").alias("hits"), F.sum("b").alias("unfiltered"))


@query("c6_apply_rules", using="tel", oracle=f"WITH {MATCHES.strip()} SELECT run_id, seq, rule_id FROM matches")
def c6(spark, d):
    return R.apply_rules(adapter(spark, d, "tel"), ruleset(), keep=["run_id", "seq"])


#: Rules of the wide set: as many as a full public rule corpus has active.
WIDE = 1859


def wide_rule(i: int) -> dict:
    """Rule ``i`` of the wide set: five kinds over five event types, their values drawn from ``i``."""
    a, b, c, d, e = i % 9, (i // 5 + 4) % 9, i % 101, (7 * i + 3) % 101, i % 20
    none = {"CommandLine|contains": [f" /{x}{i}" for x in "xyz"]}
    detection = [
        {"sel_img": {"Image|endswith": [f"\\APP{a}.exe", f"\\app{b}.exe"]}, "sel_cmd": {"CommandLine|contains": [f"-run {c} ", f"-run {d} "]}, "flt": none,
         "condition": "all of sel_* and not flt"},
        {"sel": {"TargetFilename|startswith": f"C:\\Users\\u{e}\\", "TargetFilename|endswith": [f"\\doc{c}.txt", f"\\doc{d}.TXT", f"\\doc{c}x.txt"]}, "condition": "sel"},
        {"net": {"DestinationIp|cidr": f"10.{i % 3}.0.0/16"}, "port": {"DestinationPort": [1000 + c, 1000 + d]}, "off": {"Initiated": "false"}, "condition": "net and port and not off"},
        {"sel": {"ImageLoaded|re": "^D:.Temp.x[.]dll$" if i % 2 else "System32"}, "lvl": {"Level|gte": c, "Level|lt": c + 2}, "sig": {"Signed|contains": "true"}, "condition": "sel and lvl and not sig"},
        {"id": {"EventID": 5}, "sel_a": {"Image|contains": [f"System32\\app{a}."], "CommandLine|contains|all": ["-run", f"{c} /q"]}, "sel_b": {"CommandLine|startswith": f"app{b}.exe -run {d}", "Image|endswith": ".exe"},
         "condition": "id and 1 of sel_*"},
    ][i % 5]
    source = [{"category": "process_creation"}, {"category": "file_event"}, {"category": "network_connection"}, {"category": "image_load"}, {"service": "sysmon"}][i % 5]
    return {"id": f"w{i}", "title": f"Wide {i}", "level": "high", "status": "test", "tags": [], "logsource": source, "detection": detection}


@query("c6_apply_rules_wide", using="tel", oracle=f"""
WITH r AS (SELECT i, i % 9 AS a, (i // 5 + 4) % 9 AS b, i % 101 AS c, (7 * i + 3) % 101 AS d, i % 20 AS e FROM range({WIDE}) x(i))
SELECT run_id, seq, concat('w', i) AS rule_id FROM tel JOIN r ON i % 5 = CASE event_type WHEN 'ProcessCreate' THEN 0 WHEN 'FileCreate' THEN 1 WHEN 'NetworkConnect' THEN 2 WHEN 'ImageLoad' THEN 3 ELSE 4 END
WHERE CASE i % 5 WHEN 0 THEN k % 9 IN (a, b) AND k IN (c, d)
  WHEN 1 THEN contains(TargetFilename, concat('Users', chr(92), 'u', e, chr(92))) AND k IN (c, d)
  WHEN 2 THEN k % 3 = i % 3 AND k IN (c, d) AND coalesce(Initiated, '') <> 'false'
  WHEN 3 THEN (CASE WHEN i % 2 = 1 THEN k % 4 = 0 ELSE k % 4 IN (2, 3) END) AND k IN (c, c + 1) AND k % 3 = 0
  ELSE (k % 9 = a AND (k = c OR ends_with(CAST(k AS varchar), CAST(c AS varchar)))) OR (k % 9 = b AND starts_with(CAST(k AS varchar), CAST(d AS varchar))) END""")
def c6_wide(spark, d):
    rs = R.compile_rules([wide_rule(i) for i in range(WIDE)])
    return R.apply_rules(adapter(spark, d, "tel"), rs, keep=["run_id", "seq"])


@query("c7_build_alert", using="tel", oracle=f"""
WITH {MATCHES.strip()} SELECT seq, rule_id, CASE rule_id WHEN 'r-ports' THEN 'High port' WHEN 'r-net' THEN 'Internal range' WHEN 'r-cmd' THEN 'Command words' WHEN 'r-re' THEN 'Two digits alike' WHEN 'r-load' THEN 'Unsigned load' WHEN 'r-file' THEN 'Document write' WHEN 'r-svc' THEN 'Listed ids' WHEN 'r-ref' THEN 'Own parent' ELSE 'Keyword' END AS title,
  CASE WHEN rule_id IN ('r-ports', 'r-svc', 'r-key') THEN 'high' WHEN rule_id IN ('r-net', 'r-re', 'r-file') THEN 'medium' WHEN rule_id = 'r-cmd' THEN 'critical' WHEN rule_id = 'r-load' THEN 'low' ELSE 'informational' END AS level,
  'sigma' AS source, 'sysmon' AS event_source, event_type FROM matches""")
def c7(spark, d):
    rs = ruleset()
    m = R.apply_rules(adapter(spark, d, "tel"), rs, keep=[*KEEP, "source"])
    return R.build_alert(m, R.rule_table(spark, rs)).select("seq", "rule_id", "title", "level", "source", "event_source", "event_type")


@query("c8_techniques_from_tags", oracle="""
WITH x AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN concat('attack.t', 1000 + p_size) WHEN 1 THEN concat('Attack.T', 1000 + p_size, '.00', p_size % 10) WHEN 2 THEN 'attack.execution' WHEN 3 THEN concat('cve.t', 1000 + p_size) ELSE concat('attack.t', p_size) END AS tag FROM part)
SELECT p_partkey, upper(regexp_extract(tag, '(?i)^attack\\.(t\\d{4}(\\.\\d{3})?)$', 1)) AS technique FROM x WHERE regexp_matches(tag, '(?i)^attack\\.(t\\d{4}(\\.\\d{3})?)$')""")
def c8(spark, d):
    s = F.col("p_size")
    m = s % 5
    tag = F.when(m == 0, F.concat(F.lit("attack.t"), 1000 + s)).when(m == 1, F.concat(F.lit("Attack.T"), 1000 + s, F.lit(".00"), s % 10)).when(m == 2, "attack.execution").when(
        m == 3, F.concat(F.lit("cve.t"), 1000 + s)).otherwise(F.concat(F.lit("attack.t"), s))
    return table(spark, d, "part").select("p_partkey", F.explode(R.techniques_from_tags(F.array(F.lit("x"), tag))).alias("technique"))


_DENSE = """
dense AS (SELECT run_id, ProcessId, ts, count(*) OVER (PARTITION BY run_id, ProcessId ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS c
  FROM tel WHERE event_type = 'FileCreate')"""


@query("c9_event_count", using="tel", oracle=f"""
WITH {_DENSE.strip()} SELECT run_id, ProcessId AS pid, max(c) AS matched_events, epoch_us(max(ts)) AS latest_us FROM dense GROUP BY 1, 2 HAVING max(c) >= 3""")
def c9(spark, d):
    """Mass writes: three or more document writes of one process within a day (no GUID grouping: each row has its own)."""
    t = adapter(spark, d, "tel").drop("ProcessGuid")
    c = ruleset().correlations[0]
    g = R.event_count(t, c["trees"], c["group_by"], c["seconds"], c["op"], c["count"])
    return g.select("run_id", F.col("group_0").alias("pid"), "matched_events", micros(F.col("latest")).alias("latest_us"))


@query("c9_event_count_ops", using="tel", oracle=f"""
WITH {_DENSE.strip()}, g AS (SELECT run_id, ProcessId, max(c) AS c FROM dense GROUP BY 1, 2)
SELECT op, count(*) AS n FROM g, (VALUES ('gt'), ('lt'), ('lte'), ('eq')) o(op) WHERE CASE op WHEN 'gt' THEN c > 3 WHEN 'lt' THEN c < 3 WHEN 'lte' THEN c <= 3 ELSE c = 3 END GROUP BY 1""")
def c9_ops(spark, d):
    t = adapter(spark, d, "tel").drop("ProcessGuid")
    hit = F.col("event_type") == "FileCreate"
    out = None
    for op in ("gt", "lt", "lte", "eq"):
        one = R.event_count(t, hit, ["ProcessId"], 86400, op, 3).agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("n") > 0)


CORRELATIONS = [
    {"id": "c-write", "name": "w", "level": "low", "logsource": {"category": "file_event"}, "detection": {"sel": {"TargetFilename|contains": "\\doc", "EventID": 11}, "condition": "sel"}},
    {"id": "c-net", "name": "n", "level": "low", "logsource": {"category": "network_connection"}, "detection": {"sel": {"DestinationIp|cidr": "10.2.0.0/16", "EventID": 3}, "condition": "sel"}},
    *[{"id": f"c{i}", "title": f"Correlation {i}", "level": "high", "correlation": {"type": "event_count", "rules": rules, "group-by": by, "timespan": span, "condition": {op: n}}}
      for i, (rules, by, span, op, n) in enumerate([
          (["w"], ["ProcessId"], "1d", "gte", 3), (["w"], [], "2h", "gt", 4), (["w", "n"], ["ProcessId", "Image"], "10d", "eq", 2),
          (["n"], ["DestinationIp"], "36h", "lte", 2), (["n"], ["Initiated"], "6h", "lt", 3)])],
]


@query("c9_correlations", using="tel", oracle="""
WITH h AS (SELECT run_id, ts, ProcessId, Image, DestinationIp, Initiated, event_type = 'FileCreate' AS w, event_type = 'NetworkConnect' AND k % 3 = 2 AS n FROM tel),
p AS (SELECT run_id, 0 AS c, ProcessId AS g, ts, INTERVAL 1 DAY AS span FROM h WHERE w UNION ALL SELECT run_id, 1, '', ts, INTERVAL 2 HOUR FROM h WHERE w UNION ALL SELECT run_id, 2, concat(ProcessId, '|', Image), ts, INTERVAL 10 DAY FROM h WHERE w OR n
  UNION ALL SELECT run_id, 3, DestinationIp, ts, INTERVAL 36 HOUR FROM h WHERE n UNION ALL SELECT run_id, 4, coalesce(Initiated, ''), ts, INTERVAL 6 HOUR FROM h WHERE n),
d AS (SELECT a.run_id, a.c, a.g, a.ts, count(*) AS n FROM (SELECT DISTINCT run_id, c, g, ts, span FROM p) a JOIN p b ON b.run_id = a.run_id AND b.c = a.c AND b.g = a.g AND b.ts BETWEEN a.ts - a.span AND a.ts GROUP BY 1, 2, 3, 4),
m AS (SELECT run_id, c, g, max(n) AS n, max(ts) AS latest FROM d GROUP BY 1, 2, 3)
SELECT concat('c', c) AS rule_id, run_id, g AS grp, CASE WHEN c IN (0, 2) THEN split_part(g, '|', 1) END AS pid, n AS matched_events, epoch_us(latest) AS latest_us FROM m
WHERE CASE c WHEN 0 THEN n >= 3 WHEN 1 THEN n > 4 WHEN 2 THEN n = 2 WHEN 3 THEN n <= 2 ELSE n < 3 END""")
def c9_correlations(spark, d):
    """Five correlations of different spans, groups and comparisons, in one pass."""
    t = adapter(spark, d, "tel").drop("ProcessGuid")
    x = R.correlation_alerts(t, R.compile_rules(CORRELATIONS, "informational"))
    return x.select("rule_id", "run_id", F.array_join("group_values", "|", "").alias("grp"), F.col("ProcessId").alias("pid"), "matched_events", micros(F.col("ts")).alias("latest_us"))


@query("c10_rule_catalog", oracle="""
SELECT 'sigma' AS family, CAST(11 AS bigint) AS n_rules UNION ALL SELECT 'yara', count(*) FROM part WHERE p_size = 7""")
def c10(spark, d):
    parts = table(spark, d, "part").filter(F.col("p_size") == 7).select(F.concat(F.lit("p"), "p_partkey").alias("rule_id"), F.lit("yara").alias("family"), F.col("p_name").alias("title"))
    return R.catalog_counts(R.rule_catalog(R.rule_table(spark, ruleset()), parts))


@query("c11_rule_usage", using="tel", oracle=f"""
WITH {MATCHES.strip()}, r(rule_id) AS (VALUES ('r-ports'), ('r-net'), ('r-cmd'), ('r-re'), ('r-load'), ('r-file'), ('r-svc'), ('r-ref'), ('r-never'), ('r-key'), ('r-mass'))
SELECT r.rule_id, count(m.seq) AS hits, count(m.seq) = 0 AS never_fired FROM r LEFT JOIN matches m ON r.rule_id = m.rule_id GROUP BY 1""")
def c11(spark, d):
    rs = ruleset()
    return R.rule_usage(R.apply_rules(adapter(spark, d, "tel"), rs, keep=["seq"]), R.rule_catalog(R.rule_table(spark, rs)))


@query("flagship_scores", using="tel", oracle=f"""
WITH {MATCHES.strip()}, {_DENSE.strip()},
hits AS (SELECT run_id, CASE WHEN rule_id IN ('r-ports', 'r-svc', 'r-key') THEN 15 WHEN rule_id IN ('r-net', 'r-re', 'r-file') THEN 8 WHEN rule_id = 'r-cmd' THEN 25 WHEN rule_id = 'r-load' THEN 3 ELSE 1 END AS w, rule_id, ProcessId FROM matches
  UNION ALL SELECT run_id, 15, 'r-mass', ProcessId FROM (SELECT run_id, ProcessId, max(c) AS c FROM dense GROUP BY 1, 2) g WHERE c >= 3),
p AS (SELECT run_id, ProcessId, rule_id, max(w) AS w FROM hits GROUP BY 1, 2, 3)
SELECT concat(run_id, '/', ProcessId) AS run_id, CAST(least(sum(w), 70) AS bigint) AS score, CASE WHEN least(sum(w), 70) >= 40 THEN 'malicious' WHEN least(sum(w), 70) >= 10 THEN 'suspicious' ELSE 'clean' END AS level,
  count(*) AS n_findings, max(CASE WHEN rule_id = 'r-mass' THEN 1 ELSE 0 END) = 1 AS mass_write FROM p GROUP BY run_id, ProcessId""")
def flagship(spark, d):
    """Which processes have rule hits or a burst of matching events, and what do they score?

    Rule pass (one scan), sliding-window correlation, techniques, classification,
    capped score: the smallest complete detection over the events table.
    """
    t = adapter(spark, d, "tel").drop("ProcessGuid")
    rs = ruleset()
    hits = R.apply_rules(t, rs, keep=["run_id", "seq", "ts", "event_type", "event_id", "ProcessId"])
    bursts = R.correlation_alerts(t, rs).select("run_id", F.lit(1 << 60).alias("seq"), "ts", "event_type", F.lit(None).cast("int").alias("event_id"), "ProcessId", "rule_id")
    alerts = hits.unionByName(bursts, allowMissingColumns=True)
    alerts = R.build_alert(alerts, R.rule_table(spark, rs))
    alerts = enrich_techniques(alerts, technique_map(spark), F.col("rule_techniques"))
    alerts = alerts.withColumn("run_id", F.concat_ws("/", "run_id", "ProcessId")).withColumn("in_scope", F.lit(True))
    # every alert is in scope here, so the findings alone give the score: one pass, two aggregations
    f = S.findings(S.classify_alert(alerts))
    score = F.least(F.sum("weight"), F.lit(fixed.ALERT_SCORE_CAP)).cast("bigint")
    v = f.groupBy("run_id").agg(score.alias("score"), F.count("*").alias("n_findings"), F.max(F.col("group_key") == "sigma:r-mass").alias("mass_write"))
    return v.select("run_id", "score", S.level_of(F.col("score")).alias("level"), "n_findings", "mass_write")
