"""Queries of SURVEY F7-F9, 2.D."""

from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import adapter, query, table
from detectframe.catalog.rules import ruleset
from detectframe.operators import scoring as S
from detectframe.operators import triage as T
from detectframe.plans.detect import Detection, detect, evaluate
from detectframe.scale import cut


def alerts(spark, d):
    a = adapter(spark, d, "alerts")
    return a.withColumnRenamed("threat_name", "Threat Name").withColumnRenamed("severity_name", "Severity Name")


CLASSED = """
classed AS (SELECT *, CASE WHEN event_id = 25 THEN 'heuristic' WHEN event_type = 'DmpYaraMatch' THEN 'yara' WHEN event_type IN ('DroppedFileCapaHit', 'NetworkBurstDetected', 'DefenderThreatDetected') THEN 'heuristic'
    WHEN rule_id IS NOT NULL THEN 'sigma' WHEN priority = 'high' THEN 'heuristic' WHEN event_type = 'CapeSignature' THEN CASE WHEN cape_score THEN 'cape' END
    WHEN event_type IN ('ApitraceInjectionChain', 'GuardianModuleRemap') THEN 'behavioral' WHEN event_type NOT IN ('ProcessAccess', 'RegistryValueSet', 'ApiTraceTruncated') THEN 'heuristic' END AS family,
  CASE WHEN event_id = 25 THEN 'critical' WHEN event_type = 'DmpYaraMatch' THEN 'high' WHEN event_type = 'DroppedFileCapaHit' THEN 'medium' WHEN event_type = 'NetworkBurstDetected' THEN CASE WHEN BurstKind = 'port_scan' THEN 'high' ELSE 'medium' END
    WHEN event_type = 'DefenderThreatDetected' THEN CASE trim(lower(coalesce(severity_name, ''))) WHEN 'severe' THEN 'critical' WHEN 'moderate' THEN 'medium' ELSE 'high' END
    WHEN rule_id IS NOT NULL THEN lower(coalesce(level, 'informational')) WHEN priority = 'high' THEN 'high' WHEN event_type = 'CapeSignature' THEN CASE WHEN cape_score THEN CASE lower(coalesce(SeverityStr, 'low')) WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END END
    WHEN event_type = 'ApitraceInjectionChain' THEN 'critical' WHEN event_type = 'GuardianModuleRemap' THEN 'high' WHEN event_type NOT IN ('ProcessAccess', 'RegistryValueSet', 'ApiTraceTruncated') THEN 'low' END AS severity,
  CASE WHEN event_id = 25 THEN 'event_id:25' WHEN event_type = 'DmpYaraMatch' THEN concat('yara:', Rule) WHEN event_type = 'DroppedFileCapaHit' THEN concat('capa-dropped:', coalesce(Origin, 'created'), ':', DroppedFilename, ':', coalesce(Capability, 'unknown'))
    WHEN event_type = 'NetworkBurstDetected' THEN concat('netburst:', BurstKind, ':', ProcessId) WHEN event_type = 'DefenderThreatDetected' THEN concat('defender:', threat_name) WHEN rule_id IS NOT NULL THEN concat('sigma:', rule_id)
    WHEN priority = 'high' THEN concat('heuristic-high:', event_type) WHEN event_type = 'CapeSignature' THEN CASE WHEN cape_score THEN concat('cape:', Name) END
    WHEN event_type IN ('ApitraceInjectionChain', 'GuardianModuleRemap') THEN concat('apitrace:', event_type, ':', ProcessId, ':', CASE WHEN TargetProcessId = '0' THEN '' ELSE coalesce(TargetProcessId, '') END)
    WHEN event_type NOT IN ('ProcessAccess', 'RegistryValueSet', 'ApiTraceTruncated') THEN concat('heuristic:', event_type) END AS group_key,
  CASE WHEN event_id = 25 THEN 'Process tampering (hollowing/injection)' WHEN event_type = 'DmpYaraMatch' THEN concat('YARA match: ', Rule) WHEN event_type IN ('DroppedFileCapaHit', 'NetworkBurstDetected') THEN coalesce(Type, event_type)
    WHEN event_type = 'DefenderThreatDetected' THEN concat('Microsoft Defender detected ', threat_name) WHEN rule_id IS NOT NULL THEN concat('Sigma: ', title) WHEN priority = 'high' THEN coalesce(priority_reason, concat(event_type, ' (high priority)'))
    WHEN event_type = 'CapeSignature' THEN CASE WHEN cape_score THEN concat('CAPE: ', coalesce(Description, Name)) END WHEN event_type IN ('ApitraceInjectionChain', 'GuardianModuleRemap') THEN coalesce(Type, event_type)
    WHEN event_type NOT IN ('ProcessAccess', 'RegistryValueSet', 'ApiTraceTruncated') THEN event_type END AS label FROM alerts),
weighed AS (SELECT *, CASE WHEN group_key IS NULL THEN NULL WHEN event_id = 25 THEN 40 WHEN event_type = 'DmpYaraMatch' THEN 20 WHEN group_key LIKE 'heuristic-high:%' THEN 12 WHEN group_key LIKE 'heuristic:%' THEN 4
  ELSE CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 1 END END AS weight FROM classed)"""
FINDINGS = f"""
{CLASSED.strip()}, fin AS (SELECT run_id, group_key, max(weight) AS weight, min(seq) AS first_seq, arg_max(label, CAST(weight AS bigint) * 1000000000 - seq) AS label FROM weighed WHERE in_scope AND group_key IS NOT NULL GROUP BY 1, 2)"""


@query("f7_classify_alert", using="alerts", oracle=f"WITH {CLASSED.strip()} SELECT seq, family, severity, CAST(weight AS bigint) AS weight, group_key, label FROM weighed")
def f7(spark, d):
    return S.classify_alert(alerts(spark, d)).select("seq", "family", "severity", F.col("weight").cast("bigint").alias("weight"), "group_key", "label")


_STATIC = """
stat AS (SELECT concat('run', c_custkey) AS run_id, c_acctbal > 6000 AS packed, CASE c_custkey % 4 WHEN 0 THEN 'Valid' WHEN 1 THEN 'NotSigned' WHEN 2 THEN 'UnknownError' END AS st, c_custkey % 8 < 3 AS signed, c_custkey % 5 AS np, c_custkey % 3 AS nc, c_custkey % 7 = 0 AS obf FROM customer),
sig AS (SELECT run_id, 0 AS ord, 10 AS weight, 'Sample appears packed/encrypted' AS label FROM stat WHERE packed
  UNION ALL SELECT run_id, 1, 5, 'Sample binary is unsigned' FROM stat WHERE st IN ('Valid', 'NotSigned') AND NOT signed
  UNION ALL SELECT run_id, 2, 15, concat('Static YARA match on sample: ', CASE np WHEN 1 THEN 'r1' WHEN 2 THEN 'r1, r2' ELSE 'r1, r2, r3' END) FROM stat WHERE np > 0
  UNION ALL SELECT run_id, 3, 8, concat('capa high-signal capability: ', CASE nc WHEN 1 THEN 'r1' ELSE 'r1, r2' END) FROM stat WHERE nc > 0
  UNION ALL SELECT run_id, 4, 5, '.NET obfuscator/packer markers: x' FROM stat WHERE obf)"""


def _static(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    names = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("r"), i))
    return S.static_signals(c.select(
        F.concat(F.lit("run"), k).alias("run_id"), (F.col("c_acctbal") > 6000).alias("packed"),
        F.when(k % 4 == 0, "Valid").when(k % 4 == 1, "NotSigned").when(k % 4 == 2, "UnknownError").alias("signature_status"), (k % 8 < 3).alias("signed"),
        names(k % 5).alias("pattern_names"), names(k % 3).alias("capability_names"), F.when(k % 7 == 0, F.array(F.lit("x"))).alias("obfuscator_markers")))


@query("f9_static_signals", oracle=f"WITH {_STATIC.strip()} SELECT run_id, CAST(ord AS bigint) AS ord, CAST(weight AS bigint) AS weight, label FROM sig")
def f9(spark, d):
    return _static(spark, d).select("run_id", F.col("ord").cast("bigint").alias("ord"), F.col("weight").cast("bigint").alias("weight"), "label")


@query("f8_verdict", using="alerts", oracle=f"""
WITH {FINDINGS.strip()}, {_STATIC.strip()}, a AS (SELECT run_id, least(sum(weight), 70) AS s, count(*) AS n FROM fin GROUP BY 1), b AS (SELECT run_id, sum(weight) AS s FROM sig GROUP BY 1),
v AS (SELECT r.run_id, CAST(least(coalesce(a.s, 0) + coalesce(b.s, 0), 100) AS bigint) AS score, coalesce(a.n, 0) AS n_findings FROM (SELECT DISTINCT run_id FROM alerts) r LEFT JOIN a ON r.run_id = a.run_id LEFT JOIN b ON r.run_id = b.run_id)
SELECT run_id, score, n_findings, CASE WHEN score >= 40 THEN 'malicious' WHEN score >= 10 THEN 'suspicious' ELSE 'clean' END AS level FROM v""")
def f8(spark, d):
    a = alerts(spark, d)
    return S.verdict(a, S.classify_alert(a), _static(spark, d)).select("run_id", F.col("score").cast("bigint").alias("score"), "n_findings", "level")


@query("f8_top_reasons", using="alerts", oracle=f"""
WITH {FINDINGS.strip()}, {_STATIC.strip()}, r AS (SELECT run_id, weight, label, 0 AS part, first_seq AS ord FROM fin UNION ALL SELECT run_id, weight, label, 1, ord FROM sig)
SELECT run_id, rank, CAST(weight AS bigint) AS weight, label FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, part, ord, label) AS rank FROM r) x WHERE rank <= 5""")
def f8_reasons(spark, d):
    a = alerts(spark, d)
    return S.top_reasons(S.classify_alert(a), _static(spark, d)).select("run_id", F.col("rank").cast("bigint").alias("rank"), F.col("weight").cast("bigint").alias("weight"), "label")


@query("d1_select_alert_events", using="tel", oracle="""
SELECT seq, event_type FROM tel WHERE event_type = 'NetworkConnect' OR (event_type = 'ImageLoad' AND (k % 3 = 0 OR k % 10 = 0 OR k % 4 = 0))""")
def d1(spark, d):
    return T.select_alert_events(adapter(spark, d, "tel")).select("seq", "event_type")


_PATHS = ["HKLM/SOFTWARE/Microsoft/Windows/CurrentVersion/RunOnce/x", "HKLM/x/Winlogon/Shell", "HKCR/CLSID/{1}/InProcServer32", "HKLM/System/Services/abc/ImagePath", "HKLM/Policies/Windows Defender/DisableAntiSpyware",
          "HKLM/Windows Defender/Exclusions/Paths", "HKLM/Active Setup/Installed Components/1/StubPath", "HKCU/Plain/Key", "HKLM/x/AppInit_DLLs", "HKCR/CLSID/{2}/Other"]
_WHY = ["Run/RunOnce/RunServices autostart key (T1547.001)", "Winlogon Shell persistence (T1547.004)", "COM CLSID hijacking (T1546.015)", "Service ImagePath modification (T1543.003/T1574.011)", "Defender tamper (T1562.001)",
        "Defender exclusion added (T1562.001)", "Active Setup StubPath persistence (T1112)", None, "AppInit_DLLs persistence (T1546.010)", None]
_PIPES = ["/PSEXESVC-1", "/msagent_12", "/MSSE-1a-server", "/plain", "/Winsock2/CatalogChangeListener-1-0,", "/status_x"]
_PWHY = ["PsExec default service pipe name (T1569.002)", "Cobalt Strike default pipe pattern", "Cobalt Strike default pipe pattern", None, "Cobalt Strike default pipe pattern", "Cobalt Strike default pipe pattern"]


def _case(expr, values):
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


def _pick(n, values, sep=True):
    out = None
    for i, v in enumerate(values):
        v = v.replace("/", "\\") if sep else v
        out = F.when(n == i, v) if out is None else out.when(n == i, v)
    return out


@query("d2_registry_priority", oracle=f"SELECT event_id AS seq, {_case('event_id % 10', _WHY)} AS reason FROM events")
def d2(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select(n.alias("seq"), T.registry_priority(_pick(n % 10, _PATHS)).alias("reason"))


@query("d3_pipe_priority", oracle=f"SELECT event_id AS seq, {_case('event_id % 6', _PWHY)} AS reason FROM events")
def d3(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select(n.alias("seq"), T.pipe_priority(_pick(n % 6, _PIPES)).alias("reason"))


_ENT = """
lab AS (SELECT page_id, concat(string_split(h, '.')[-2], CASE page_id % 3 WHEN 0 THEN concat('xkcdqwz', page_id) WHEN 1 THEN concat('bcdfghqx', page_id * 7919) ELSE '' END) AS sld FROM (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS h FROM pages) x),
ch AS (SELECT page_id, sld, unnest(string_split(sld, '')) AS c FROM lab), cnt AS (SELECT page_id, sld, c, count(*) AS n FROM ch GROUP BY 1, 2, 3),
ent AS (SELECT page_id, sld, -sum((n / length(sld)) * log2(n / length(sld))) AS entropy FROM cnt GROUP BY 1, 2)"""


def _domains(spark, d):
    h = F.regexp_extract("url", "://([^/:?#]+)", 1)
    i = F.col("page_id")
    add = F.when(i % 3 == 0, F.concat(F.lit("xkcdqwz"), i)).when(i % 3 == 1, F.concat(F.lit("bcdfghqx"), i * 7919)).otherwise("")
    parts = F.split(h, r"\.")
    sld = F.concat(F.get(parts, F.size(parts) - 2), add)
    return table(spark, d, "pages").select("page_id", sld.alias("sld"), F.concat(F.lit("."), F.lit("WWW."), sld, F.lit(".com.")).alias("name"))


@query("d4_dga_suspect", oracle=f"""
WITH {_ENT.strip()} SELECT page_id, length(sld) >= 12 AND entropy >= 3.6 AND length(translate(sld, 'aeiou', '')) >= 0.6 * length(sld) AND regexp_matches(sld, '[bcdfghjklmnpqrstvwxz]{{6,}}') AS dga FROM ent""")
def d4(spark, d):
    return _domains(spark, d).select("page_id", T.dga_suspect(F.col("name")).alias("dga"))


@query("d5_os_noise_domain", oracle="""
WITH x AS (SELECT page_id, concat(regexp_extract(url, '://([^/:?#]+)', 1), CASE page_id % 5 WHEN 0 THEN '.windows.com' WHEN 1 THEN '.windows.com.evil.org' WHEN 2 THEN 'msn.com' WHEN 3 THEN '.office365.com' ELSE '' END) AS h FROM pages)
SELECT page_id, page_id % 5 IN (0, 3) AS noise FROM x""")
def d5(spark, d):
    i = F.col("page_id") % 5
    h = F.concat(F.regexp_extract("url", "://([^/:?#]+)", 1), F.when(i == 0, ".windows.com").when(i == 1, ".windows.com.evil.org").when(i == 2, "msn.com").when(i == 3, ".office365.com").otherwise(""))
    return table(spark, d, "pages").select("page_id", T.os_noise_domain(h).alias("noise"))


@query("d6_annotate_priority", oracle=f"""
WITH x AS (SELECT event_id AS seq, event_id % 4 AS t, event_id % 10 AS i, event_id % 6 AS p, event_id % 3 AS h, CASE WHEN event_id % 7 = 0 THEN 'high' END AS old FROM events)
SELECT seq, CASE WHEN t = 0 AND {_case('i', _WHY)} IS NOT NULL THEN 'high' WHEN t = 1 AND {_case('p', _PWHY)} IS NOT NULL THEN 'high' WHEN t = 2 AND h = 0 THEN 'high' WHEN t = 2 AND h = 1 AND old IS NULL THEN 'low' ELSE old END AS priority,
  CASE WHEN t = 0 THEN {_case('i', _WHY)} WHEN t = 1 THEN {_case('p', _PWHY)} WHEN t = 2 AND h = 0 THEN 'DGA-suspect domain (label ''qwrtzpsdfghjklxcv'': len=17, entropy=4.09, vowel-poor) (T1568.002)' WHEN t = 2 AND h = 1 AND old IS NULL THEN 'common OS/vendor background traffic' END AS reason FROM x""")
def d6(spark, d):
    n = F.col("event_id")
    a = table(spark, d, "events").select(
        n.alias("seq"), _pick(n % 4, ["RegistryValueSet", "PipeCreated", "DnsQuery", "FileCreate"]).alias("event_type"), _pick(n % 10, _PATHS).alias("TargetObject"), _pick(n % 6, _PIPES).alias("PipeName"),
        _pick(n % 3, ["a.qwrtzpsdfghjklxcv.net", "Update.Microsoft.com.", "plain.example.org"], False).alias("QueryName"), F.when(n % 7 == 0, "high").alias("priority"))
    return T.annotate_priority(a).select("seq", "priority", F.col("priority_reason").alias("reason"))


@query("d7_av_detections", using="tel", oracle="""
WITH s AS (SELECT run_id, min(ts) AS start FROM tel WHERE event_type = 'ProcessCreate' AND CAST(ProcessId AS bigint) = 10 + CAST(right(run_id, 1) AS bigint) AND k % 9 = 3 GROUP BY 1),
x AS (SELECT run_id, seq, ts, CASE WHEN k % 3 = 0 THEN 'Virus:Win32/MpTest!amsi' ELSE concat('Trojan', k % 5) END AS threat, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'C:/SandboxAgent/x' ELSE concat('C:/u/', k % 8) END AS path FROM tel WHERE event_type = 'ImageLoad'),
y AS (SELECT x.* FROM x LEFT JOIN s ON x.run_id = s.run_id WHERE threat NOT LIKE '%MpTest%' OR (coalesce(path, '') <> '' AND path NOT LIKE '%SandboxAgent%' AND coalesce(x.ts >= s.start, false)))
SELECT run_id, threat, path, min(seq) AS seq, true AS in_scope FROM y GROUP BY 1, 2, 3""")
def d7(spark, d):
    t, k = adapter(spark, d, "tel"), F.col("k")
    runs = t.select("run_id").distinct().select("run_id", (F.right("run_id", F.lit(1)).cast("bigint") + 10).alias("root_pid"), F.lit("C:\\x\\APP3.exe").alias("root_image"))
    av = t.filter(F.col("event_type") == "ImageLoad").select(
        "run_id", "seq", "ts", F.lit("DefenderThreatDetected").alias("event_type"), F.when(k % 3 == 0, "Virus:Win32/MpTest!amsi").otherwise(F.concat(F.lit("Trojan"), k % 5)).alias("Threat Name"),
        F.when(k % 4 == 1, "C:/SandboxAgent/x").when(k % 4 > 1, F.concat(F.lit("C:/u/"), k % 8)).alias("Path"))
    return T.av_detections(av, T.sample_starts(t, runs)).select("run_id", "threat", "path", "seq", "in_scope")


@query("d8_content_matches", oracle="""
SELECT doc_id, 'rule_tion' AS rule, CAST(9103 AS bigint) AS event_id FROM documents WHERE contains(text, 'tion') UNION ALL SELECT doc_id, 'rule_the', 9104 FROM documents WHERE contains(text, 'the')""")
def d8(spark, d):
    hit = lambda rule, word, err=None: F.when(F.col("text").contains(word), F.struct(F.lit(rule).alias("rule"), F.lit(err).cast("string").alias("error")))
    m = F.filter(F.array(hit("rule_tion", "tion"), hit("suspicious_cmd_commands", "e"), hit("broken", "a", "timeout")), lambda x: x.isNotNull())
    n = F.filter(F.array(hit("rule_the", "the"), hit("broken", "a", "timeout")), lambda x: x.isNotNull())
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.col("source").alias("filename"), m.alias("m"), n.alias("n"))
    dump = T.explode_content_matches(doc.select("run_id", "filename", F.col("m").alias("matches")), "dump")
    drop = T.explode_content_matches(doc.select("run_id", "filename", F.col("n").alias("matches")), "dropped")
    return dump.unionByName(drop).select(F.col("run_id").alias("doc_id"), F.col("Rule").alias("rule"), F.col("event_id").cast("bigint").alias("event_id"))


@query("d9_capabilities", oracle="""
SELECT p_partkey, coalesce(nullif(p_name, 'x'), 'unknown') AS capability, CASE WHEN p_size % 2 = 0 THEN 'deleted' ELSE 'created' END AS origin FROM part WHERE p_size % 3 <> 0 AND p_size > 20
UNION ALL SELECT p_partkey, 'unknown', CASE WHEN p_size % 2 = 0 THEN 'deleted' ELSE 'created' END FROM part WHERE p_size % 3 <> 0 AND p_size > 40""")
def d9(spark, d):
    s = F.col("p_size")
    cap = lambda name, high: F.struct(name.alias("name"), high.alias("high_signal"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("run_id"), F.col("p_brand").alias("filename"), F.when(s % 2 == 0, "deleted").otherwise("").alias("origin"), (s % 3 != 0).alias("available"),
                                       F.array(cap(F.col("p_name"), s > 20), cap(F.lit(None).cast("string"), s > 40)).alias("capabilities"))
    return T.explode_capabilities(f).select(F.col("run_id").alias("p_partkey"), F.col("Capability").alias("capability"), F.col("Origin").alias("origin"))


@query("d10_launcher_artifacts", using="tel", oracle="""
SELECT seq FROM tel WHERE NOT (run_id IN ('run1', 'run3', 'run5', 'run7', 'run9') AND event_type = 'ProcessCreate' AND k % 2 = 0 AND ProcessId = concat('1', right(run_id, 1)))""")
def d10(spark, d):
    t = adapter(spark, d, "tel").withColumn("rule_id", F.when(F.col("k") % 2 == 0, "r"))
    last = F.right("run_id", F.lit(1)).cast("bigint")
    runs = t.select("run_id").distinct().select("run_id", (last + 10).alias("root_pid"), F.when(last % 2 == 1, "C:\\Windows\\CMD.exe").otherwise("C:\\a\\sample.exe").alias("root_image"))
    return T.suppress_launcher_artifacts(t, runs).select("seq")


SCOPED = """
ev AS (SELECT run_id, seq, k, ProcessId AS p, CASE k % 8 WHEN 0 THEN 'CreateRemoteThread' WHEN 1 THEN 'ProcessAccess' WHEN 2 THEN 'ImageLoad' WHEN 3 THEN 'PipeConnected' WHEN 4 THEN 'Apitrace' WHEN 5 THEN 'WmiQuery' WHEN 6 THEN 'ProcessCreate' ELSE 'Other' END AS t,
  seq % 5 AS s, k % 16 AS g, seq % 3 = 0 AS has_guid, seq % 2 = 0 AS m, seq % 4 <> 0 AS inn FROM tel),
vas AS (SELECT DISTINCT run_id, 4096 + CAST(right(run_id, 1) AS bigint) AS va FROM tel WHERE run_id < 'run5'),
thr AS (SELECT ev.*, vas.va IS NOT NULL AND t = 'CreateRemoteThread' AND s = 4 AS tool FROM ev LEFT JOIN vas ON ev.run_id = vas.run_id),
pairs AS (SELECT DISTINCT run_id, s, g FROM thr WHERE tool)"""


def _scope_rows(spark, d):
    t, k, n = adapter(spark, d, "tel"), F.col("k"), F.col("seq")
    last = F.right("run_id", F.lit(1)).cast("bigint")
    et = _pick(k % 8, ["CreateRemoteThread", "ProcessAccess", "ImageLoad", "PipeConnected", "Apitrace", "WmiQuery", "ProcessCreate", "Other"], False)
    a = t.select(
        "run_id", "seq", et.alias("event_type"), F.when(k % 8 == 4, "apitrace").when(k % 8 == 5, "wmi_etw").otherwise("sysmon").alias("source"),
        F.when(n % 5 == 4, F.concat(F.lit("0x"), F.lower(F.hex(last + 4096)))).otherwise("0x5555").alias("StartAddress"),
        F.when(k % 8 < 2, (n % 5).cast("string")).alias("SourceProcessId"), F.when(k % 8 < 2, (k % 16).cast("string")).when(k % 8 == 4, (n % 4).cast("string")).alias("TargetProcessId"),
        F.when(k % 8 >= 2, "5").alias("ProcessId"), F.when(n % 3 == 0, "g").alias("ProcessGuid"),
        F.when((k % 8 == 2) & (n % 2 == 0), "C:\\SandboxAgent\\m.dll").alias("ImageLoaded"), F.when((k % 8 == 3) & (n % 2 == 0), "\\Sandbox_ApiTrace").alias("PipeName"),
        F.when((k % 8 == 7) & (n % 2 == 0), "C:\\x\\TiWorker.exe").when((k % 8 == 6), "C:\\Stage\\abc").alias("Image"), F.when((k % 8 == 1) & (n % 7 == 0), "C:\\SandboxAgent\\l.exe").alias("SourceImage"),
        F.lit("NT Authority\\SYSTEM").alias("User"), F.when(n % 2 == 0, "select * where x isa 'FirewallProduct'").alias("Query"),
        F.when(n % 2 == 0, fixed.STAGING_RULE_IDS[0]).otherwise("other").alias("rule_id"), (n % 4 != 0).alias("in_scope"))
    marks = t.filter(F.col("run_id") < "run5").select("run_id", last.alias("last")).distinct().select(
        "run_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("guardian").alias("source"), F.lit("GuardianRegistered").alias("event_type"),
        F.concat(F.lit("up loadlibrary_x64=0x"), F.hex(F.col("last") + 4096), F.lit(" loadlibrary_x86=0x0")).alias("Text"))
    attached = t.select("run_id").distinct().select("run_id", F.lit(-3).cast("bigint").alias("seq"), F.lit("apitrace").alias("source"), F.lit("ApiCall").alias("event_type"), F.lit("__monitor_attached__").alias("Api"), F.lit("5").alias("ProcessId"))
    placed = t.select("run_id").distinct().select("run_id", F.lit(-2).cast("bigint").alias("seq"), F.lit("guardian").alias("source"), F.lit("GuardianInjectionPlaced").alias("event_type"), F.lit("3").alias("TargetProcessId"))
    events = marks.unionByName(attached, allowMissingColumns=True).unionByName(placed, allowMissingColumns=True)
    runs = t.select("run_id").distinct().withColumn("staged_path", F.lit("C:\\stage\\ABC"))
    return a, events, runs


@query("d12_tooling_remote_threads", using="tel", oracle=f"WITH {SCOPED.strip()} SELECT seq, tool AS tooling FROM thr")
def d12(spark, d):
    a, e, _ = _scope_rows(spark, d)
    return T.tooling_remote_threads(a, e).select("seq", F.col("tooling_thread").alias("tooling"))


@query("d13_tooling_pairs", using="tel", oracle=f"WITH {SCOPED.strip()} SELECT run_id, s AS src, CAST(g AS bigint) AS tgt FROM pairs")
def d13(spark, d):
    a, e, _ = _scope_rows(spark, d)
    return T.tooling_pairs(a, e)


@query("d11_rescope", using="tel", oracle=f"""
WITH {SCOPED.strip()}, r AS (SELECT thr.*, CASE WHEN NOT inn THEN NULL WHEN tool THEN 'LoadLibraryW' WHEN t = 'ImageLoad' AND m THEN 'monitor DLL' WHEN t = 'PipeConnected' AND m THEN 'pipe'
    WHEN t = 'Other' AND m AND NOT has_guid THEN 'tiworker' WHEN t = 'WmiQuery' AND m AND NOT has_guid THEN 'health' WHEN t = 'ProcessAccess' AND seq % 7 = 0 THEN 'loader action'
    WHEN t = 'Apitrace' AND seq % 4 = 3 THEN 'marked' WHEN t = 'ProcessAccess' AND EXISTS (SELECT 1 FROM pairs p WHERE p.run_id = thr.run_id AND p.s = thr.s AND p.g = thr.g) THEN 'process open' WHEN t = 'ProcessCreate' AND m THEN 'staging' END AS why FROM thr)
SELECT seq, inn AND why IS NULL AS in_scope, why FROM r""")
def d11(spark, d):
    a, e, runs = _scope_rows(spark, d)
    x = T.rescope(a, e, runs)
    w = F.col("scope_reason")
    short = [("LoadLibraryW", "LoadLibraryW"), ("monitor DLL", "monitor DLL"), ("guardian pipe", "pipe"), ("tiworker", "tiworker"), ("health", "health"), ("loader action", "loader action"), ("marked", "marked"), ("process open", "process open"), ("staging", "staging")]
    why = None
    for needle, name in short:
        why = F.when(w.contains(needle), name) if why is None else why.when(w.contains(needle), name)
    return x.select("seq", "in_scope", why.alias("why"))


@query("d14_forensic_groups", using="alerts", oracle=f"""
WITH {CLASSED.strip()} SELECT run_id, event_type, CAST(min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS bigint) AS worst, count(*) AS n_alerts FROM weighed GROUP BY 1, 2""")
def d14(spark, d):
    a = S.classify_alert(alerts(spark, d))
    return T.forensic_groups(a.withColumn("severity", S.alert_severity(a))).withColumn("worst", F.col("worst").cast("bigint"))


@query("d14_forensic_preview", using="alerts", oracle="""
SELECT run_id, event_type, seq, pos FROM (SELECT run_id, event_type, seq, row_number() OVER (PARTITION BY run_id, event_type ORDER BY seq) AS pos FROM alerts) x WHERE pos <= 3""")
def d14_preview(spark, d):
    return T.forensic_preview(alerts(spark, d), 3).select("run_id", "event_type", "seq", F.col("pos").cast("bigint").alias("pos"))




def _replay(spark, d):
    """Host telemetry and call streams of ten runs as one event table, the runs, and their detection."""
    events = adapter(spark, d, "tel").unionByName(adapter(spark, d, "calls"), allowMissingColumns=True)
    runs = events.groupBy("run_id").agg(F.max("ts").alias("ts")).select(
        "run_id", "ts", F.regexp_extract("run_id", "[0-9]+", 0).cast("bigint").alias("root_pid"), F.lit("C:\\bin\\sample.exe").alias("root_image"),
        F.concat(F.lit("sha"), F.regexp_extract("run_id", "[0-9]+", 0)).alias("sha256"), F.concat("run_id", F.lit(".exe")).alias("filename"))
    runs = cut(runs, "replay-runs")
    return runs, detect(events, runs, ruleset())


@query("replay_verdicts")
def replay_verdicts(spark, d):
    """The whole offline detection over stored telemetry: score, level and findings of every run."""
    return _replay(spark, d)[1].verdicts


@query("replay_quality")
def replay_quality(spark, d):
    """The same replay measured against labels: rates with their intervals."""
    runs, found = _replay(spark, d)
    found = Detection(found.alerts, cut(found.verdicts, "replay-verdicts"), found.reasons)
    number = F.regexp_extract("run_id", "[0-9]+", 0).cast("int")
    labels = runs.select(F.when(number % 2 == 0, "report").otherwise("sha256").alias("match_kind"), F.when(number % 2 == 0, F.col("run_id")).otherwise(F.col("sha256")).alias("match_value"),
                         F.when(number % 3 == 0, "benign").otherwise("malicious").alias("label"), F.lit("none").alias("family"))
    return evaluate(found, runs, labels)["rates"]
