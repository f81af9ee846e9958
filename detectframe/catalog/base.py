"""Registry of the queries over the shared tables, and the table adapters.

An adapter is one SELECT in the common subset of Spark SQL and ANSI SQL: the same
text gives the Spark table and the oracle's CTE.  It renames and derives columns
of the given tables; it filters nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_EVENT = (
    "(SELECT event_id AS n, ts AS t, user_id AS u, event_type AS e, value AS v, "
    "CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM {events}) x"
)

CALL_NAMES = [
    "NtWriteVirtualMemory", "NtCreateThreadEx", "NtResumeThread", "NtUnmapViewOfSection", "NtProtectVirtualMemory",
    "NtAllocateVirtualMemory", "LdrLoadDll", "NtDelayExecution", "NtSetTimer", "GetTickCount64", "BCryptEncrypt",
    "BCryptDecrypt", "NtOpenProcessToken", "NtDuplicateToken", "NtAdjustPrivilegesToken", "NtReadVirtualMemory",
    "NtSetInformationThread", "NtCreateTransaction", "NtCreateUserProcess", "NtQueueApcThread", "NtQuerySystemTime",
    "NtCreateFile", "NtSetValueKey", "CreateProcessW", "__event_cap_reached__", "__pipe_lost__",
]
_CALL_CASE = "CASE i " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(CALL_NAMES)) + " END"

ADAPTERS: dict[str, str] = {
    # events as host telemetry; time windows are days, as events span a month
    "tel": f"""
SELECT concat('run', u % 10) AS run_id, n AS seq, 'sysmon' AS source, 'host' AS provider_name, t AS ts,
  CASE e WHEN 'view' THEN 7 WHEN 'click' THEN 3 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 11 ELSE 5 END AS event_id,
  CASE e WHEN 'view' THEN 'ImageLoad' WHEN 'click' THEN 'NetworkConnect' WHEN 'purchase' THEN 'ProcessCreate'
         WHEN 'signup' THEN 'FileCreate' ELSE 'ProcessTerminate' END AS event_type,
  CAST(u AS string) AS ProcessId, CAST(u % 12 AS string) AS ParentProcessId, concat('g', n) AS ProcessGuid,
  CASE WHEN n = 0 THEN NULL ELSE concat('g', CAST(floor((n - 1) / 2) AS bigint)) END AS ParentProcessGuid,
  replace(concat('C:/Windows/System32/app', k % 9, '.exe'), '/', chr(92)) AS Image,
  concat('app', k % 9, '.exe -run ', k, ' /q') AS CommandLine,
  replace(concat(CASE WHEN k % 6 = 0 THEN 'C:/SandboxAgent/u' ELSE 'C:/Users/u' END, u % 20, '/doc', k, '.txt'), '/', chr(92)) AS TargetFilename,
  concat('10.', k % 3, '.', u % 4, '.', k % 8) AS DestinationIp, CAST(1000 + k AS string) AS DestinationPort,
  CASE WHEN k % 5 = 0 THEN 'false' WHEN k % 7 = 0 THEN NULL ELSE 'true' END AS Initiated,
  CASE WHEN k % 3 = 0 THEN 'false' ELSE ' True' END AS Signed, CASE WHEN k % 10 = 0 THEN 'expired' ELSE 'Valid' END AS SignatureStatus,
  replace(CASE WHEN k % 4 = 0 THEN 'D:/Temp/x.dll' WHEN k % 4 = 1 THEN '' ELSE 'C:/Windows/System32/x.dll' END, '/', chr(92)) AS ImageLoaded,
  CAST(k AS string) AS Level, CAST(v AS string) AS Amount, k, v AS amount_num
FROM {_EVENT}""",
    # events as a tree of processes: guid n under guid (n-1)/2, pids reused (n % 997)
    "tree": f"""
SELECT 'r' AS run_id, n AS seq, t AS ts, 'ProcessCreate' AS event_type, 1 AS event_id, 'sysmon' AS source,
  CAST(n % 997 AS string) AS ProcessId,
  CASE WHEN n = 0 THEN '999999' ELSE CAST(CAST(floor((n - 1) / 2) AS bigint) % 997 AS string) END AS ParentProcessId,
  concat('g', n) AS ProcessGuid, CASE WHEN n = 0 THEN NULL ELSE concat('g', CAST(floor((n - 1) / 2) AS bigint)) END AS ParentProcessGuid,
  replace(concat('C:/bin/', e, '.exe'), '/', chr(92)) AS Image, concat(e, ' ', k) AS CommandLine, 'u' AS "User"
FROM {_EVENT}""",
    # events as an API call stream
    "calls": f"""
SELECT concat('run', u % 5) AS run_id, n AS seq, t AS ts, 'apitrace' AS source, 9200 AS event_id, 'ApiCall' AS event_type,
  CAST(u % 30 AS string) AS ProcessId, CAST(u AS string) AS ThreadId, {_CALL_CASE} AS Api,
  CASE WHEN i >= 24 THEN 'meta' WHEN i IN (21) THEN 'file' WHEN i IN (10, 11) THEN 'crypto' WHEN i = 22 THEN 'registry' ELSE 'memory' END AS Category,
  CASE WHEN i = 6 THEN replace(concat(CASE WHEN n % 3 = 0 THEN 'C:/Users/u' WHEN n % 3 = 1 THEN 'C:/Windows/m' ELSE 'mod' END, n % 4, '.dll'), '/', chr(92))
       WHEN i = 23 THEN concat('cmd.exe ', n % 4, ' run')
       ELSE concat('target_pid=', (n * 7 + u) % 12, ' cross_process=', n % 2, ' executable=', CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END,
         ' size=', (n % 5) * 1500, ' delay_ms=', (n % 9) * 10000, ' alertable=', CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END,
         ' apc=', CASE WHEN n % 53 = 0 THEN 1 ELSE 0 END, ' base=0x', n % 6, ' start=0x', n % 6, ' child_pid=', n % 12,
         ' ppid_spoofed=', CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END, ' ppid=', n % 12, ' protect=0x', n % 64,
         CASE WHEN n % 37 = 0 THEN ' targets_module=ntdll' WHEN n % 41 = 0 THEN ' targets_module=amsi' ELSE '' END) END AS Arg0
FROM (SELECT *, CAST(CASE WHEN u % 30 < 10 THEN k % 26 WHEN u % 30 < 20 THEN k % 13 ELSE 13 + k % 13 END AS int) AS i FROM {_EVENT}) y""",
    # events as alerts of every family
    "alerts": f"""
SELECT concat('run', u) AS run_id, n AS seq, t AS ts, CASE WHEN j = 0 THEN 25 WHEN j = 10 THEN 22 ELSE 1000 + j END AS event_id,
  CASE j WHEN 0 THEN 'ProcessTampering' WHEN 1 THEN 'DmpYaraMatch' WHEN 2 THEN 'DroppedFileCapaHit' WHEN 3 THEN 'NetworkBurstDetected'
    WHEN 4 THEN 'DefenderThreatDetected' WHEN 5 THEN 'ProcessCreate' WHEN 6 THEN 'RegistryValueSet' WHEN 7 THEN 'CapeSignature'
    WHEN 8 THEN 'ApitraceInjectionChain' WHEN 9 THEN 'ProcessAccess' WHEN 10 THEN 'DnsQuery' WHEN 11 THEN 'ApiTraceTruncated'
    WHEN 12 THEN 'GuardianModuleRemap' ELSE 'FileCreateTime' END AS event_type,
  CASE WHEN j = 5 THEN 'sigma' WHEN j = 7 THEN 'cape' WHEN j IN (8, 11) THEN 'apitrace' ELSE 'sysmon' END AS source,
  CAST(u % 9 AS string) AS ProcessId, CASE WHEN j = 8 THEN CAST(k % 4 AS string) END AS TargetProcessId,
  CASE WHEN j = 1 THEN concat('rule', k % 5) END AS Rule, CASE WHEN j = 2 AND k % 4 > 0 THEN concat('cap', k % 4) END AS Capability,
  CASE WHEN j = 2 AND k % 2 = 0 THEN 'deleted' END AS Origin, concat('f', k % 6) AS DroppedFilename,
  CASE WHEN j = 3 THEN CASE WHEN k % 3 = 0 THEN 'port_scan' ELSE 'dns_flood' END END AS BurstKind,
  CASE WHEN j = 4 THEN concat('Threat', k % 4) END AS threat_name, CASE k % 4 WHEN 0 THEN 'Severe' WHEN 1 THEN ' moderate ' WHEN 2 THEN 'odd' END AS severity_name,
  CASE WHEN j = 5 THEN concat('id', k % 7) END AS rule_id, CASE WHEN j = 5 THEN concat('Title ', k % 7) END AS title,
  CASE WHEN j = 5 THEN CASE k % 7 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'informational' END END AS level,
  CASE WHEN j = 6 AND k % 3 > 0 THEN 'high' WHEN j = 10 AND k % 2 = 0 THEN 'low' WHEN j = 10 AND k % 7 = 0 THEN 'high' END AS priority,
  CASE WHEN j = 6 AND k % 3 > 0 THEN concat('reason ', k % 5) WHEN j = 10 AND (k % 2 = 0 OR k % 7 = 0) THEN 'dns reason' END AS priority_reason,
  CASE WHEN j = 7 THEN concat('sig', k % 5) END AS Name, CASE WHEN j = 7 THEN CASE k % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'weird' END END AS SeverityStr,
  CASE WHEN j = 7 AND k % 5 > 0 THEN concat('about ', k % 5) END AS Description, k % 6 > 0 AS cape_score,
  CASE WHEN j IN (2, 3, 8) AND k % 5 > 0 THEN concat('text ', j, ' ', k % 3) END AS Type,
  CASE WHEN j = 10 THEN concat('host', k % 11, '.example.com.') END AS QueryName,
  CASE WHEN n % 6 = 0 THEN true WHEN n % 5 = 0 THEN NULL ELSE false END AS in_scope, k
FROM (SELECT *, CAST((n + k) % 14 AS int) AS j FROM {_EVENT}) y""",
    # line items as packets
    "packets": """
SELECT concat('cap', l_linenumber) AS run_id, l_orderkey * 10 + l_linenumber AS idx, l_shipdate AS ts,
  CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'N' THEN 'DNS' ELSE 'UDP' END AS protocol,
  concat('10.0.0.', l_suppkey % 40) AS src, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(1000 + l_linenumber AS int) END AS sport,
  concat('10.0.0.', l_partkey % 40) AS dst, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_partkey % 3 AS int) END AS dport,
  CAST(l_quantity AS bigint) AS length, concat('Pkt ', l_linestatus, ' ', l_suppkey) AS summary,
  CASE WHEN l_returnflag = 'N' THEN concat('h', l_suppkey % 25, '.example.org') END AS dns_qname,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN concat('web', l_suppkey % 7) END AS http_host,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN concat('/p', l_partkey % 5) END AS http_path,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'GET' END AS http_method
FROM {lineitem}""",
    # orders as runs of samples
    "runs": """
SELECT concat('rep', o_orderkey) AS run_id, o_orderdate AS ts, concat('sha', o_custkey) AS sha256, concat('file', o_orderkey % 500, '.exe') AS filename,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CAST(floor(o_totalprice) % 101 AS bigint) AS score,
  CASE WHEN floor(o_totalprice) % 101 >= 40 THEN 'malicious' WHEN floor(o_totalprice) % 101 >= 10 THEN 'suspicious' ELSE 'clean' END AS level,
  concat('T', 1000 + o_custkey % 40, CASE WHEN o_orderkey % 3 = 0 THEN concat('.00', o_orderkey % 4) ELSE '' END) AS technique, o_orderpriority AS priority
FROM {orders}""",
    # judged documents as scored runs: truth from the label, score from the text's own features
    "scored": """
SELECT id, label, family, source, score, CASE WHEN score >= 40 THEN 'malicious' WHEN score >= 10 THEN 'suspicious' ELSE 'clean' END AS predicted
FROM (SELECT d.doc_id AS id, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 'malicious' ELSE 'benign' END AS label,
    CASE WHEN d.lang = 'fr' AND l.quality = 1 AND l.toxic = 0 THEN 'goodware_boundary' ELSE d.lang END AS family, d.source,
    CAST((CASE WHEN l.quality = 0 THEN 18 ELSE 0 END) + (CASE WHEN l.toxic = 1 THEN 22 ELSE 0 END)
      + (CASE WHEN contains(lower(d.text), 'license') THEN 15 ELSE 0 END) + (CASE WHEN contains(d.text, 'http') THEN 12 ELSE 0 END)
      + (CASE WHEN d.n_chars % 11 = 0 THEN 20 ELSE 0 END) + d.n_chars % 30 AS int) AS score
  FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) s""",
    # page hosts as name lookups, page order as time
    "dns": """
SELECT concat('run', page_id % 3) AS run_id, page_id AS seq, TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' SECOND AS ts, 'DnsQuery' AS event_type,
  CAST(page_id % 5 AS string) AS ProcessId, regexp_extract(url, '://([^/:?#]+)', 1) AS QueryName
FROM {pages}""",
}


#: Adapters whose key column is a long CASE.
DERIVED_NAMES = {"calls"}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter as a DataFrame."""
    sql = ADAPTERS[name]
    names = set(re.findall(r"\{(\w+)\}", sql))
    df = spark.sql(sql.replace('"User"', "`User`"), **{n: table(spark, sf_dir, n) for n in names})
    if name not in DERIVED_NAMES:
        return df
    # The call name is a long CASE over the table; without this fence every later
    # filter on it would be rewritten into copies of that CASE.
    return df.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")


def ctes(*names: str) -> str:
    """``WITH`` text of adapters for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', ADAPTERS[n])})" for n in names) + " "


def query(name: str, oracle: str | None = None, using: str = ""):
    """Register a query; ``using`` lists adapters its oracle reads."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            text = oracle.strip()
            if using:
                head = ctes(*using.split()).rstrip()
                if text.upper().startswith("WITH RECURSIVE "):
                    text = head.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + text[len("WITH RECURSIVE "):]
                else:
                    text = head + (", " + text[5:] if text[:5].upper() == "WITH " else " " + text)
            ORACLES[name] = text
        return fn

    return register
