"""Queries of SURVEY 2.P."""

import pandas as pd
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import CALL_NAMES, adapter, query, table
from detectframe.operators import calls as P
from detectframe.operators.joins import trace_rows


def specs():
    """Call signatures of our own (built on use: a Column needs a session)."""
    elsewhere = F.col("args")["ProcessHandle"] != "0xffffffff"
    return [
        P.CallSpec("allocates", apis=["VirtualAlloc"], severity=2, description="allocates memory"),
        P.CallSpec("cross_write", apis=["WriteProcessMemory"], categories=["memory"], where=elsewhere, severity=3, description="writes elsewhere"),
        P.CallSpec("crypto_calls", categories=["crypto"], severity=1),
        P.CallSpec("app3_sleeps", apis=["Sleep"], process_names=["APP3.exe"], severity=6),
    ]


def _calls(spark, d):
    """The call stream plus process creations that name some processes."""
    c = adapter(spark, d, "calls")
    t = adapter(spark, d, "tel").filter(F.col("event_type") == "ProcessCreate").select(
        F.concat(F.lit("run"), F.col("ProcessId").cast("bigint") % 5).alias("run_id"), "seq", "ts", "source", "event_id", "event_type",
        (F.col("ProcessId").cast("bigint") % 30).cast("string").alias("ProcessId"), F.lit("777777").alias("ParentProcessId"), "Image", "CommandLine")
    return c.unionByName(t, allowMissingColumns=True)


_NAMES = "CASE Api " + " ".join(f"WHEN '{a}' THEN {fixed.API_ALIASES[a]!r}" for a in CALL_NAMES if a in fixed.API_ALIASES) + " ELSE [Api] END"


@query("p1_alias_names", using="calls", oracle=f"SELECT name, count(*) AS n FROM (SELECT unnest({_NAMES}) AS name FROM calls) x GROUP BY 1")
def p1(spark, d):
    c = adapter(spark, d, "calls").select(F.col("Api").alias("api"))
    return P.alias_names(c, P.alias_table(spark)).groupBy("name").agg(F.count("*").alias("n"))


@query("p2_normalize_args", using="calls", oracle="""
SELECT seq, CASE WHEN Api IN ('NtAllocateVirtualMemory') THEN concat('0x', lpad(lower(regexp_extract(Arg0, 'protect=0x(\\S+)', 1)), 8, '0')) END AS protection,
  CASE WHEN Api IN ('NtAllocateVirtualMemory', 'NtWriteVirtualMemory', 'NtReadVirtualMemory', 'NtProtectVirtualMemory') THEN regexp_extract(Arg0, 'base=(\\S+)', 1) END AS base,
  CASE WHEN Api IN ('NtAllocateVirtualMemory', 'NtWriteVirtualMemory', 'NtReadVirtualMemory', 'NtProtectVirtualMemory', 'NtCreateThreadEx', 'NtResumeThread', 'NtQueueApcThread', 'NtUnmapViewOfSection', 'NtOpenProcessToken')
    THEN CASE WHEN contains(Arg0, 'cross_process=0') THEN '0xffffffff' ELSE concat('0x', lpad(lower(hex(CAST(regexp_extract(Arg0, 'target_pid=(\\d+)', 1) AS int))), 8, '0')) END END AS handle,
  CASE WHEN Api IN ('LdrLoadDll') THEN Arg0 END AS file_name FROM calls""")
def p2(spark, d):
    c = adapter(spark, d, "calls")
    a = c.select("seq", P.normalize_args(F.col("Api"), F.col("Arg0")).alias("a"))
    x = F.col("a")
    return a.select("seq", x["Protection"].alias("protection"), x["BaseAddress"].alias("base"), x["ProcessHandle"].alias("handle"), x["FileName"].alias("file_name"))


_ROWS = """
nm AS (SELECT concat('run', u % 5) AS run_id, u % 30 AS pid, arg_min(img, seq) AS pname FROM (SELECT CAST(ProcessId AS bigint) AS u, seq, concat('app', k % 9, '.exe') AS img FROM tel WHERE event_type = 'ProcessCreate') z WHERE u % 30 <> 0 GROUP BY 1, 2),
kid AS (SELECT run_id, CAST(ProcessId AS bigint) AS pid, CAST(regexp_extract(Arg0, 'child_pid=(\\d+)', 1) AS bigint) AS child, min(seq) AS born FROM calls WHERE Api = 'NtCreateUserProcess' AND regexp_extract(Arg0, 'child_pid=(\\d+)', 1) NOT IN ('', '0') AND ProcessId <> '0' GROUP BY 1, 2, 3),
rw AS (SELECT c.run_id, c.seq, CAST(c.ProcessId AS bigint) AS pid, c.Api AS api, c.Category AS category, c.Arg0 AS arg, coalesce(nm.pname, '') AS pname FROM calls c LEFT JOIN nm ON nm.run_id = c.run_id AND nm.pid = CAST(c.ProcessId AS bigint)
  LEFT JOIN kid ON kid.run_id = c.run_id AND kid.pid = CAST(c.ProcessId AS bigint) AND kid.child = CAST(nullif(regexp_extract(c.Arg0, 'target_pid=(\\d+)', 1), '') AS bigint) AND c.Api IN ('NtWriteVirtualMemory', 'NtResumeThread')
  WHERE NOT starts_with(c.Api, '__') AND NOT coalesce(kid.born < c.seq, false)),
sg AS (SELECT run_id, seq, pid, api, s.signature FROM rw, (VALUES ('allocates'), ('cross_write'), ('crypto_calls'), ('app3_sleeps')) s(signature) WHERE CASE s.signature WHEN 'allocates' THEN api = 'NtAllocateVirtualMemory'
  WHEN 'cross_write' THEN api = 'NtWriteVirtualMemory' AND contains(arg, 'cross_process=1') WHEN 'crypto_calls' THEN category = 'crypto' ELSE api = 'NtDelayExecution' AND pname = 'app3.exe' END),
mt AS (SELECT run_id, signature, min(seq) AS first_seq, arg_min(pid, seq) AS pid, arg_min(api, seq) AS api FROM sg GROUP BY 1, 2)"""


def matches(spark, d):
    return P.call_signature(P.call_rows(_calls(spark, d)), specs())


@query("p3_call_signature", using="calls tel", oracle=f"WITH {_ROWS.strip()} SELECT * FROM mt")
def p3(spark, d):
    return matches(spark, d)


_FACTS = """
ft AS (SELECT DISTINCT run_id, kind, value FROM (SELECT concat('run', CAST(ProcessId AS bigint) % 5) AS run_id, CAST(ProcessId AS bigint) % 30 AS pid, 'executed_commands' AS kind, CommandLine AS value FROM tel WHERE event_type = 'ProcessCreate'
  UNION ALL SELECT run_id, CAST(ProcessId AS bigint), k.kind, Arg0 FROM calls, (VALUES ('files', 'NtCreateFile'), ('keys', 'NtSetValueKey'), ('write_keys', 'NtSetValueKey'), ('executed_commands', 'CreateProcessW')) k(kind, call) WHERE Api = k.call) z WHERE run_id <> 'run1' OR pid IN (1, 6))"""


def _facts(spark, d):
    lineage = table(spark, d, "nation").select(F.lit("run1").alias("run_id"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(6).cast("bigint").alias("pid"))
    return P.run_facts(_calls(spark, d), lineage)


@query("p4_run_facts", using="calls tel", oracle=f"WITH {_FACTS.strip()} SELECT run_id, kind, value FROM ft")
def p4(spark, d):
    return _facts(spark, d)


FACTS = [P.FactSpec("runs_cmd", "executed_commands", [r"CMD\.exe [0-3]", "powershell"], severity=2), P.FactSpec("exact", "executed_commands", ["APP4.exe -run 40 /Q"], regex=False), P.FactSpec("cased", "executed_commands", ["APP4.exe -run 40 /q"], regex=False, cased=True)]


@query("p5_fact_signature", using="calls tel", oracle=f"""
WITH {_FACTS.strip()} SELECT run_id, 'runs_cmd' AS signature, min(value) AS evidence FROM ft WHERE kind = 'executed_commands' AND regexp_matches(value, '(?i)^(cmd\\.exe [0-3]|powershell)') GROUP BY 1
UNION ALL SELECT run_id, 'exact', min(value) FROM ft WHERE kind = 'executed_commands' AND lower(value) = 'app4.exe -run 40 /q' GROUP BY 1""")
def p5(spark, d):
    return P.fact_signature(_facts(spark, d), FACTS)


@query("p6_meta_signature", using="calls tel", oracle=f"""
WITH {_ROWS.strip()} SELECT run_id, 'combined' AS signature FROM mt WHERE signature IN ('allocates', 'app3_sleeps') GROUP BY 1 HAVING count(*) = 2""")
def p6(spark, d):
    return P.meta_signature(matches(spark, d), "combined", ["allocates", "app3_sleeps"])


@query("p7_emit_match", using="calls tel", oracle=f"""
WITH {_ROWS.strip()} SELECT run_id, signature AS name, pid, CASE signature WHEN 'allocates' THEN 'medium' ELSE 'high' END AS severity, CASE signature WHEN 'allocates' THEN 'allocates memory' WHEN 'cross_write' THEN 'writes elsewhere' ELSE '' END AS about FROM mt WHERE signature <> 'crypto_calls'""")
def p7(spark, d):
    a = P.emit_match(matches(spark, d), P.spec_table(spark, specs()), min_severity=2)
    return a.select("run_id", F.col("Name").alias("name"), F.col("ProcessId").alias("pid"), F.col("SeverityStr").alias("severity"), F.col("Description").alias("about"))


@query("p8_user_predicate", using="tel", oracle="SELECT seq FROM tel WHERE k % 9 = 4 AND k > 50")
def p8(spark, d):
    def wanted(cmd: pd.Series, k: pd.Series) -> pd.Series:
        return cmd.str.startswith("app4") & (k > 50)

    return adapter(spark, d, "tel").filter(P.user_predicate(wanted)(F.col("CommandLine"), F.col("k"))).select("seq")


@query("p8_per_process", using="calls", oracle="""
SELECT run_id, CAST(ProcessId AS bigint) AS pid, CAST(count(*) FILTER (WHERE Api = 'NtResumeThread') AS bigint) AS resumes, count(*) AS calls FROM calls GROUP BY 1, 2""")
def p8_per_process(spark, d):
    def on_calls(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "pid": [pdf["pid"].iloc[0]], "resumes": [int((pdf["api"] == "NtResumeThread").sum())], "calls": [len(pdf)]})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return parts[:1].assign(resumes=parts["resumes"].sum(), calls=parts["calls"].sum())

    return P.per_process(trace_rows(adapter(spark, d, "calls")), on_calls, "run_id string, pid bigint, resumes bigint, calls bigint", ["api"], merge, chunk=4000)


class ResumeAfterWrite(P.CallSignature):
    """A thread resume with an earlier write of the same process; at the end how often, and the longest run of one call."""

    def start(self):
        self.written, self.found, self.last, self.streak, self.longest, self.key = None, 0, None, 0, 0, None

    def on_call(self, row):
        self.key = (row["run_id"], row["pid"])
        self.streak = self.streak + 1 if row["api"] == self.last else 1
        self.longest, self.last = max(self.longest, self.streak), row["api"]
        if row["api"] == "NtWriteVirtualMemory" and self.written is None:
            self.written = row["seq"]
        elif row["api"] == "NtResumeThread" and self.written is not None:
            self.found += 1
            yield (*self.key, "resume", row["seq"], row["seq"] - self.written)

    def on_complete(self):
        if self.key is not None:
            yield (*self.key, "total", self.found, self.longest)


@query("p8_table_function", using="calls", oracle="""
WITH c AS (SELECT run_id, CAST(ProcessId AS bigint) AS pid, seq, Api AS api, min(seq) FILTER (WHERE Api = 'NtWriteVirtualMemory') OVER (PARTITION BY run_id, ProcessId) AS written,
  row_number() OVER (PARTITION BY run_id, ProcessId ORDER BY seq) - row_number() OVER (PARTITION BY run_id, ProcessId, Api ORDER BY seq) AS grp FROM calls),
s AS (SELECT run_id, pid, max(n) AS longest FROM (SELECT run_id, pid, api, grp, count(*) AS n FROM c GROUP BY ALL) y GROUP BY 1, 2),
h AS (SELECT run_id, pid, seq, seq - written AS gap FROM c WHERE api = 'NtResumeThread' AND seq > written)
SELECT run_id, pid, 'resume' AS kind, seq AS at, gap AS value FROM h
UNION ALL SELECT s.run_id, s.pid, 'total', count(h.seq), max(s.longest) FROM s LEFT JOIN h ON h.run_id = s.run_id AND h.pid = s.pid GROUP BY 1, 2""")
def p8_table_function(spark, d):
    rows = trace_rows(adapter(spark, d, "calls")).select("run_id", "pid", "seq", "api")
    return P.run_signature(rows, ResumeAfterWrite, "run_id string, pid bigint, kind string, at bigint, value bigint", "resume_after_write")


@query("p8_keyword_spans", oracle="""
WITH w(word) AS (VALUES ('the'), ('and')), c AS (SELECT doc_id, word, len(regexp_extract_all(concat(' ', regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), ' '), concat('(?i)[^\\p{L}\\p{N}_]', word, '[^\\p{L}\\p{N}_]'))) AS n FROM documents, w) SELECT doc_id, word, CAST(n AS bigint) AS n FROM c WHERE n > 0""")
def p8_spans(spark, d):
    t = F.concat(F.lit(" "), F.regexp_replace("text", r"([^\p{L}\p{N}_])", "$1$1"), F.lit(" "))
    x = table(spark, d, "documents").select("doc_id", F.explode(P.keyword_spans(t, ["the", "and"])).alias("s"))
    return x.select("doc_id", "s.word", F.col("s.n").cast("bigint").alias("n"))
