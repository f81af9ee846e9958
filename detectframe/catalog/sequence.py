"""Queries of SURVEY 2.G."""

from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import adapter, query, table
from detectframe.catalog.joins import trace_and_host
from detectframe.functions.scalar import micros
from detectframe.operators import sequence as G

PARSED = """
c AS (SELECT run_id, CAST(ProcessId AS bigint) AS actor, seq, Api AS api, Category AS category, Arg0 AS arg, CAST(nullif(regexp_extract(Arg0, 'target_pid=(\\d+)', 1), '') AS bigint) AS target,
  regexp_extract(Arg0, 'cross_process=(\\d)', 1) = '1' AS crossp, regexp_extract(Arg0, 'executable=(\\d)', 1) = '1' AS ex, coalesce(CAST(nullif(regexp_extract(Arg0, ' size=(\\d+)', 1), '') AS bigint), 0) AS size,
  CAST(nullif(regexp_extract(Arg0, 'delay_ms=(\\d+)', 1), '') AS bigint) AS delay, regexp_extract(Arg0, 'alertable=(\\d)', 1) = '1' AS alertable, regexp_extract(Arg0, 'apc=(\\d)', 1) = '1' AS apc,
  CAST(nullif(regexp_extract(Arg0, 'child_pid=(\\d+)', 1), '') AS bigint) AS child, regexp_extract(Arg0, 'ppid_spoofed=(\\d)', 1) = '1' AS spoofed, regexp_extract(Arg0, ' ppid=(\\d+)', 1) AS ppid FROM calls),
chain AS (SELECT run_id, actor, target, min(seq) FILTER (WHERE NOT (api = 'NtUnmapViewOfSection' AND NOT crossp)) AS first_seq, bool_or(api = 'NtWriteVirtualMemory') AS w, bool_or(api IN ('NtCreateThreadEx', 'NtQueueApcThread', 'NtResumeThread')) AS st, bool_or(api = 'NtUnmapViewOfSection' AND crossp) AS um
  FROM c WHERE target IS NOT NULL AND api IN ('NtWriteVirtualMemory', 'NtCreateThreadEx', 'NtQueueApcThread', 'NtResumeThread', 'NtUnmapViewOfSection') GROUP BY 1, 2, 3),
chains AS (SELECT * FROM chain WHERE (w AND st) OR (um AND (w OR st))), kids AS (SELECT DISTINCT run_id, actor, child AS target FROM c WHERE api = 'NtCreateUserProcess' AND child <> 0)"""


def _show(df):
    return df.select("run_id", "actor", "target", "first_seq", "detail")


def _g(name, etype, sql):
    @query(name, using="calls", oracle=f"WITH {PARSED.strip()}{'' if sql.startswith(',') else ' '}{sql}")
    def run(spark, d):
        return _show(G.signature(adapter(spark, d, "calls"), etype))

    return run


_NOT = "NOT EXISTS (SELECT 1 FROM {t} x WHERE x.run_id = c.run_id AND x.actor = c.actor AND x.target = c.target)"
_NOCHAIN, _NOKID = _NOT.format(t="chains"), _NOT.format(t="kids")

_g("g1_injection_chain", "ApitraceInjectionChain", """
SELECT run_id, actor, target, first_seq, CASE WHEN um THEN concat('Process hollowing into ', target, ': image unmapped, then written/started') ELSE concat('Write into remote process ', target, ' followed by thread start/resume') END AS detail FROM chains""")
_g("g2_cross_process_write", "ApitraceCrossProcessWrite", f"""
SELECT run_id, actor, target, min(seq) AS first_seq, concat('Cross-process write into process ', target) AS detail FROM c WHERE api = 'NtWriteVirtualMemory' AND target <> actor AND {_NOCHAIN} AND {_NOKID} GROUP BY 1, 2, 3""")
_g("g3_exec_memory", "ApitraceExecProtection", """, g AS (SELECT run_id, actor, min(seq) AS first_seq, count(*) FILTER (WHERE api = 'NtProtectVirtualMemory') AS fl, count(*) FILTER (WHERE api = 'NtAllocateVirtualMemory') AS al FROM c
  WHERE ex AND (api = 'NtAllocateVirtualMemory' OR (api = 'NtProtectVirtualMemory' AND (crossp OR size >= 4096))) GROUP BY 1, 2)
SELECT run_id, actor, CAST(NULL AS bigint) AS target, first_seq, CASE WHEN fl > 0 THEN 'Memory protection changed to executable' ELSE concat(al, ' executable memory allocations') END AS detail FROM g WHERE fl > 0 OR al >= 100""")
_g("g4_remote_thread", "ApitraceRemoteThread", f"""
SELECT run_id, actor, target, min(seq) AS first_seq, concat(CASE WHEN arg_min(api, seq) = 'NtCreateThreadEx' THEN 'Remote thread start via ' ELSE 'Remote thread resume via ' END, arg_min(api, seq), ' on process ', target) AS detail FROM c
WHERE target IS NOT NULL AND (api = 'NtResumeThread' OR (api IN ('NtCreateThreadEx', 'NtQueueApcThread') AND crossp AND target <> actor)) AND {_NOCHAIN} GROUP BY 1, 2, 3""")
_g("g5_module_load", "ApitraceReflectiveLoad", """
SELECT run_id, actor, CAST(NULL AS bigint) AS target, min(seq) AS first_seq, concat('Module loaded from user-writable/UNC path: ', arg_min(arg, seq)) AS detail FROM c WHERE api = 'LdrLoadDll' AND arg LIKE 'C:%Users%' GROUP BY run_id, actor, lower(arg)""")
_g("g6_timing_evasion", "ApitraceAntiSandboxTiming", """, s AS (SELECT *, api IN ('GetTickCount64', 'NtQuerySystemTime') AS poll, api = 'NtSetTimer' AND apc AS ta, api IN ('NtDelayExecution', 'NtSetTimer') AND NOT (api = 'NtSetTimer' AND apc) AND NOT alertable AND delay BETWEEN 0 AND 86400000 AS sl FROM c),
g AS (SELECT run_id, actor, min(seq) AS first_seq, count(*) FILTER (WHERE poll) AS np, bool_or(ta) AS ta, bool_or(sl AND delay >= 60000) AS vl, bool_or(sl AND delay >= 10000 AND delay < 60000) AS lo FROM s WHERE poll OR ta OR (sl AND delay >= 10000) GROUP BY 1, 2)
SELECT run_id, actor, CAST(NULL AS bigint) AS target, first_seq, CASE WHEN ta THEN 'Code execution scheduled via timer APC (sleep-obfuscation family)' WHEN vl THEN 'Very long relative delay (>= 60s) inside the analysis window'
  ELSE 'Timing-source polling combined with a long delay (time-acceleration check)' END AS detail FROM g WHERE ta OR vl OR (np >= 3 AND lo)""")
_g("g7_crypto_burst", "ApitraceCryptoBurst", """
SELECT run_id, actor, CAST(NULL AS bigint) AS target, min(seq) AS first_seq, concat(count(*), ' bulk encrypt/decrypt operations from one process') AS detail FROM c WHERE api IN ('BCryptEncrypt', 'BCryptDecrypt') GROUP BY 1, 2 HAVING count(*) >= 25""")
_g("g8_token_manipulation", "ApitraceTokenManipulation", """, g AS (SELECT run_id, actor, min(seq) AS first_seq, bool_or(api = 'NtAdjustPrivilegesToken') AS ad, bool_or(api = 'NtOpenProcessToken') AS op, bool_or(api = 'NtDuplicateToken') AS du,
  arg_min(arg, seq) FILTER (WHERE api = 'NtAdjustPrivilegesToken') AS aarg, arg_min(target, seq) FILTER (WHERE api = 'NtOpenProcessToken') AS tgt FROM c WHERE api IN ('NtAdjustPrivilegesToken', 'NtOpenProcessToken', 'NtDuplicateToken') GROUP BY 1, 2)
SELECT run_id, actor, tgt AS target, first_seq, CASE WHEN ad THEN concat('Privilege escalation followed by token action (', aarg, ')') ELSE concat('Token of process ', tgt, ' opened and duplicated (token theft)') END AS detail FROM g WHERE op AND (ad OR du)""")
_g("g9_cross_process_read", "ApitraceCrossProcessRead", f"""
SELECT run_id, actor, target, min(seq) AS first_seq, concat('Cross-process memory read from process ', target) AS detail FROM c WHERE api = 'NtReadVirtualMemory' AND target IS NOT NULL AND {_NOKID} GROUP BY 1, 2, 3""")
_g("g10_anti_debug", "ApitraceAntiDebug", """
SELECT run_id, actor, CAST(NULL AS bigint) AS target, min(seq) AS first_seq, concat('Anti-debugging behavior (', arg_min(arg, seq), ')') AS detail FROM c WHERE api = 'NtSetInformationThread' GROUP BY 1, 2""")
_g("g11_anti_tamper", "ApitraceAntiTamper", """
SELECT run_id, actor, CAST(NULL AS bigint) AS target, min(seq) AS first_seq, concat('Memory write/protect inside ', CASE WHEN contains(arg_min(arg, seq), 'targets_module=ntdll') THEN 'ntdll' ELSE 'amsi.dll' END, ' (unhooking / ETW-AMSI blinding attempt)') AS detail FROM c WHERE contains(arg, 'targets_module=') GROUP BY 1, 2""")
_g("g12_transaction_abuse", "ApitraceTransactionAbuse", """
SELECT run_id, actor, CAST(NULL AS bigint) AS target, min(seq) AS first_seq, 'NTFS transaction created (process doppelganging primitive)' AS detail FROM c WHERE api = 'NtCreateTransaction' GROUP BY 1, 2""")
_g("g13_parent_spoof", "ApitracePpidSpoof", """
SELECT run_id, actor, CAST(NULL AS bigint) AS target, min(seq) AS first_seq, concat('Parent-PID spoof: child created naming pid ', arg_min(ppid, seq), ' as parent') AS detail FROM c WHERE api = 'NtCreateUserProcess' AND spoofed GROUP BY 1, 2""")
_g("g14_trace_truncated", "ApiTraceTruncated", """
SELECT run_id, actor, CAST(NULL AS bigint) AS target, min(seq) AS first_seq, CASE WHEN count(DISTINCT api) = 2 THEN 'API-trace volume cap reached and collector pipe was lost; sequence is incomplete' WHEN min(api) = '__pipe_lost__' THEN 'Collector pipe was lost and reconnected; events missing in the gap'
  ELSE 'API-trace volume cap reached; sequence may be incomplete' END AS detail FROM c WHERE category = 'meta' AND api IN ('__event_cap_reached__', '__pipe_lost__') GROUP BY 1, 2""")


@query("g_all_signatures", using="calls", oracle=f"""
WITH {PARSED.strip()}, k AS (SELECT 'ApitraceInjectionChain' AS event_type, count(*) AS n FROM chains
 UNION ALL SELECT 'ApitraceCryptoBurst', count(*) FROM (SELECT 1 FROM c WHERE api IN ('BCryptEncrypt', 'BCryptDecrypt') GROUP BY run_id, actor HAVING count(*) >= 25) x
 UNION ALL SELECT 'ApitraceAntiDebug', count(*) FROM (SELECT DISTINCT run_id, actor FROM c WHERE api = 'NtSetInformationThread') x
 UNION ALL SELECT 'ApitraceTransactionAbuse', count(*) FROM (SELECT DISTINCT run_id, actor FROM c WHERE api = 'NtCreateTransaction') x
 UNION ALL SELECT 'ApiTraceTruncated', count(*) FROM (SELECT DISTINCT run_id, actor FROM c WHERE category = 'meta') x
 UNION ALL SELECT 'ApitraceCrossProcessRead', count(*) FROM (SELECT DISTINCT run_id, actor, target FROM c WHERE api = 'NtReadVirtualMemory' AND target IS NOT NULL AND {_NOKID}) x) SELECT * FROM k WHERE n > 0""")
def g_all(spark, d):
    """Every call signature in three aggregations over the stream."""
    x = G.all_signatures(adapter(spark, d, "calls")).groupBy("event_type").agg(F.count("*").alias("n"))
    return x.filter(F.col("event_type").isin("ApitraceInjectionChain", "ApitraceCryptoBurst", "ApitraceAntiDebug", "ApitraceTransactionAbuse", "ApiTraceTruncated", "ApitraceCrossProcessRead"))


# the evidence rows of every alert, written by hand: type, group inside (run, actor), place of the slot, rows it holds
EVIDENCE = f"""
n AS (SELECT c.*, api IN ('GetTickCount64', 'NtQuerySystemTime') AS poll, api = 'NtSetTimer' AND apc AS ta, ex AND (api = 'NtProtectVirtualMemory' AND (crossp OR size >= 4096)) AS flip, ex AND api = 'NtAllocateVirtualMemory' AS alloc,
  CASE WHEN api IN ('NtDelayExecution', 'NtSetTimer') AND NOT (api = 'NtSetTimer' AND apc) AND NOT alertable AND delay BETWEEN 0 AND 86400000 THEN delay ELSE -1 END AS slept FROM c),
f AS (SELECT run_id, actor, count(*) FILTER (WHERE flip) AS fl, count(*) FILTER (WHERE alloc) AS al, count(*) FILTER (WHERE poll) AS np, bool_or(ta) AS ta, bool_or(slept >= 60000) AS vl, bool_or(slept >= 10000 AND slept < 60000) AS lo,
  count(*) FILTER (WHERE api IN ('BCryptEncrypt', 'BCryptDecrypt')) AS cr, bool_or(api = 'NtAdjustPrivilegesToken') AS ad, bool_or(api = 'NtOpenProcessToken') AS op, bool_or(api = 'NtDuplicateToken') AS du FROM n GROUP BY 1, 2),
x AS (SELECT n.*, f.fl, f.al, f.np, f.ta AS any_ta, f.vl, f.lo, f.cr, f.ad, f.op, f.du FROM n JOIN f ON n.run_id = f.run_id AND n.actor = f.actor),
e AS (
  SELECT 'ApitraceInjectionChain' AS event_type, CAST(target AS varchar) AS grp, CASE WHEN api = 'NtUnmapViewOfSection' THEN 1 WHEN api = 'NtWriteVirtualMemory' THEN 2 WHEN api = 'NtResumeThread' THEN 4 ELSE 3 END AS slot, 1 AS k, c.* FROM c
    WHERE target IS NOT NULL AND (api IN ('NtWriteVirtualMemory', 'NtCreateThreadEx', 'NtQueueApcThread', 'NtResumeThread') OR (api = 'NtUnmapViewOfSection' AND crossp)) AND NOT {_NOCHAIN}
  UNION ALL SELECT 'ApitraceCrossProcessWrite', CAST(target AS varchar), 1, 1, c.* FROM c WHERE api = 'NtWriteVirtualMemory' AND target <> actor AND {_NOCHAIN} AND {_NOKID}
  UNION ALL SELECT 'ApitraceExecProtection', '', 1, 1, c.* FROM x JOIN c ON c.run_id = x.run_id AND c.seq = x.seq WHERE (x.fl > 0 AND x.flip) OR (x.fl = 0 AND x.al >= 100 AND x.alloc)
  UNION ALL SELECT 'ApitraceRemoteThread', CAST(target AS varchar), 1, 1, c.* FROM c WHERE target IS NOT NULL AND (api = 'NtResumeThread' OR (api IN ('NtCreateThreadEx', 'NtQueueApcThread') AND crossp AND target <> actor)) AND {_NOCHAIN}
  UNION ALL SELECT 'ApitraceReflectiveLoad', lower(arg), 1, 1, c.* FROM c WHERE api = 'LdrLoadDll' AND arg LIKE 'C:%Users%'
  UNION ALL SELECT 'ApitraceReflectiveLoad', concat('@', b.seq), CASE WHEN c.seq = b.seq THEN 2 ELSE 1 END, 1, c.* FROM
    (SELECT s.run_id, s.actor, s.seq, min(a.seq) AS first FROM c s JOIN c a ON a.run_id = s.run_id AND a.actor = s.actor AND regexp_extract(a.arg, 'base=(\\S+)', 1) = regexp_extract(s.arg, 'start=(\\S+)', 1) AND a.seq < s.seq
      WHERE a.api = 'NtAllocateVirtualMemory' AND a.ex AND s.api IN ('NtCreateThreadEx', 'NtResumeThread', 'NtQueueApcThread') AND regexp_extract(s.arg, 'start=(\\S+)', 1) NOT IN ('', '0x0') GROUP BY 1, 2, 3) b
    JOIN c ON c.run_id = b.run_id AND c.seq IN (b.seq, b.first)
  UNION ALL SELECT 'ApitraceAntiSandboxTiming', '', CASE WHEN x.ta OR x.poll THEN 1 ELSE 2 END, 1, c.* FROM x JOIN c ON c.run_id = x.run_id AND c.seq = x.seq
    WHERE CASE WHEN x.any_ta THEN x.ta WHEN x.vl THEN x.poll OR x.slept >= 60000 WHEN x.np >= 3 AND x.lo THEN x.poll OR x.slept >= 10000 END
  UNION ALL SELECT 'ApitraceCryptoBurst', '', 1, 3, c.* FROM x JOIN c ON c.run_id = x.run_id AND c.seq = x.seq WHERE x.cr >= 25 AND x.api IN ('BCryptEncrypt', 'BCryptDecrypt')
  UNION ALL SELECT 'ApitraceTokenManipulation', '', CASE x.api WHEN 'NtAdjustPrivilegesToken' THEN 1 WHEN 'NtOpenProcessToken' THEN 2 ELSE 3 END, 1, c.* FROM x JOIN c ON c.run_id = x.run_id AND c.seq = x.seq
    WHERE x.op AND (x.ad OR x.du) AND (x.api IN ('NtAdjustPrivilegesToken', 'NtOpenProcessToken') OR (x.api = 'NtDuplicateToken' AND NOT x.ad))
  UNION ALL SELECT 'ApitraceCrossProcessRead', CAST(target AS varchar), 1, 1, c.* FROM c WHERE api = 'NtReadVirtualMemory' AND target IS NOT NULL AND {_NOKID}
  UNION ALL SELECT 'ApitraceAntiDebug', '', 1, 2, c.* FROM c WHERE api = 'NtSetInformationThread'
  UNION ALL SELECT 'ApitraceAntiTamper', '', 1, 2, c.* FROM c WHERE contains(arg, 'targets_module=')
  UNION ALL SELECT 'ApitraceTransactionAbuse', '', 1, 1, c.* FROM c WHERE api = 'NtCreateTransaction'
  UNION ALL SELECT 'ApitracePpidSpoof', '', 1, 1, c.* FROM c WHERE api = 'NtCreateUserProcess' AND spoofed
  UNION ALL SELECT 'ApiTraceTruncated', '', 1, 1, c.* FROM c WHERE category = 'meta' AND api IN ('__event_cap_reached__', '__pipe_lost__')),
first AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_type, run_id, actor, grp, slot ORDER BY seq) <= k),
placed AS (SELECT first.*, row_number() OVER (PARTITION BY first.event_type, first.run_id, actor, grp ORDER BY slot, first.seq) AS pos, epoch_us(calls.ts) AS us FROM first JOIN calls ON calls.run_id = first.run_id AND calls.seq = first.seq),
shown AS (SELECT *, arg = lag(arg) OVER (PARTITION BY event_type, run_id, actor, grp ORDER BY pos) AS again, row_number() OVER (PARTITION BY event_type, run_id, actor, grp, api ORDER BY pos) = 1 AS new_api FROM placed)"""


@query("g_evidence", using="calls", oracle=f"""
WITH {PARSED.strip()}, {EVIDENCE.strip()}
SELECT run_id, actor, event_type, CASE WHEN event_type IN ('ApitraceInjectionChain', 'ApitraceCrossProcessWrite', 'ApitraceRemoteThread', 'ApitraceCrossProcessRead') THEN max(target) WHEN event_type = 'ApitraceTokenManipulation' THEN max(target) FILTER (WHERE api = 'NtOpenProcessToken')
    WHEN event_type = 'ApitracePpidSpoof' THEN max(child) END AS target, arg_max(us, pos) AS ts_us, string_agg(api, ',' ORDER BY pos) FILTER (WHERE new_api) AS apis, string_agg(arg, '|' ORDER BY pos) FILTER (WHERE NOT coalesce(again, false)) AS samples, count(*) AS n_evidence
FROM shown GROUP BY event_type, run_id, actor, grp""")
def g_evidence(spark, d):
    """Every signature's alerts with their time, the calls behind them and samples of the arguments."""
    x = G.as_alerts(G.all_signatures(adapter(spark, d, "calls")))
    return x.select(
        "run_id", "actor", "event_type", F.col("named_pid").alias("target"), micros(F.col("ts")).alias("ts_us"), F.array_join("apis", ",").alias("apis"),
        F.array_join("samples", "|").alias("samples"), F.size("evidence").cast("long").alias("n_evidence"))


@query("g5_module_load_both", using="calls", oracle=f"""
WITH {PARSED.strip()}, {EVIDENCE.strip()}
SELECT run_id, actor, arg_max(us, pos) AS ts_us, arg_max(seq, pos) AS seq, CASE WHEN max(pos) = 1 THEN concat('Module loaded from user-writable/UNC path: ', max(arg))
  ELSE concat('Executable allocation at ', regexp_extract(arg_max(arg, pos), 'start=(\\S+)', 1), ' followed by thread start at the same address (reflective load)') END AS detail
FROM shown WHERE event_type = 'ApitraceReflectiveLoad' GROUP BY run_id, actor, grp""")
def g5_both(spark, d):
    """Loads from unusual paths and threads started in executable allocations, in one result."""
    x = G.as_alerts(G.module_loads(adapter(spark, d, "calls")))
    return x.select("run_id", "actor", micros(F.col("ts")).alias("ts_us"), F.element_at("evidence", -1)["seq"].alias("seq"), "detail")


_BOTH = sorted({a for apis in fixed.EVENT_CALLS.values() for a in apis})


@query("g16_trace_silence", oracle="""
WITH x AS (SELECT concat('run', user_id % 5) AS run_id, user_id AS u, ts, event_type AS e, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM events),
t AS (SELECT *, e = 'purchase' OR k % 4 < 3 OR NOT ((k = 99 AND u % 3 = 0) OR k = 95) AS call, k = 99 AND u % 3 = 0 AND e = 'click' AS cap FROM x WHERE e IN ('click', 'purchase')),
f AS (SELECT run_id, u, count(*) FILTER (WHERE call) AS n, bool_or(cap) AS capped, max(ts) FILTER (WHERE call AND NOT cap) AS last FROM t GROUP BY 1, 2), r AS (SELECT run_id, max(ts) AS run_end FROM x GROUP BY 1),
g AS (SELECT f.*, (epoch_us(run_end) - epoch_us(last)) / 1000000.0 AS span FROM f JOIN r ON f.run_id = r.run_id WHERE n >= 5 AND NOT capped AND epoch_us(run_end) - epoch_us(last) >= 21600000000)
SELECT g.run_id, g.u AS pid, count(*) AS host_events FROM g JOIN x ON x.run_id = g.run_id AND x.u = g.u AND x.e NOT IN ('click', 'purchase') AND x.ts > g.last GROUP BY 1, 2 HAVING count(*) >= 3""")
def g16(spark, d):
    return G.trace_silence(trace_and_host(spark, d), _BOTH, min_events=3, min_s=6 * 3600).select("run_id", "pid", "host_events")


@query("g17_driver_alerts", oracle="""
WITH x AS (SELECT event_id AS n, user_id AS u, event_id % 7 AS j, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM events)
SELECT n AS seq, CASE j WHEN 1 THEN 'GuardianProtectedAccess' WHEN 2 THEN 'GuardianProtectedRegistry' WHEN 3 THEN 'GuardianModuleRemap' ELSE 'GuardianInjectionFailed' END AS event_type,
  CASE j WHEN 1 THEN concat('Access to protected process ', k, ' denied for pid ', u, ' (stripped access mask 0x', lower(hex(k)), ')') WHEN 2 THEN concat('Registry write/delete on protected key denied for pid ', u, ': txt')
    WHEN 3 THEN concat('Module mapped twice into pid ', k, ' (possible ntdll/amsi remap): txt') ELSE concat('Guardian placement APC into pid ', k, ' failed (NTSTATUS 0x', lpad(lower(hex(k)), 8, '0'), ')') END AS detail FROM x WHERE j IN (1, 2, 3, 5)""")
def g17(spark, d):
    n = F.col("event_id")
    k = F.regexp_extract("props", "[0-9]+", 0)
    ev = table(spark, d, "events").select(
        F.lit("r").alias("run_id"), n.alias("seq"), "ts", F.lit("guardian").alias("source"), (9400 + n % 7).cast("int").alias("event_id"), F.col("user_id").cast("string").alias("ProcessId"),
        k.alias("TargetProcessId"), F.lit("txt").alias("Text"), k.alias("Value"))
    return G.driver_alerts(ev).select("seq", "event_type", "detail")
