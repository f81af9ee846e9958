"""Signatures over a process's call stream.

A signature is a spec: rows it looks at, conditional aggregates per actor (or
actor and target), a condition, a text.  All specs of one key are evaluated by a
single ``groupBy`` with map-side partial aggregation, so 13 signatures cost one
shuffle of small buffers, and one busy actor never sits in one task.

A hit names its evidence: each spec lists slots, a slot holds the first rows of one
kind.  A slot of one row is a minimum in the same aggregation; slots of two or three
rows are cut to that many per key in every task before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import as_int, kv_bool, kv_int, let, micros, parse_kv
from detectframe.operators.joins import alloc_then_start, own_children, trace_rows
from detectframe.scale import any_true
from detectframe.schema import fld

ACTOR = ["run_id", "actor"]
PAIR = ["run_id", "actor", "target"]


def calls(events: DataFrame) -> DataFrame:
    """Call-trace rows with the argument parsed once: actor, target and the flags specs use."""
    t = trace_rows(events).select(
        "run_id", "seq", "ts", F.col("pid").alias("actor"), "api", F.coalesce("arg", F.lit("")).alias("arg"), "category",
    ).filter(F.col("actor").isNotNull())
    parsed = let(parse_kv(F.col("arg")), lambda kv: F.struct(
        kv_int(kv, "target_pid").alias("target"), kv_bool(kv, "cross_process").alias("cross"), kv_bool(kv, "executable").alias("executable"),
        F.coalesce(kv_int(kv, "size"), F.lit(0)).alias("size"), kv_int(kv, "delay_ms").alias("delay"), kv_bool(kv, "alertable").alias("alertable"),
        kv_bool(kv, "apc").alias("apc"), kv_int(kv, "child_pid").alias("child"), kv_bool(kv, "ppid_spoofed").alias("spoofed"), kv["ppid"].alias("ppid"),
    ))
    # generated, so that filters on parsed values do not parse the argument a second time
    return t.select("run_id", "seq", "ts", "actor", "api", "arg", "category", F.explode(F.array(parsed)).alias("p")).select(
        "run_id", "seq", "ts", "actor", "api", "arg", "category", "p.*")


@dataclass
class Slot:
    """The first ``k`` rows of one kind; part of the evidence if ``use`` holds over the aggregates."""

    rows: Column
    k: int = 1
    use: Column | None = None


@dataclass
class Spec:
    event_type: str
    event_id: int
    keys: list[str]
    rows: Column  # rows the signature looks at
    aggs: dict[str, Column]  # name -> aggregate over those rows
    fires: Column  # over the aggregate names
    detail: Column
    apis: list[str] | None = None  # call names the signature can look at, if it is that narrow
    target: str | None = None  # aggregate that names the target, where the keys do not
    slots: list[Slot] = field(default_factory=list)  # evidence in order; none: the first row
    named: str | None = None  # aggregate with the process an alert names, where that is not the target


def text(name: str, *values: Column) -> Column:
    """An alert text with its places filled."""
    parts = fixed.ALERT_TEXTS[name].split("{}")
    filled = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        filled += [value.cast("string"), F.lit(part)]
    return F.concat(*filled)


def _api(*names: str) -> Column:
    return F.col("api").isin(list(names))


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def _has(cond: Column) -> Column:
    return F.max(F.coalesce(cond, F.lit(False)))


def specs() -> dict[str, Spec]:
    """G1-G14 keyed by the event type of their alert."""
    col, lit = F.col, F.lit
    write, resume = _api("NtWriteVirtualMemory"), _api("NtResumeThread")
    thread, unmap = _api(*fixed.THREAD_APIS), _api(*fixed.UNMAP_APIS) & col("cross")
    chain_apis = ["NtWriteVirtualMemory", "NtResumeThread", *fixed.THREAD_APIS, *fixed.UNMAP_APIS]
    started = col("thread") | col("resume")
    has_target = col("target").isNotNull()
    flip = _api("NtProtectVirtualMemory") & col("executable") & (col("cross") | (col("size") >= fixed.EXEC_REGION_MIN))
    alloc = _api(*fixed.ALLOC_APIS) & col("executable")
    polls = _api("GetTickCount64", "NtQuerySystemTime")
    timer_apc = _api("NtSetTimer") & col("apc")
    sleep = _api("NtDelayExecution", "NtSetTimer") & ~timer_apc & ~col("alertable") & two_valued(col("delay").between(0, fixed.MAX_DELAY_MS))
    very_long, long_ = sleep & (col("delay") >= fixed.VERY_LONG_DELAY_MS), sleep & (col("delay") >= fixed.LONG_DELAY_MS) & (col("delay") < fixed.VERY_LONG_DELAY_MS)
    adjust, opened, dup = _api("NtAdjustPrivilegesToken"), _api("NtOpenProcessToken"), _api("NtDuplicateToken")
    crypt = _api("BCryptEncrypt", "BCryptDecrypt")
    debug = _api("NtSetInformationThread", "NtSetInformationProcess")
    tamper = col("arg").contains("targets_module=")
    spoof = _api("NtCreateUserProcess") & col("spoofed")
    marks = _api(fixed.META_CAP, fixed.META_LOST) & two_valued(col("category") == "meta")
    low = F.lower(col("arg"))
    remote = (_api(*fixed.THREAD_APIS) & col("cross") & (col("target") != col("actor"))) | resume
    first = lambda what, cond: F.min_by(what, F.when(cond, col("seq")))
    out = [
        Spec("ApitraceInjectionChain", 9201, PAIR, has_target & (write | thread | resume | unmap),
             {"write": _has(write), "thread": _has(thread), "resume": _has(resume), "unmap": _has(unmap)},
             (col("write") & started) | (col("unmap") & (col("write") | started)),
             F.when(col("unmap"), text("hollowing", col("target")))
             .otherwise(text("chain", col("target"))),
             chain_apis, slots=[Slot(unmap), Slot(write), Slot(thread), Slot(resume)]),
        Spec("ApitraceCrossProcessWrite", 9202, PAIR, has_target & write & (col("target") != col("actor")), {},
             lit(True), text("cross_write", col("target")), ["NtWriteVirtualMemory"]),
        Spec("ApitraceExecProtection", 9203, ACTOR, flip | alloc, {"flips": _n(flip), "allocs": _n(alloc)},
             (col("flips") > 0) | (col("allocs") >= fixed.EXEC_ALLOC_MIN),
             F.when(col("flips") > 0, text("exec_flip"))
             .otherwise(text("exec_allocs", col("allocs"))),
             ["NtProtectVirtualMemory", *fixed.ALLOC_APIS], slots=[Slot(flip), Slot(alloc, use=col("flips") == 0)]),
        Spec("ApitraceRemoteThread", 9204, PAIR, has_target & remote, {"via": first(col("api"), has_target & remote)}, lit(True),
             F.when(col("via") == "NtCreateThreadEx", text("thread_start", col("via"), col("target"))).otherwise(text("thread_resume", col("via"), col("target"))), [*fixed.THREAD_APIS, "NtResumeThread"]),
        Spec("ApitraceAntiSandboxTiming", 9207, ACTOR, polls | timer_apc | very_long | long_,
             {"polls": _n(polls), "apc": _has(timer_apc), "very_long": _has(very_long), "long": _has(long_)},
             col("apc") | col("very_long") | ((col("polls") >= fixed.POLL_MIN) & col("long")),
             F.when(col("apc"), text("timer_apc"))
             .when(col("very_long"), text("very_long"))
             .otherwise(text("polling")),
             ["GetTickCount64", "NtQuerySystemTime", "NtDelayExecution", "NtSetTimer"],
             slots=[Slot(timer_apc), Slot(polls, use=~col("apc")), Slot(very_long, use=~col("apc")), Slot(long_, use=~col("apc") & ~col("very_long"))]),
        Spec("ApitraceCryptoBurst", 9208, ACTOR, crypt, {"ops": _n(crypt)},
             col("ops") >= fixed.CRYPTO_MIN, text("crypto", col("ops")),
             ["BCryptEncrypt", "BCryptDecrypt"], slots=[Slot(crypt, 3)]),
        Spec("ApitraceTokenManipulation", 9209, ACTOR, adjust | opened | dup,
             {"adjust": _has(adjust), "open": _has(opened), "dup": _has(dup), "tok": first(col("target"), opened), "adj": first(col("arg"), adjust)},
             col("open") & (col("adjust") | col("dup")),
             F.when(col("adjust"), text("token_adjust", col("adj")))
             .otherwise(text("token_theft", F.coalesce(col("tok").cast("string"), lit("None")))),
             ["NtAdjustPrivilegesToken", "NtOpenProcessToken", "NtDuplicateToken"], target="tok",
             slots=[Slot(adjust), Slot(opened), Slot(dup, use=~col("adjust"))]),
        Spec("ApitraceCrossProcessRead", 9211, PAIR, has_target & _api("NtReadVirtualMemory"), {}, lit(True),
             text("cross_read", col("target")), ["NtReadVirtualMemory"]),
        Spec("ApitraceAntiDebug", 9210, ACTOR, debug, {"debug_arg": first(col("arg"), debug)}, lit(True),
             text("anti_debug", col("debug_arg")), ["NtSetInformationThread", "NtSetInformationProcess"], slots=[Slot(debug, 2)]),
        Spec("ApitraceAntiTamper", 9212, ACTOR, tamper, {"tamper_arg": first(col("arg"), tamper)}, lit(True),
             text("anti_tamper", F.when(col("tamper_arg").contains("targets_module=ntdll"), "ntdll").otherwise("amsi.dll")), slots=[Slot(tamper, 2)]),
        Spec("ApitraceTransactionAbuse", 9213, ACTOR, _api("NtCreateTransaction"), {}, lit(True),
             text("transaction"), ["NtCreateTransaction"]),
        Spec("ApitracePpidSpoof", 9214, ACTOR, spoof, {"named": first(F.coalesce(col("ppid"), lit("None")), spoof), "made": first(F.struct("child"), spoof)}, lit(True),
             text("ppid_spoof", col("named")), ["NtCreateUserProcess"], named="made.child"),
        Spec("ApiTraceTruncated", 9206, ACTOR, marks,
             {"cap": _has(marks & _api(fixed.META_CAP)), "lost": _has(marks & _api(fixed.META_LOST))}, lit(True),
             F.when(col("lost") & col("cap"), text("cap_and_loss"))
             .when(col("lost"), text("pipe_lost"))
             .otherwise(text("capped")), [fixed.META_CAP, fixed.META_LOST]),
    ]
    loads = (
        _api("LdrLoadDll") & ~any_true([low.contains(m) for m in fixed.MONITOR_MODULES])
        & (col("arg").contains("\\") | col("arg").contains("/"))
        & (low.startswith("\\\\") | any_true([low.contains(m) for m in fixed.LOAD_MARKERS]))
        & ~any_true([low.contains(m) for m in fixed.LOAD_EXCLUSIONS])
    )
    out.append(Spec("ApitraceReflectiveLoad", 9205, ["run_id", "actor", "path"], loads, {"load_arg": first(col("arg"), loads)},
                    lit(True), text("module_load", col("load_arg")), ["LdrLoadDll"]))
    return {s.event_type: s for s in out}


_ROW = ["seq", "ts", "api", "arg"]
_NAMES = ["target", "event_id", "event_type", "n_rows", "first_seq", "first_ts", "first_arg", "detail", "named_pid", "evidence"]


def _first_rows(rows: DataFrame, keys: list[str], slots: dict[str, Slot]) -> DataFrame:
    """Per key and slot the first ``k`` rows in order, as an array column per slot."""
    kinds = F.array_compact(F.array(*[F.when(two_valued(s.rows), F.lit(name)) for name, s in slots.items()]))
    x = rows.select(*keys, *_ROW, F.explode(kinds).alias("__slot"))
    ranked = x.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__slot").orderBy(*_ROW)))
    ranked = ranked.filter(F.col("__k") <= max(s.k for s in slots.values()))
    return ranked.groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when((F.col("__slot") == name) & (F.col("__k") <= s.k), F.struct(*_ROW)))).alias(name) for name, s in slots.items()])


def run_specs(rows: DataFrame, chosen: list[Spec]) -> DataFrame:
    """Evaluate specs that share their keys with one aggregation; ``evidence`` has the rows behind a hit in order."""
    keys = chosen[0].keys
    used = sorted({a for s in chosen for a in (s.apis or [])})
    if used and all(s.apis for s in chosen):
        rows = rows.filter(F.col("api").isin(used))  # names reach the scan, arguments are parsed for these rows only
    flags = [two_valued(s.rows).alias(f"__r{i}") for i, s in enumerate(chosen)]
    x = rows.select("*", *flags).filter(any_true([F.col(f"__r{i}") for i in range(len(chosen))]))
    aggs, deep, parts = [], {}, {}
    for i, s in enumerate(chosen):
        mine = F.col(f"__r{i}")
        aggs.append(F.min(F.when(mine, F.struct("seq", "ts", "arg"))).alias(f"__e{i}"))
        aggs.append(F.count_if(mine).alias(f"__n{i}"))
        aggs += [a.alias(n) for n, a in s.aggs.items()]
        parts[i] = []
        for j, slot in enumerate(s.slots or [Slot(mine)]):
            name = f"__s{i}_{j}"
            only = Slot(mine & slot.rows, slot.k)
            if slot.k == 1:
                aggs.append(F.min(F.when(two_valued(only.rows), F.struct(*_ROW))).alias(name))
                found = F.array_compact(F.array(F.col(name)))
            else:
                deep[name] = only
                found = F.col(name)
            parts[i].append(found if slot.use is None else F.when(slot.use, found).otherwise(F.slice(found, 1, 0)))
    g = x.groupBy(*keys).agg(*aggs)
    if deep:
        g = g.join(_first_rows(x, keys, deep), keys, "left")
        g = g.withColumns({name: F.coalesce(F.col(name), F.array().cast(g.schema[name].dataType)) for name in deep})
    target = F.col("target") if "target" in keys else F.lit(None).cast("bigint")
    hits = [
        F.when(
            (F.col(f"__n{i}") > 0) & two_valued(s.fires),
            F.struct(
                F.lit(s.event_id).alias("event_id"), F.lit(s.event_type).alias("event_type"), F.col(f"__n{i}").alias("n_rows"),
                F.col(f"__e{i}")["seq"].alias("first_seq"), F.col(f"__e{i}")["ts"].alias("first_ts"),
                F.col(f"__e{i}")["arg"].alias("first_arg"), s.detail.alias("detail"), (F.col(s.target) if s.target else target).alias("target"),
                (F.col(s.named) if s.named else F.col(s.target) if s.target else target).alias("named_pid"),
                F.concat(*parts[i]).alias("evidence"),
            ),
        )
        for i, s in enumerate(chosen)
    ]
    fired = F.filter(F.array(*hits), lambda v: v.isNotNull())
    return g.select("run_id", "actor", F.explode(fired).alias("h")).select("run_id", "actor", *[f"h.{n}" for n in _NAMES])


def as_alerts(hits: DataFrame) -> DataFrame:
    """Hits as alerts: time of the last evidence row, the calls seen in it, and samples of their arguments.

    ``apis`` are distinct in evidence order; ``samples`` leave out empty arguments and repeats of the one before, up
    to the alert format's own length.
    """
    ev = F.col("evidence")
    grown = F.aggregate(
        F.filter(F.transform(ev, lambda x: x["arg"]), lambda a: a != ""), F.array().cast("array<string>"),
        lambda acc, a: F.when((F.size(acc) < fixed.MAX_EVIDENCE_SAMPLES) & ~two_valued(F.try_element_at(acc, F.lit(-1)) == a), F.concat(acc, F.array(a))).otherwise(acc))
    apis = F.array_distinct(F.filter(F.transform(ev, lambda x: x["api"]), lambda a: a.isNotNull() & (a != "")))
    return hits.select("*", F.element_at(ev, -1)["ts"].alias("ts"), apis.alias("apis"), grown.alias("samples"))


def signature(events: DataFrame, event_type: str) -> DataFrame:
    """One signature G1-G14 over all runs (with its anti-joins)."""
    rows = calls(events)
    s = specs()[event_type]
    if s.keys == ["run_id", "actor", "path"]:
        rows = rows.withColumn("path", F.lower("arg"))
    hits = run_specs(rows, [s])
    if event_type in ("ApitraceCrossProcessWrite", "ApitraceRemoteThread"):
        chains = run_specs(rows, [specs()["ApitraceInjectionChain"]]).select(*PAIR)
        hits = hits.join(chains, PAIR, "left_anti")
    if event_type in ("ApitraceCrossProcessWrite", "ApitraceCrossProcessRead"):
        kids = own_children(events).select("run_id", F.col("pid").alias("actor"), F.col("child").alias("target"))
        hits = hits.join(kids, PAIR, "left_anti")
    return hits


def reflective_starts(events: DataFrame) -> DataFrame:
    """G5, second form: E4 rows as hits; the allocation and the start are the evidence."""
    return alloc_then_start(events).select(
        "run_id", F.col("pid").alias("actor"), F.lit(None).cast("bigint").alias("target"), F.lit(9205).alias("event_id"),
        F.lit("ApitraceReflectiveLoad").alias("event_type"), F.lit(1).cast("bigint").alias("n_rows"), F.col("seq").alias("first_seq"),
        F.col("ts").alias("first_ts"), F.col("addr").alias("first_arg"),
        text("reflective", F.col("addr")).alias("detail"),
        F.lit(None).cast("bigint").alias("named_pid"), F.array("first_row", "row").alias("evidence"),
    )


def module_loads(events: DataFrame) -> DataFrame:
    """G5 in both forms: modules loaded from unusual paths, and threads started in executable allocations."""
    return signature(events, "ApitraceReflectiveLoad").unionByName(reflective_starts(events))


def all_signatures(events: DataFrame) -> DataFrame:
    """G1-G14 together: one aggregation per actor, one per (actor, target)."""
    rows = calls(events)
    sp = specs()
    actor = run_specs(rows, [s for s in sp.values() if s.keys == ACTOR])
    pairs = run_specs(rows, [s for s in sp.values() if s.keys == PAIR])
    chains = pairs.filter(F.col("event_type") == "ApitraceInjectionChain").select(*PAIR).withColumn("__chain", F.lit(True))
    kids = own_children(events).select("run_id", F.col("pid").alias("actor"), F.col("child").alias("target"), F.lit(True).alias("__kid"))
    t = F.col("event_type")
    pairs = pairs.join(chains, PAIR, "left").join(kids, PAIR, "left").filter(
        ~(t.isin("ApitraceCrossProcessWrite", "ApitraceRemoteThread") & two_valued(F.col("__chain")))
        & ~(t.isin("ApitraceCrossProcessWrite", "ApitraceCrossProcessRead") & two_valued(F.col("__kid")))
    ).drop("__chain", "__kid")
    loads = run_specs(rows.withColumn("path", F.lower("arg")), [sp["ApitraceReflectiveLoad"]])
    return actor.unionByName(pairs).unionByName(loads).unionByName(reflective_starts(events))


def evidence(rows: DataFrame, hits: DataFrame, spec: Spec, k: int = 5) -> DataFrame:
    """The first k rows behind each hit of a spec, as rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*spec.keys).orderBy("seq")
    x = rows.filter(two_valued(spec.rows)).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    return x.join(hits.select(*spec.keys).distinct(), spec.keys, "left_semi").select(*spec.keys, "pos", "seq", "api", "arg")


def trace_silence(
    events: DataFrame, both_apis: list[str], min_calls=fixed.SILENCE_MIN_CALLS, min_events=fixed.SILENCE_MIN_EVENTS, min_s=fixed.SILENCE_MIN_S
) -> DataFrame:
    """A traced process whose dual-covered calls stop while the host sensor still sees it.

    The count of later host events needs no pairing: host events join the one
    row per (run, pid) that holds the last call, then aggregate.
    """
    meta = [fixed.META_CAP, fixed.META_WOW64, fixed.META_ATTACHED]
    t = trace_rows(events).filter(F.col("pid").isNotNull() & F.col("ts").isNotNull())
    facts = t.groupBy("run_id", "pid").agg(
        _n(~F.col("api").isin(meta)).alias("n_calls"), F.max(F.col("api") == fixed.META_CAP).alias("capped"),
        F.max(F.when(F.col("api").isin(both_apis), F.col("ts"))).alias("last_call"),
    ).filter((F.col("n_calls") >= min_calls) & ~F.col("capped") & F.col("last_call").isNotNull())
    ends = events.groupBy("run_id").agg(F.max("ts").alias("run_end"))
    span = (micros(F.col("run_end")) - micros(F.col("last_call"))) / 1_000_000.0
    facts = facts.join(ends, "run_id").withColumn("span_s", span).filter(F.col("span_s") >= min_s)
    src_pid = as_int(fld(events, "SourceProcessId"))
    host = events.filter((F.col("source") == "sysmon") & F.col("ts").isNotNull()).select(
        "run_id", F.coalesce(F.when(src_pid != 0, src_pid), as_int(fld(events, "ProcessId"))).alias("pid"), "ts"
    )
    trailing = host.join(facts, ["run_id", "pid"]).filter(F.col("ts") > F.col("last_call"))
    return trailing.groupBy("run_id", "pid").agg(
        F.count("*").alias("host_events"), F.max("span_s").alias("span_s"), F.max("last_call").alias("last_call"), F.max("ts").alias("last_event")
    ).filter(F.col("host_events") >= min_events)


def driver_alerts(events: DataFrame) -> DataFrame:
    """Protection-driver events passed through as alerts with a text."""
    pid, tgt = F.coalesce(fld(events, "ProcessId"), F.lit("0")), F.coalesce(fld(events, "TargetProcessId"), F.lit("0"))
    words, val = F.coalesce(fld(events, "Text"), F.lit("")), F.coalesce(as_int(fld(events, "Value")), F.lit(0))
    hexa = F.lower(F.hex(val))
    low8 = F.lpad(F.lower(F.hex(val.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    i = F.col("event_id")
    detail = (
        F.when(i == 9401, F.concat(F.lit("Access to protected process "), tgt, F.lit(" denied for pid "), pid, F.lit(" (stripped access mask 0x"), hexa, F.lit(")")))
        .when(i == 9402, F.concat(F.lit("Registry write/delete on protected key denied for pid "), pid, F.lit(": "), words))
        .when(i == 9403, F.concat(F.lit("Module mapped twice into pid "), tgt, F.lit(" (possible ntdll/amsi remap): "), words))
        .when(i == 9405, F.concat(F.lit("Guardian placement APC into pid "), tgt, F.lit(" failed (NTSTATUS 0x"), low8, F.lit(")")))
    )
    kinds = F.create_map(*[F.lit(x) for kv in fixed.DRIVER_ALERTS.items() for x in kv])
    return events.filter((F.col("source") == "guardian") & i.isin(list(fixed.DRIVER_ALERTS))).select(
        "run_id", "seq", "ts", "event_id", kinds[i].alias("event_type"), pid.alias("ProcessId"), tgt.alias("TargetProcessId"), detail.alias("detail")
    )
