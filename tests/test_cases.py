"""Small hand-made cases: expected behavior in our own words."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions import leaf as L
from detectframe.operators import calls as P
from detectframe.operators import joins as J
from detectframe.operators import lineage as LN
from detectframe.operators import rules as R
from detectframe.operators import scoring as S
from detectframe.operators import sequence as G
from detectframe.operators import triage as T
from detectframe.operators import windows as W
from detectframe.plans.detect import detect
from detectframe.schema import EVENT
from detectframe.sources import normalize as N

T0 = datetime(2026, 1, 1, 12, 0, 0)


def ev(seq, event_type, event_id, secs=0.0, run="r1", source="sysmon", **data):
    return (run, seq, source, "p", event_id, T0 + timedelta(seconds=secs), "pc", event_type, {k: str(v) for k, v in data.items()})


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


MASS = [
    {"id": "b", "name": "b", "level": "low", "logsource": {"category": "file_event"}, "detection": {"s": {"EventID": 11}, "condition": "s"}},
    {"id": "mass", "title": "Mass file change", "level": "high", "tags": ["attack.t1486"], "correlation": {"type": "event_count", "rules": ["b"], "group-by": ["ProcessId"], "timespan": "5s", "condition": {"gte": 20}}},
]


@pytest.mark.parametrize("name,rows,fires", [
    ("25 files in 2.5 s", [(i, 5, i * 0.1) for i in range(25)], 1),
    ("10 files", [(i, 5, i * 0.1) for i in range(10)], 0),
    ("25 files in 25 s", [(i, 5, float(i)) for i in range(25)], 0),
    ("15 + 15 over two processes", [(i, 5 + i % 2, i * 0.05) for i in range(30)], 0),
])
def test_mass_file_correlation(spark, name, rows, fires):
    df = events(spark, [ev(i, "FileCreate", 11, s, ProcessId=p, TargetFilename=f"f{i}") for i, p, s in rows])
    c = R.compile_rules(MASS).correlations[0]
    assert R.event_count(df, c["trees"], c["group_by"], c["seconds"], c["op"], c["count"]).count() == fires, name


def test_port_scan_silences_flood(spark):
    rows = [ev(i, "NetworkConnect", 3, i * 0.1, ProcessId=9, DestinationIp="10.0.0.1", DestinationPort=1000 + i) for i in range(20)]
    rows += [ev(100 + i, "NetworkConnect", 3, 2 + i * 0.05, ProcessId=9, DestinationIp="10.0.0.2", DestinationPort=80) for i in range(60)]
    rows += [ev(500 + i, "NetworkConnect", 3, i * 0.1, ProcessId=8, DestinationIp=f"10.1.0.{i % 6}", DestinationPort=443) for i in range(45)]
    rows += [ev(900 + i, "NetworkConnect", 3, i * 0.1, ProcessId=7, DestinationIp="1.1.1.1", DestinationPort=i, Initiated="false") for i in range(90)]
    got = {(r.pid, r.kind, r.ip, r["count"]) for r in W.network_burst(events(spark, rows)).collect()}
    assert got == {("9", "port_scan", "10.0.0.1", 20), ("8", "connection_flood", None, 45)}


def test_dns_tunnel_and_flood(spark):
    rows = [ev(i, "DnsQuery", 22, i * 0.2, ProcessId=1, QueryName=f"{i:02d}" + "a" * 60 + ".x.org") for i in range(25)]
    rows += [ev(100 + i, "DnsQuery", 22, i * 0.1, ProcessId=2, QueryName="w.org") for i in range(55)]
    rows += [ev(300 + i, "DnsQuery", 22, i * 0.1, ProcessId=3, QueryName="w.org") for i in range(30)]
    assert {(r.pid, r.kind) for r in W.dns_burst(events(spark, rows)).collect()} == {("1", "dns_tunnel_suspect"), ("2", "dns_flood")}


def test_reused_pid_with_other_guid_is_out_of_scope(spark):
    rows = [
        ev(1, "ProcessCreate", 1, 0, ProcessId=100, ParentProcessId=4, ProcessGuid="A", ParentProcessGuid="S", Image="C:\\x\\Sample.exe"),
        ev(2, "ProcessCreate", 1, 1, ProcessId=200, ParentProcessId=100, ProcessGuid="B", ParentProcessGuid="A", Image="C:\\x\\timeout.exe"),
        ev(3, "ProcessCreate", 1, 3, ProcessId=200, ParentProcessId=4, ProcessGuid="W", ParentProcessGuid="S", Image="C:\\x\\wermgr.exe"),
        ev(4, "ProcessCreate", 1, 9, ProcessId=100, ParentProcessId=4, ProcessGuid="Z", ParentProcessGuid="S", Image="C:\\x\\later.exe"),
    ]
    e = events(spark, rows)
    runs = spark.createDataFrame([("r1", 100, "C:\\x\\sample.exe")], "run_id string, root_pid bigint, root_image string")
    guids, pids = LN.lineage(e, runs)
    assert {r.guid for r in guids.collect()} == {"A", "B"}
    a = events(spark, [ev(10, "FileCreate", 11, 4, ProcessId=200, ProcessGuid="W"), ev(11, "FileCreate", 11, 4, ProcessId=200, ProcessGuid="B"), ev(12, "X", 16, 4), ev(13, "FileCreate", 11, 4, ProcessId=200)])
    assert {r.seq: r.in_scope for r in LN.scope(a, guids, pids).collect()} == {10: False, 11: True, 12: False, 13: True}


def test_child_born_after_parent_end_is_not_lineage_without_guids(spark):
    rows = [
        ev(1, "ProcessCreate", 1, 0, ProcessId=1, ParentProcessId=9), ev(2, "ProcessCreate", 1, 1, ProcessId=2, ParentProcessId=1), ev(3, "ProcessTerminate", 5, 2, ProcessId=2),
        ev(4, "ProcessCreate", 1, 2.9, ProcessId=3, ParentProcessId=2), ev(5, "ProcessCreate", 1, 8, ProcessId=4, ParentProcessId=2),
    ]
    runs = spark.createDataFrame([("r1", 1, None)], "run_id string, root_pid bigint, root_image string")
    _, pids = LN.lineage(events(spark, rows), runs)
    assert {r.pid for r in pids.collect()} == {1, 2, 3}


def scored(spark, rows):
    schema = "run_id string, seq bigint, event_id int, event_type string, in_scope boolean, rule_id string, title string, level string, priority string, Rule string"
    return S.classify_alert(spark.createDataFrame(rows, schema))


def test_verdict_counts_a_finding_once_and_caps(spark):
    runs = spark.createDataFrame([("one",), ("many",), ("out",)], "run_id string")
    rows = [("one", i, 1, "ProcessCreate", True, "x", "X", "high", None, None) for i in range(10)]
    rows += [("many", i, 1, "ProcessCreate", True, f"x{i}", "X", "high", None, None) for i in range(10)]
    rows += [("out", i, 25, "ProcessTampering", False, None, None, None, None, None) for i in range(3)]
    static = spark.createDataFrame([("many", 0, 10, "p"), ("many", 2, 15, "y"), ("many", 3, 8, "c")], "run_id string, ord int, weight int, label string")
    got = {r.run_id: (r.score, r.level) for r in S.verdict(runs, scored(spark, rows), static).collect()}
    assert got == {"one": (15, "suspicious"), "many": (100, "malicious"), "out": (0, "clean")}
    reasons = S.top_reasons(scored(spark, rows), static).filter(F.col("run_id") == "many").orderBy("rank").collect()
    assert [r.weight for r in reasons] == [15] * 5 and reasons[0].label == "Sigma: X"


@pytest.mark.parametrize("name,noise", [("windows.com", True), ("a.windows.com", True), ("windows.com.evil.net", False), ("notwindows.com", False)])
def test_vendor_noise_needs_a_dot_boundary(spark, name, noise):
    assert spark.range(1).select(T.os_noise_domain(F.lit(name)).alias("x")).first().x is noise


def test_dga(spark):
    names = {"xkqzvbnwplfdgh7t.com": True, "google.com": False, "a.b.in-addr.arpa": False, "xkqzvbnwplfdgh7t.windows.com": False, "internationalbusiness.com": False, "": False}
    got = {r.n: r.d for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", T.dga_suspect(F.col("n")).alias("d")).collect()}
    assert got == names


def call(seq, api, arg="", pid=10, secs=None, **kw):
    return ev(seq, "ApiCall", 9200, seq if secs is None else secs, source="apitrace", Api=api, Arg0=arg, ProcessId=pid, Category=kw.get("category", "memory"), ThreadId=1)


def test_injection_chain_and_own_child(spark):
    rows = [
        call(1, "NtWriteVirtualMemory", "target_pid=50 cross_process=1"), call(2, "NtResumeThread", "target_pid=50"), call(3, "NtWriteVirtualMemory", "target_pid=60"),
        call(4, "NtCreateUserProcess", "child_pid=70"), call(5, "NtWriteVirtualMemory", "target_pid=70"), call(6, "NtUnmapViewOfSection", "target_pid=80 cross_process=1"), call(7, "NtSetContextThread", "target_pid=80 cross_process=0"),
    ]
    got = {(r.event_type, r.target, r.detail.split(" into ")[0]) for r in G.all_signatures(events(spark, rows)).collect()}
    assert got == {("ApitraceInjectionChain", 50, "Write"), ("ApitraceInjectionChain", 80, "Process hollowing"), ("ApitraceCrossProcessWrite", 60, "Cross-process write")}


def test_allocation_must_come_before_the_thread(spark):
    rows = [call(1, "NtCreateThreadEx", "start=0xA"), call(2, "NtAllocateVirtualMemory", "base=0xA executable=1"), call(3, "NtCreateThreadEx", "start=0xA"), call(4, "NtAllocateVirtualMemory", "base=0xB executable=0"), call(5, "NtResumeThread", "start=0xB")]
    assert [(r.seq, r.first_seq) for r in J.alloc_then_start(events(spark, rows)).collect()] == [(3, 2)]


def test_timing_arms(spark):
    rows = [call(i, "GetTickCount64", pid=1) for i in range(3)] + [call(10, "NtDelayExecution", "delay_ms=20000", pid=1), call(11, "NtDelayExecution", "delay_ms=20000", pid=2), call(12, "NtDelayExecution", "delay_ms=70000", pid=3),
            call(13, "NtDelayExecution", "delay_ms=70000 alertable=1", pid=4), call(14, "NtSetTimer", "apc=1", pid=5), call(15, "NtDelayExecution", "delay_ms=99999999", pid=6)]
    got = {r.actor: r.detail[:9] for r in G.signature(events(spark, rows), "ApitraceAntiSandboxTiming").collect()}
    assert got == {1: "Timing-so", 3: "Very long", 5: "Code exec"}


def test_blind_spot_needs_two_misses_and_respects_suppressions(spark):
    rows = [call(1, "CreateFileW", pid=10, secs=0)]
    rows += [ev(10 + i, "FileCreate", 11, 20 + 10 * i, ProcessId=10) for i in range(3)]
    rows += [call(30, "NtCreateFile", pid=10, secs=31.5)]  # explains the second event
    rows += [ev(40 + i, "FileCreate", 11, 20 + 10 * i, ProcessId=99) for i in range(3)]  # untraced
    rows += [ev(50 + i, "RegistryValueSet", 13, 20 + 10 * i, ProcessId=10, TargetObject="HKLM\\System\\Services\\bam\\x") for i in range(3)]
    got = [(r.pid, r.hook, r.misses) for r in J.counterpart_misses(events(spark, rows)).collect()]
    assert got == [(10, "CreateFileW", 2)]
    capped = rows + [call(60, fixed.META_CAP, pid=10, secs=90)]
    assert J.counterpart_misses(events(spark, capped)).count() == 0


def test_launcher_and_tooling_rescope(spark):
    alerts = spark.createDataFrame(
        [("r1", 1, "sysmon", 8, "CreateRemoteThread", True, "0x7ff0", "5", "6", None), ("r1", 2, "sysmon", 10, "ProcessAccess", True, None, "5", "6", None), ("r1", 3, "sysmon", 10, "ProcessAccess", True, None, "5", "7", None),
         ("r1", 4, "sysmon", 7, "ImageLoad", True, None, None, None, "C:\\SandboxAgent\\m.dll")],
        "run_id string, seq bigint, source string, event_id int, event_type string, in_scope boolean, StartAddress string, SourceProcessId string, TargetProcessId string, ImageLoaded string")
    marks = events(spark, [ev(1, "GuardianRegistered", 9400, 0, source="guardian", Text="loadlibrary_x64=0x7FF0")])
    runs = spark.createDataFrame([("r1", 1, "x", None)], "run_id string, root_pid bigint, root_image string, staged_path string")
    got = {r.seq: (r.in_scope, (r.scope_reason or "")[:7]) for r in T.rescope(alerts, marks, runs).collect()}
    assert got == {1: (False, "tooling"), 2: (False, "tooling"), 3: (True, ""), 4: (False, "tooling")}


def test_rule_loader_reports_what_it_cannot_run():
    base = {"level": "high", "logsource": {"category": "process_creation"}}
    rs = R.compile_rules([
        {**base, "id": "ok", "detection": {"a": {"X": 1}, "condition": "a"}}, {**base, "id": "mod", "detection": {"a": {"X|odd": 1}, "condition": "a"}},
        {**base, "id": "cond", "detection": {"a": {"X": 1}, "condition": "a and b"}}, {**base, "id": "call", "detection": {"a": {"X": 1}, "condition": "a()"}}, {**base, "id": "rx", "detection": {"a": {"X|re": "("}, "condition": "a"}},
    ])
    assert [r.rule_id for r in rs.rules] == ["ok"] and {e[0] for e in rs.errors} == {"mod", "cond", "call", "rx"}


def test_static_ids_and_anchors():
    tree = R.rule_tree({"detection": {"a": {"EventID": [1, 2], "X|contains": "abcdef"}, "b": {"EventID": 2, "X|endswith": "xabcdef"}, "n": {"Y": "1234"}, "condition": "(a or b) and not n"}})
    assert R.static_event_ids(tree) == {1, 2}
    assert R.must_contain(tree) == set()
    one = R.rule_tree({"detection": {"a": {"X|contains|all": ["abcdef", "xyz"]}, "condition": "a"}})
    assert R.must_contain(one) == {("X", "abcdef")}


def test_base64offset_finds_every_alignment():
    import base64

    parts = L.base64offset("secret-word")
    for pad in range(3):
        text = base64.b64encode(b"x" * pad + b"secret-word" + b"tail").decode()
        assert any(p in text for p in parts)


def test_ipv6_cidr(spark):
    rows = [("2001:db8::1", True), ("2001:db9::1", False), ("2001:0db8:ffff::", True), ("::1", False), ("10.0.0.1", False), ("2001:db8:1:2:3:4:5:6:7", False)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert {r.a: r.x for r in df.select("a", L.cidr(F.col("a"), "2001:db8::/32").alias("x")).collect()} == dict(rows)
    assert df.select(F.count_if(L.cidr(F.col("a"), "2001:db8::/31")).alias("n")).first().n == 3


def test_scan_content_decoding(spark):
    good = "0x" + "IEX $a".encode("utf-16-le").hex()
    df = spark.createDataFrame([(good,), ("0xzz",), ("abc",), (None,)], "c string")
    assert [r.x for r in df.select(N.decode_scan_content(F.col("c")).alias("x")).collect()] == ["IEX $a", "", "", ""]


def test_call_signature_first_hit_and_severity(spark):
    rows = [call(1, "NtAllocateVirtualMemory", "protect=0x4 target_pid=10 cross_process=0", pid=10), call(2, "NtAllocateVirtualMemory", "protect=0x40 target_pid=10 cross_process=0", pid=10), call(3, "NtAllocateVirtualMemory", "protect=0x40 target_pid=11", pid=10)]
    spec = P.CallSpec("rwx", apis=["VirtualAllocEx"], where=(F.col("args")["Protection"] == "0x00000040") & (F.col("args")["ProcessHandle"] == "0xffffffff"), severity=3)
    m = P.call_signature(P.call_rows(events(spark, rows)), [spec])
    assert [(r.signature, r.first_seq) for r in m.collect()] == [("rwx", 2)]
    alert = P.emit_match(m, P.spec_table(spark, [spec])).first()
    assert (alert.SeverityStr, alert.event_type) == ("high", "CapeSignature")
    assert P.emit_match(m, P.spec_table(spark, [spec]), min_severity=4).count() == 0


RULES = MASS + [
    {"id": "enc", "title": "Encoded command", "level": "high", "tags": ["attack.t1059.001"], "logsource": {"category": "process_creation"},
     "detection": {"img": {"Image|endswith": "\\powershell.exe"}, "cmd": {"CommandLine|contains|windash": " -enc "}, "condition": "img and cmd"}},
]


def test_whole_detection_over_several_runs(spark):
    create = lambda seq, run, image, cmd, pid=100, ppid=4: ev(seq, "ProcessCreate", 1, 0, run=run, ProcessId=pid, ParentProcessId=ppid, ProcessGuid=f"{run}-{pid}", ParentProcessGuid=f"{run}-{ppid}", Image=image, CommandLine=cmd)
    rows = [
        create(1, "benign", "C:\\w\\notepad.exe", "notepad.exe a.txt"), ev(2, "FileCreate", 11, 1, run="benign", ProcessId=100, ProcessGuid="benign-100", TargetFilename="C:\\u\\a.txt"),
        create(1, "cradle", "C:\\w\\sample.exe", "sample.exe"), create(2, "cradle", "C:\\w\\powershell.exe", "powershell.exe /enc AAAA", 101, 100),
        create(1, "tamper", "C:\\w\\sample.exe", "s"), ev(2, "ProcessTampering", 25, 1, run="tamper", ProcessId=100, ProcessGuid="tamper-100", Type="Image is replaced"),
        create(1, "runkey", "C:\\w\\sample.exe", "s"), ev(2, "RegistryValueSet", 13, 1, run="runkey", ProcessId=100, ProcessGuid="runkey-100", TargetObject="HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x"),
        create(1, "mass", "C:\\w\\sample.exe", "s"), *[ev(10 + i, "FileCreate", 11, 1 + i * 0.1, run="mass", ProcessId=100, ProcessGuid="mass-100", TargetFilename=f"f{i}") for i in range(25)],
        create(1, "other", "C:\\w\\sample.exe", "s"), ev(2, "ProcessTampering", 25, 1, run="other", ProcessId=500, ProcessGuid="other-500"),
    ]
    names = ["benign", "cradle", "tamper", "runkey", "mass", "other"]
    runs = spark.createDataFrame([(n, 100, "C:\\w\\notepad.exe" if n == "benign" else "C:\\w\\sample.exe") for n in names], "run_id string, root_pid bigint, root_image string")
    d = detect(events(spark, rows), runs, R.compile_rules(RULES))
    got = {r.run_id: (r.score, r.level) for r in d.verdicts.collect()}
    assert got == {"benign": (0, "clean"), "cradle": (15, "suspicious"), "tamper": (40, "malicious"), "runkey": (12, "suspicious"), "mass": (15, "suspicious"), "other": (0, "clean")}
