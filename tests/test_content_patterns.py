"""Content patterns against plain regular expressions; running counts and first rows against loops."""

import random
import re
from datetime import datetime, timedelta

import pytest

from detectframe.catalog import rules as CR
from detectframe.operators import content as C
from detectframe.operators import rules as R
from detectframe.operators.windows import running_counts
from detectframe.sources.normalize import first_n


@pytest.mark.parametrize("pattern, want", [
    (r"(?i)powershell.{0,20}(IWR|Net)", {"powershell"}), (r"-enc ", {"-enc "}), (r"abc|defg", {"abc", "defg"}), (r"abc|x?", None), (r"(?:abcd)?x", None), (r"(abcd)+x", {"abcd"}),
    (r"(?iu)kelvin", None), (r"(?!secret)[a-z]+", None), (r"\d{4,}", None), (r"caf\u00e9 noir", None), (r"\p{L}abc", None), (r"abc\vdef", None), (r"(?<n>abcd)x", {"abcd"}), (r"ab", None), (r"(", None),
])
def test_literals_every_match_contains(pattern, want):
    assert C.literals_of(pattern) == want


def test_scan_and_hits_equal_plain_search(spark):
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gam", "ma", " ", "12", "345", "é", "\n", "ALPHAbeta"]
    docs = [(i, "".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 30])))) for i in range(80)] + [(80, None), (81, "alpha " * 3000), (81, "beta")]
    rules = [
        {"rule": "a", "patterns": {"$a": "(?i)alpha", "$b": "[0-9]{3,}"}}, {"rule": "b", "need": 2, "patterns": {"$a": "gamma", "$b": "Beta|alpha", "$c": "(?i)(alpha|beta) ?(12|é)"}},
        {"rule": "g", "need": 1, "need_guarded": 2, "patterns": {"$a": "ma", "$b": "gam"}}, {"rule": "always", "need": 0, "patterns": {"$a": "nowhere"}},
    ]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    guard = lambda t: t.startswith("gam")
    found = lambda rx, t: t is not None and re.search(rx, t) is not None
    want = []
    for i, t in docs:
        for r in rules:
            need = r.get("need", 1)
            if "need_guarded" in r and t is not None and t.startswith("gam"):
                need = r["need_guarded"]
            if sum(found(p, t) for p in r["patterns"].values()) >= need:
                want.append((i, r["rule"]))
    assert sorted(map(tuple, C.pattern_scan(df, rules, guard=guard).collect())) == sorted(want)
    hits = [(i, r["rule"], n, m.start(), m.group()) for i, t in docs for r in rules for n, p in r["patterns"].items() for m in re.finditer(p, t or "")]
    assert sorted(map(tuple, C.pattern_hits(df, rules).collect())) == sorted(hits)
    assert C.pattern_hits(df.where("false"), rules).count() == 0


def test_running_counts_of_mixed_widths(spark):
    rnd = random.Random(5)
    widths = {"a": 0, "b": 7, "c": 1000}
    rows = [(k, rnd.randrange(300 if k == "b" else 4000), widths[k]) for k in rnd.choices("abc", k=500)]
    got = {(r.k, r.us): r.n for r in running_counts(spark.createDataFrame(rows, "k string, us bigint, width bigint"), ["k"]).collect()}
    assert got == {(k, us): sum(k2 == k and us - w <= u2 <= us for k2, u2, _ in rows) for k, us, w in rows}


def test_correlations_keep_null_groups_and_rows_without_a_time(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(None, "FileCreate", 11, t0 + timedelta(hours=i), "\\\\doc", None) for i in range(3)] + [("r", "FileCreate", 11, None, "\\\\doc", "5")]
    df = spark.createDataFrame(rows, "run_id string, event_type string, event_id int, ts timestamp, TargetFilename string, ProcessId string")
    got = {(r.rule_id, r.run_id, r.ProcessId): (r.matched_events, r.ts) for r in R.correlation_alerts(df, R.compile_rules(CR.CORRELATIONS, "informational")).collect()}
    assert got == {("c0", None, None): (3, t0 + timedelta(hours=2))}


def test_first_rows_over_many_stretches(spark):
    rnd = random.Random(6)
    rows = [("one", i, i) for i in rnd.sample(range(10**9), 3000)] + [("two", i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    for n in (1, 40, 1234, 5000):
        got = sorted((r.k, r.o) for r in first_n(df, "k", "o", n, width=16).collect())
        assert got == sorted(x for k in ("one", "two") for x in sorted((a, b) for a, b, _ in rows if a == k)[:n])
