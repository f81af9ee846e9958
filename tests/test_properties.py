"""Operators against brute force on random small fixtures."""

import math
import random
import re
from collections import deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from detectframe.functions import leaf as L
from detectframe.functions import scalar as K
from detectframe.operators import content as C
from detectframe.operators import joins as J
from detectframe.operators import quality as Q
from detectframe.operators import rules as R
from detectframe.operators import windows as W
from detectframe.operators.lineage import ascend, descend

T0 = datetime(2024, 1, 1)


def test_densest_window_matches_two_pointers(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for key in "abcdef":
        secs = [rnd.choice([rnd.uniform(0, 400), rnd.randint(0, 40)]) for _ in range(120)]
        times = sorted(T0 + timedelta(seconds=s) for s in secs)
        rows += [(key, t) for t in times]
        best, j = None, 0
        for i, t in enumerate(times):
            while (t - times[j]).total_seconds() > 10:
                j += 1
            if best is None or i - j + 1 > best[2]:
                best = (times[j], t, i - j + 1)
        # equal times end together
        best = (best[0], best[1], sum(best[1] - timedelta(seconds=10) <= x <= best[1] for x in times))
        want[key] = best
    rows.append(("a", None))
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = {r.k: (r.start, r.end, r.n) for r in W.densest_window(df, ["k"], "ts", 10).collect()}
    assert got == want


def test_near_time_matches_all_pairs(spark):
    rnd = random.Random(2)
    mk = lambda n: [(rnd.choice("xyz"), i, T0 + timedelta(milliseconds=rnd.randint(0, 60_000))) for i in range(n)]
    a, b = mk(150), mk(60)
    da, db = (spark.createDataFrame(r, "k string, i int, ts timestamp") for r in (a, b))
    got = {r.i: r.near for r in J.near_time(da, db, ["k"], 2).collect()}
    assert got == {i: any(k == k2 and abs((t - t2).total_seconds()) <= 2 for k2, _, t2 in b) for k, i, t in a}


def test_descend_matches_bfs_with_cycles(spark):
    rnd = random.Random(3)
    edges = [("r%d" % rnd.randint(0, 1), rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(120)] + [("r0", 1, 2), ("r0", 2, 1)]
    seeds = [("r0", 1), ("r1", 5), ("r1", 6)]
    got = {(r.run_id, r.node): r.depth for r in descend(
        spark.createDataFrame(edges, "run_id string, parent bigint, child bigint"), spark.createDataFrame(seeds, "run_id string, node bigint")).collect()}
    want = {s: 0 for s in seeds}
    queue = deque(seeds)
    while queue:
        run, node = queue.popleft()
        for r, p, c in edges:
            if r == run and p == node and (r, c) not in want:
                want[(r, c)] = want[(run, node)] + 1
                queue.append((r, c))
    assert got == want


WORDS = ["powershell -enc abcd", "CMD.EXE /c dir", "plain", "", None, "a\nb powershell", "10", "0x10", "7.5", "notepad.exe", "ſystem KELVIN", "tab\tpowershell.exe\n"]
PATTERNS = ["*powershell*", "powershell*", "*.exe", "cmd.exe ?c dir", "plain", "*enc*abc?", "*", "", "sYstem*", "*k*"]


def py_like(pattern, value):
    if value is None:
        return False
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return re.compile(rx, re.I).fullmatch(value) is not None


def test_wildcards_match_python_fullmatch(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "i int, f string")
    got = df.select("i", *[L.like_ci(F.col("f"), p).alias(f"p{j}") for j, p in enumerate(PATTERNS)]).collect()
    for r in got:
        for j, p in enumerate(PATTERNS):
            assert r[f"p{j}"] == py_like(p, WORDS[r.i]), (p, WORDS[r.i])


def test_random_condition_trees_are_two_valued(spark):
    rnd = random.Random(4)
    fields = ["A", "B", "C"]
    rows = [(i, *[rnd.choice(WORDS) for _ in fields]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, A string, B string, C string")

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            f = rnd.choice(fields)
            kind = rnd.choice(["like", "like_cs", "re", "gt", "null", "exists", "fieldref", "num"])
            val = {"like": None, "like_cs": None, "re": ("pow|cmd", ""), "gt": 5.0, "null": None, "exists": rnd.random() < 0.5, "fieldref": rnd.choice(fields), "num": 10.0}[kind]
            if kind in ("like", "like_cs"):
                val = tuple(L.split_wildcards(rnd.choice(PATTERNS)))
            return ("leaf", f, kind, val)
        op = rnd.choice(["and", "or", "not"])
        return ("not", tree(depth - 1)) if op == "not" else (op, [tree(depth - 1) for _ in range(rnd.randint(1, 3))])

    def num(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    def ev(n, row):
        if n[0] == "and":
            return all(ev(x, row) for x in n[1])
        if n[0] == "or":
            return any(ev(x, row) for x in n[1])
        if n[0] == "not":
            return not ev(n[1], row)
        _, f, kind, val = n
        v = row[f]
        if kind == "like":
            return py_like("".join(p if isinstance(p, str) else p[0] for p in val), v)
        if kind == "like_cs":
            body = "".join(re.escape(p) if isinstance(p, str) else {"*": ".*", "?": "."}[p[0]] for p in val)
            return v is not None and re.fullmatch(body, v) is not None
        if kind == "re":
            return v is not None and re.search(val[0], v) is not None
        if kind == "gt":
            return num(v) is not None and num(v) > val
        if kind == "num":
            return num(v) is not None and num(v) == val
        if kind == "null":
            return v is None or v == ""
        if kind == "exists":
            return (v is not None) == val
        return v is not None and row[val] is not None and v == row[val]

    trees = [tree(3) for _ in range(40)]
    src = R.FieldSource(df)
    out = df.select("i", *[R.to_column(t, src).alias(f"t{j}") for j, t in enumerate(trees)]).collect()
    texts = R.FieldTexts(df)
    predicates = [R.to_sql(t, texts) for t in trees]
    as_text = df.select("i", *texts.columns()).selectExpr("i", *[f"{p} AS t{j}" for j, p in enumerate(predicates)]).collect()
    by_id = {r[0]: dict(zip(fields, r[1:])) for r in rows}
    for r in [*out, *as_text]:
        for j, t in enumerate(trees):
            assert r[f"t{j}"] == ev(t, by_id[r.i]), (t, by_id[r.i])


def test_addresses_and_keywords_as_text_equal_columns(spark):
    rows = [(i, v, {"K": v or "x", "L": "it's a \\\\ path"}) for i, v in enumerate(["10.2.3.4", "10.3.0.1", "::1", "2001:db8::5", "2001:db9::", "300.1.1.1", "", None, "it's", "a\\b"])]
    df = spark.createDataFrame(rows, "i int, A string, data map<string,string>")
    trees = [("leaf", "A", "cidr", n) for n in ("10.2.0.0/16", "10.2.3.4/32", "::/0", "2001:db8::/32", "2001:db8::/29", "0.0.0.0/1")]
    trees += [("leaf", None, "like", tuple(L.split_wildcards(w))) for w in ("it's*", "*\\\\b", "x", "é")] + [("leaf", "A", "like", ("it's",)), ("leaf", "A", "re", ("a\\\\b|'", ""))]
    src, texts = R.FieldSource(df), R.FieldTexts(df)
    predicates = [R.to_sql(t, texts) for t in trees]
    a = df.select("i", *[R.to_column(t, src).alias(f"t{j}") for j, t in enumerate(trees)])
    b = df.select("*", *texts.columns()).selectExpr("i", *[f"{p} AS t{j}" for j, p in enumerate(predicates)])
    assert sorted(a.collect()) == sorted(b.collect()) and any(any(r[1:]) for r in a.collect())


def test_every_match_contains_one_of_the_cover():
    tree = R.rule_tree({"detection": {"a": {"X|contains": ["abcdef", "ghijkl"]}, "b": {"Y|endswith": "longer-literal"}, "c": {"Z|re": "x"}, "condition": "(a and c) or b"}})
    assert R.anchor_cover(tree) == {("X", "abcdef"), ("X", "ghijkl"), ("Y", "longer-literal")}
    for text in ("a or c", "not a", "c"):
        assert R.anchor_cover(R.rule_tree({"detection": {"a": {"X|contains": "abcdef"}, "c": {"Z|re": "x"}, "condition": text}})) is None


def test_random_rules_prefilter_changes_nothing(spark):
    rnd = random.Random(5)
    vals = ["powershell", "cmd.exe", "abc", "notepad", "enc"]
    rules = []
    for i in range(25):
        sel = {f"{rnd.choice('AB')}|{rnd.choice(['contains', 'startswith', 'endswith'])}": rnd.sample(vals, rnd.randint(1, 3))}
        flt = {f"{rnd.choice('AB')}|contains": rnd.choice(vals)}
        rules.append({"id": f"r{i}", "level": "high", "logsource": {"category": "process_creation"},
                      "detection": {"sel": sel, "flt": flt, "condition": rnd.choice(["sel and not flt", "sel or flt", "sel and flt", "not sel"])}})
    rows = [("r", i, "sysmon", 1, "ProcessCreate", rnd.choice(WORDS), rnd.choice(WORDS)) for i in range(80)]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, source string, event_id int, event_type string, A string, B string")
    rs = R.compile_rules(rules)
    pick = lambda on: {(r.seq, r.rule_id) for r in R.apply_rules(df, rs, on, keep=["seq"]).collect()}
    assert pick(True) == pick(False) != set()


def test_parse_kv_last_wins(spark):
    texts = ["target_pid=8 size=4096 x=", "a=1 b=2 a=3", "C:\\path only", "9k=5 =z a==b", None, "k=v=w k2=1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", K.parse_kv(F.col("t")).alias("m")).collect():
        want = dict(re.findall(r"([A-Za-z_][A-Za-z0-9_]*)=([^\s]+)", texts[r.i] or "")) or {"_raw": texts[r.i] or ""}
        assert r.m == want


def test_entropy(spark):
    texts = ["", "aaaa", "abcd", "häß aä", None, "\U0001f600é\U0001f600 a", "é", "ab" * 50000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    bits = lambda t: -sum((t.count(c) / len(t)) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0
    for r in df.select("i", K.entropy_text(F.col("t")).alias("e"), K.entropy_label(F.col("t")).alias("l"), K.entropy_bytes(F.encode("t", "utf-8")).alias("b")).collect():
        t = texts[r.i] or ""
        assert abs(r.e - bits(t)) < 1e-9 and abs(r.l - bits(t)) < 1e-9 and abs(r.b - bits(t.encode())) < 1e-4


def test_closure_of_long_chains_many_parents_and_paths(spark):
    rnd = random.Random(8)
    edges = [("chain", i, i + 1) for i in range(10_000)] + [("ring", i, (i + 1) % 50) for i in range(50)]
    edges += [("mesh", i, i + 1) for i in range(300) if i % 60] + [("mesh", rnd.randrange(300), rnd.randrange(301)) for _ in range(25)]
    seeds = [("chain", 17), ("chain", 9000), ("mesh", 1), ("mesh", 61), ("ring", 7), ("none", 3)]
    e = spark.createDataFrame(edges, "run_id string, parent bigint, child bigint")
    got = {(r.run_id, r.node): (r.depth, [int(x) for x in r.path]) for r in descend(e, spark.createDataFrame(seeds, "run_id string, node bigint"), with_path=True).collect()}
    down = {}
    for run, p, c in edges:
        down.setdefault((run, p), set()).add(c)
    want, level = {s: (0, [s[1]]) for s in seeds}, list(seeds)
    while level:
        new = {}
        for run, p in level:
            for c in down.get((run, p), ()):
                if (run, c) not in want:
                    path = want[(run, p)][1] + [c]
                    # ids are compared as text, as they are in the path
                    new[(run, c)] = min(new.get((run, c), path), path, key=lambda x: [str(v) for v in x])
        want |= {k: (len(v) - 1, v) for k, v in new.items()}
        level = list(new)
    assert got == want


def test_ancestors_over_chains_forks_and_rings(spark):
    links = [("a", i, i // 2) for i in range(1, 400)] + [("b", i, (i + 1) % 7) for i in range(7)] + [("c", i, i + 1) for i in range(5000)]
    seeds = [("a", 399), ("a", 250), ("b", 3), ("c", 40), ("d", 1)]
    for extra in ([], [("a", 250, 77)]):
        parents = {}
        for r, n, p in links + extra:
            parents.setdefault((r, n), set()).add(p)
        want, todo = set(seeds), list(seeds)
        while todo:
            r, n = todo.pop()
            for p in parents.get((r, n), ()):
                if (r, p) not in want:
                    want.add((r, p))
                    todo.append((r, p))
        got = ascend(spark.createDataFrame(links + extra, "run_id string, node bigint, parent bigint"), spark.createDataFrame(seeds, "run_id string, node bigint"))
        assert {(r.run_id, r.node) for r in got.collect()} == want


def test_pattern_hits_offsets(spark):
    docs = ["aa 123 bb 4567", "999", "", "x12 345y678 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id int, text string")
    got = {(r.doc_id, r.offset, r.data) for r in C.pattern_hits(df, [{"rule": "n", "patterns": {"$a": "[0-9]{3,}"}}]).collect()}
    assert got == {(i, m.start(), m.group()) for i, t in enumerate(docs) for m in re.finditer("[0-9]{3,}", t)}


def test_split_matches_plain_algorithm(spark):
    import hashlib

    rows = [(f"k{i}", "malicious" if i % 3 else "benign", f"f{i % 4}" if i % 5 else None) for i in range(230)] + [("s1", "benign", "tiny"), ("s2", "benign", "tiny")]
    frozen = [("k0", "test"), ("k7", "train")]
    got = {r.key: r.split for r in Q.stratified_split(spark.createDataFrame(rows, "key string, label string, family string"), spark.createDataFrame(frozen, "key string, split string")).collect()}
    strata, want = {}, {}
    for k, lab, fam in rows:
        if k not in dict(frozen):
            strata.setdefault(f"{lab}|{fam or 'unlabeled'}", []).append(k)
    for s, keys in strata.items():
        keys.sort(key=lambda k: hashlib.sha256(f"sandbox-corpus-v1|{s}|{k}".encode()).hexdigest())
        n = 0 if len(keys) < 4 else max(1, round(len(keys) * 0.2))
        want.update({k: "test" if i < n else "train" for i, k in enumerate(keys)})
    assert got == want


def test_window_members_brute_force_topology(spark):
    rows = [("p", "1", "ProcessCreate", 1, T0), ("p", "1", "ProcessTerminate", 2, T0 + timedelta(seconds=0.3)), ("p", "2", "ProcessCreate", 3, T0 + timedelta(seconds=1)),
            ("p", "2", "ProcessTerminate", 4, T0 + timedelta(seconds=1.2)), ("p", "3", "ProcessCreate", 5, T0 + timedelta(seconds=2)), ("p", "3", "ProcessTerminate", 6, T0 + timedelta(seconds=2.5)),
            ("p", "4", "ProcessCreate", 7, T0 + timedelta(seconds=2)), ("p", "4", "ProcessTerminate", 8, T0 + timedelta(seconds=9))]
    df = spark.createDataFrame(rows, "run_id string, ProcessId string, event_type string, seq bigint, ts timestamp").withColumn("ParentProcessId", F.lit("77"))
    b = W.process_burst(df)
    assert [(r.ppid, r.n) for r in b.collect()] == [("77", 3)]
    assert sorted(r.pid for r in W.process_burst_members(df, b).collect()) == [1, 2, 3]
