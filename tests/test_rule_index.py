"""The rule index: numbers lead to rules too, common words are left to rarer ones, no row carries the index."""

from detectframe.operators import rules as R

VALUES = ["5", " 5 ", "5.0", "05", "4.999", "6", "-1", "0", "-0.0", "NaN", "Infinity", "x", "", None, "1e400", "7"]


def rule(i, detection, condition="sel"):
    return {"id": f"n{i}", "level": "high", "logsource": {"category": "file_event"}, "detection": {**detection, "condition": condition}}


RULES = [rule(i, *d) for i, d in enumerate([
    [{"sel": {"A": 5}}], [{"sel": {"A": [0, 6]}}], [{"sel": {"A|gte": 5, "A|lt": 6}}], [{"sel": {"A|gt": 5}, "up": {"A|lte": 7}}, "sel and up"],
    [{"sel": {"A|gt": 0, "A|lt": 5}}], [{"sel": {"A": 5}, "b": {"B": 7}}, "sel or b"], [{"sel": {"A": 5}, "b": {"B": 7}}, "sel and not b"],
    [{"sel": {"A|gt": 6, "A|lt": 5}}], [{"sel": {"B": 5, "T|contains": ["common", "rare1"]}}], [{"sel": {"T|contains|all": ["common", "rare2"]}}],
])]
OPEN = [rule(90, {"sel": {"A|gt": 6}}), rule(91, {"sel": {"A": 5}, "b": {"B|lt": 0}}, "sel or b"), rule(92, {"sel": {"A|neq": 5}})]


def test_numbers_lead_to_rules(spark):
    rows = [(i * 100 + j, "FileCreate", "sysmon", a, b, f"common rare{j % 3}") for i, a in enumerate(VALUES) for j, b in enumerate(VALUES)]
    events = spark.createDataFrame(rows, "seq long, event_type string, source string, A string, B string, T string").selectExpr("*", "11 AS event_id")
    rs = R.compile_rules(RULES + OPEN)
    on, off = (sorted(map(tuple, R.apply_rules(events, rs, p, ["seq"]).collect())) for p in (True, False))
    assert on == off and len({r for _, r in on}) == len(RULES) - 1 + len(OPEN)


def test_only_rules_without_a_pair_are_always_met():
    rs = R.compile_rules(RULES + OPEN)
    bucket = R.anchor_index(rs)[0]["type/FileCreate"]
    assert [rs.rules[i].rule_id for i in bucket["a"]] == ["n90", "n91", "n92"]
    assert [e["t"] for of in bucket["t"] for e in of] == ["rare2"]


def test_no_row_carries_the_index(spark):
    events = spark.createDataFrame([("FileCreate", "sysmon", 11, "5", "7", "rare2")], "event_type string, source string, event_id int, A string, B string, T string")
    plan = R.apply_rules(events, R.compile_rules(RULES), keep=["A"])._jdf.queryExecution().optimizedPlan()
    while plan.children().size():
        names = [plan.output().apply(i).dataType().simpleString() for i in range(plan.output().size())]
        assert not any(n.startswith("map") for n in names), names
        plan = plan.children().apply(0)
