"""Operators whose groups are cut into stretches give what the whole group gives."""

import pandas as pd

from detectframe.operators import calls as P
from detectframe.operators import rollup as U


def test_a_signature_sees_a_process_across_cuts(spark):
    api = lambda i: "open" if i in (3, 28) else "write" if i in (17, 29) else "other"
    rows = spark.createDataFrame([("r", p, i, api(i)) for p in (1, 2) for i in range(30) if p == 1 or i < 20], "run_id string, pid bigint, seq bigint, api string")

    def on_calls(pdf):
        return pdf.loc[pdf["api"] != "other", ["run_id", "pid", "seq", "api"]]

    def merge(parts):
        pairs = (parts["api"] == "write") & (parts["api"].shift() == "open")
        return pd.DataFrame({"run_id": parts["run_id"][:1], "pid": parts["pid"][:1], "seq": [int(pairs.sum())], "api": ["pairs"]})

    got = P.per_process(rows, on_calls, "run_id string, pid bigint, seq bigint, api string", ["api"], merge, chunk=10)
    assert {(r.pid, r.seq) for r in got.collect()} == {(1, 2), (2, 1)}


def test_a_long_script_is_one_row(spark):
    rows = spark.createDataFrame([("r", "b", i + 1, f"{i},", "p" if i == 7 else None, i) for i in range(2500)], "run_id string, block_id string, number long, text string, path string, seq long")
    got = U.script_blocks(rows.repartition(5)).collect()
    assert [(r.n_fragments, r.text, r.path) for r in got] == [(2500, "".join(f"{i}," for i in range(2500)), "p")]
    parts = U.script_block_parts(rows).orderBy("part").collect()
    assert [r.n_fragments for r in parts] == [1000, 1000, 500] and "".join(r.text for r in parts) == got[0].text
