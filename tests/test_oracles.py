"""Registered queries against their SQL twins on the smallest tables (ALL_QUERIES=1 runs every one)."""

import os

import pytest

import __spark_entry__ as entry
from compare import DATA, compare, duck

SF = f"{DATA}/sf0.001"
QUICK = (
    "a3 a8 a13 a18 b2 b7 b9 b10 b14 c2 c6 c9_event_count d2 d6 d11 e1 e3 e7_ioc_verdicts e9 e10 f7 f8_verdict f9 f15_conv g1_ g8 h1 h3_net h5 i2 j1_page_e k1 k5 k10 l2_app l4 m2_cursor_read n2_rates n7_thr n8 n16 o1_pat o2 p1 p5"
).split()

NAMES = [n for n in entry.queries() if os.environ.get("ALL_QUERIES") or any(n.startswith(q) for q in QUICK)]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_twin(spark, con, name):
    ok, text, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, text


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "score", "level", "n_findings", "mass_write"] and df.count() > 0
