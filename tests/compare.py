"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA", "/root/testdata")


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_tuple") or hasattr(v, "item"):
        return float(f"{float(v):.9g}")
    return str(v)


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows={len(got)} (no oracle)", len(got)
    cur = con.execute(sql)
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    if got == want:
        odd = [(c, types[c], dtypes[c]) for c in got_cols if dtypes[c] in ("HUGEINT",) or types[c].startswith("decimal") or dtypes[c].startswith("DECIMAL")
               or (types[c] == "int") != (dtypes[c] == "INTEGER")]
        return True, f"rows={len(got)}" + (f" types {odd}" if odd else ""), len(got)
    a, b = set(got), set(want)
    return False, f"rows {len(got)} vs {len(want)}; only spark {list(a - b)[:3]}; only sql {list(b - a)[:3]}", len(got)


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").appName("compare").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    sf_dir = f"{DATA}/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            ok, text, n = compare(spark, con, name, fn, sql.get(name), sf_dir)
            if n == 0:
                text += " EMPTY"
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok ' if ok else 'BAD'} {name:34} {time.time() - t:6.1f}s {text}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
