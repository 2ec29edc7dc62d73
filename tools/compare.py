"""Run registered queries against the checking database and report differences.

usage: python tools/compare.py [--dir DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from guardlake.plans.registry import load_all  # noqa: E402
from guardlake.plans.inputs import Tables  # noqa: E402
from guardlake.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(con, spark, folder, q) -> str:
    start = time.time()
    df = q.build(Tables(spark, folder))
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if q.sql is None:
        return f"rows {len(got)} (no SQL) {took:.1f}s"
    start = time.time()
    ref = con.execute(q.sql)
    names = [d[0] for d in ref.description]
    want = ref.fetchall()
    db = time.time() - start
    a, b = rows_of(df.columns, got), rows_of(names, want)
    kinds = {d[0]: str(d[1]) for d in ref.description}
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    if a[0] != b[0]:
        return f"COLUMNS {a[0]} vs {b[0]}"
    same_type = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}
    odd = [(n, t, kinds[n]) for n, t in types.items() if same_type.get(t) != kinds[n]]
    if a[1] != b[1]:
        only = [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2]
        return f"DIFFER {len(got)} vs {len(want)} rows; {a[0]}\n   ours {only[0]}\n   sql  {only[1]}"
    return f"ok {len(got)} rows {took:.1f}s (sql {db:.1f}s)" + (f" TYPES {odd}" if odd else "")


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--dir", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{opt.dir}/{t}.parquet'")
    bad = 0
    for name, q in load_all().items():
        if opt.names and not any(name.startswith(n) for n in opt.names):
            continue
        try:
            said = compare(con, spark, opt.dir, q)
        except Exception as exc:  # noqa: BLE001 - report and go on
            said = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        bad += not said.startswith(("ok", "rows"))
        print(f"{name}: {said}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
