"""Run registered queries against their SQL on DuckDB: ``python -m tests.oracle [sf_dir] [name-part …]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return rows_of(cols, res.fetchall())


def compare(left, right) -> str | None:
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns {lc} vs {rc}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} vs {len(rr)}: {[x for x in lr if x not in set(rr)][:3]} / {[x for x in rr if x not in set(lr)][:3]}"
    for a, b in zip(lr, rr):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} vs {b}"
    return None


def main(argv):
    from flowloom.plans import catalog
    from flowloom.plans.adapters import Tables
    from flowloom.session import local_session

    sf = argv.pop(0) if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session("oracle", 8)
    con = connect(sf)
    bad = 0
    for name, q in catalog.load().items():
        if argv and not any(a in name for a in argv):
            continue
        started = time.time()
        try:
            got = spark_rows(q.build(Tables(spark, sf)))
            took = time.time() - started
            if q.sql:
                problem = compare(got, duck_rows(con, q.sql))
            else:
                problem = None
            note = "rows only" if not q.sql else "ok"
            print(f"{'FAIL' if problem else note:9} {name:40} {len(got[1]):7} rows {took:6.2f}s {problem or ''}"[:900], flush=True)
        except Exception as exc:
            problem = "error"
            text = str(exc).split("JVM stacktrace")[0]
            print(f"ERROR     {name:40} {type(exc).__name__} {text[:260]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problem)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
