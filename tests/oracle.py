"""Runs a query and its SQL twin side by side and compares rows without order."""

import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) else v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """(ok, message)"""
    got_cols = spark_df.columns
    got = normal(got_cols, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = normal(want_cols, rel.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if got == want:
        return True, f"{len(got)} rows"
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} vs {len(want)} rows; spark only {extra}; sql only {missing}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from shelfwatch.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(f"/root/testdata/sf{sf}")
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = build(spark, f"/root/testdata/sf{sf}")
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                ok, msg = True, f"{df.count()} rows, no SQL"
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
            if len(only) == 1:
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {msg[:1200]}", flush=True)
    print("failed:", bad)
