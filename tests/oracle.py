"""python tests/oracle.py [NAME...]: queries against their SQL in DuckDB (sf0.01 or $SF_DIR)."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (round(v, 9) + 0.0)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    t = time.time()
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    return got, want, t1 - t, time.time() - t1


if __name__ == "__main__":
    import __spark_entry__ as e
    from engramql.session import local_session

    spark = local_session()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for n in sys.argv[1:] or list(q):
        try:
            if n in o:
                got, want, a, b = compare(spark, n, q[n], o[n], sf)
                ok = got == want
                print(f"{'ok  ' if ok else 'DIFF'} {n} rows {len(got[1])}/{len(want[1])} spark {a:.1f}s sql {b:.1f}s", flush=True)
                if not ok:
                    bad += 1
                    print("   ", got[0], want[0])
                    g, w = set(map(repr, got[1])), set(map(repr, want[1]))
                    print("    only spark:", sorted(g - w)[:3])
                    print("    only sql:  ", sorted(w - g)[:3], flush=True)
            else:
                t = time.time()
                print(f"rows {n} {q[n](spark, sf).count()} {time.time() - t:.1f}s", flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: {str(x)[:1500]}", flush=True)
    print("bad", bad, flush=True)
    spark.stop()
    os._exit(int(bad > 0))
