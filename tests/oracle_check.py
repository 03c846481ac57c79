"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows on each side, column match and value match.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "timestamp_ntz": "TIMESTAMP"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(base):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{base}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from affinity.session import build_session
    spark = build_session()
    q, o = queries(), oracle_sql()
    con = duck(base)
    bad = 0
    for name in (names or list(q)):
        t0 = time.time()
        try:
            df = q[name](spark, base)
            cols = df.columns
            srows = rows_of([tuple(r) for r in df.collect()], cols)
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in o:
            print(f"{name:32s} spark={len(srows):8d} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(o[name])
            dcols = [d[0] for d in cur.description]
            drows = rows_of(cur.fetchall(), dcols)
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} DUCKDB ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        colok = sorted(cols) == sorted(dcols)
        stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                  for f in df.schema.fields}
        dtypes = {d[0]: str(d[1]) for d in cur.description}
        tdiff = {c: (stypes.get(c), dtypes.get(c)) for c in stypes if stypes.get(c) != dtypes.get(c)}
        if tdiff:
            print(f"   TYPES {name}: {tdiff}")
        valok = srows == drows
        if not (colok and valok):
            bad += 1
        print(f"{name:32s} spark={len(srows):8d} duck={len(drows):8d} cols={'ok' if colok else 'DIFF'} "
              f"values={'ok' if valok else 'DIFF'} {ts:.1f}s")
        if not colok:
            print("   spark cols", sorted(cols), "\n   duck cols ", sorted(dcols))
        elif not valok:
            sd, dd = set(srows), set(drows)
            print("   only spark:", list(sd - dd)[:3])
            print("   only duck: ", list(dd - sd)[:3])
    print("mismatches:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
