"""Run queries on Spark and their check on DuckDB; print differences. Usage: check_oracles.py [sf] [name-or-prefix ...]"""

import sys
import time

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))
import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from kinforge.fixtures import BASE_TABLES  # noqa: E402
from kinforge.session import build_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, bool):
        return str(v).lower()
    return "∅" if v is None else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.001"
    d = f"/root/testdata/{sf}"
    spark = build_session()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    qs, orc = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, d)
            cols, got = df.columns, [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[:600]}")
            bad.append(name)
            continue
        t1 = time.time()
        if name not in orc:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(orc[name])
            ocols = [c[0] for c in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ORACLE-FAIL {name}: {str(e)[:600]}")
            bad.append(name)
            continue
        t2 = time.time()
        if sorted(cols) != sorted(ocols):
            print(f"COLS {name}: {sorted(cols)} vs {sorted(ocols)}")
            bad.append(name)
            continue
        a, b = rows_of(cols, got), rows_of(ocols, want)
        types = {c: t for c, t in df.dtypes}
        if a != b:
            extra, missing = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
            print(f"DIFF {name}: {len(a)} vs {len(b)} cols={sorted(cols)}\n  spark {extra}\n  duck  {missing}")
            bad.append(name)
        else:
            print(f"ok   {name}: {len(a)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s" + ("" if a else "  EMPTY"))
        del types
    print("BAD", bad)


if __name__ == "__main__":
    main()
