"""Run named queries beside their check SQL and compare the results.

    python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from rankloom.catalogue.registry import load_all  # noqa: E402
from rankloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return [columns[i] for i in at], sorted(out, key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    entries = load_all()
    names = sys.argv[2:] or list(entries)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        e = entries[name]
        t0 = time.time()
        try:
            df = e.run(spark, sf_dir)
            cols, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {str(exc)[:700]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if not e.check_sql:
            print(f"{name:28s} rows-only {len(rows)} {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(e.check_sql)
            ocols, orows = ordered([d[0] for d in cur.description], cur.fetchall())
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} SQL ERROR {str(exc)[:700]}", flush=True)
            bad += 1
            continue
        ok = cols == ocols and rows == orows
        types = dict(df.dtypes)
        print(f"{name:28s} {'ok' if ok else 'MISMATCH'} {len(rows)}/{len(orows)} "
              f"spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
        if not ok:
            bad += 1
            if cols != ocols:
                print("   columns", cols, ocols)
            a, b = set(rows), set(orows)
            print("   only spark", sorted(a - b, key=repr)[:2])
            print("   only sql  ", sorted(b - a, key=repr)[:2], types)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
