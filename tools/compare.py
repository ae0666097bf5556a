"""Run registered queries beside their checking SQL and compare the results.

usage: python tools/compare.py [--sf 0.01] [--plans] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import importlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from casemeter.plans import catalog  # noqa: E402
from casemeter.session import builder  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """``(ok, message, spark seconds, sql seconds)`` of one query."""
    t = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time() - t
    if name not in catalog.CHECKS:
        return True, f"rows only: {len(rows)}", t1, 0.0
    t = time.time()
    cur = con.execute(catalog.CHECKS[name])
    expected = cur.fetchall()
    t2 = time.time() - t
    a, b = canonical(df.columns, rows), canonical([d[0] for d in cur.description], expected)
    if a[0] != b[0]:
        return False, f"columns {a[0]} <> {b[0]}", t1, t2
    if len(rows) != len(expected):
        return False, f"rows {len(rows)} <> {len(expected)}; e.g. {a[1][:1]} / {b[1][:1]}", t1, t2
    diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if diff:
        return False, f"{len(diff)} of {len(rows)} rows differ; e.g. {diff[0]}", t1, t2
    return True, f"{len(rows)} rows", t1, t2


def main(argv):
    sf, prefixes, plans = "0.01", [], False
    args = iter(argv)
    for a in args:
        if a == "--sf":
            sf = next(args)
        elif a == "--plans":
            plans = True
        else:
            prefixes.append(a)
    sections = [p[1:] for p in prefixes if p.startswith("@")]
    prefixes = [p for p in prefixes if not p.startswith("@")]
    if sections:
        for s in sections:
            importlib.import_module(f"casemeter.plans.{s}")
    else:
        catalog.load_all()
    names = [n for n in catalog.QUERIES if not prefixes or any(n.startswith(p) for p in prefixes)]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        builder("compare", "local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    for name in names:
        try:
            if plans:
                catalog.QUERIES[name](spark, sf_dir).explain("formatted")
            ok, msg, t1, t2 = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, msg, t1, t2 = False, f"{type(e).__name__}: {str(e)[:900]}", 0, 0
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {t1:6.2f}s {t2:6.2f}s  {msg if ok else msg[:1200]}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} agree; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
