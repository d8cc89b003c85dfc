"""Run registered queries against their SQL in DuckDB: python tools/check.py [name ...]"""

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from vesselspark import catalog  # noqa: E402
from vesselspark.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(i) for i in v) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    modules = os.environ.get("MODULES")
    if modules:
        import importlib
        for m in modules.split(","):
            importlib.import_module(f"vesselspark.catalog.{m}")
    else:
        catalog.load()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    names = sys.argv[1:] or list(catalog.QUERIES)
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf)
            cols = sorted(df.columns)
            got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in catalog.ORACLE:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            rel = con.execute(catalog.ORACLE[name])
            names_ = [d[0] for d in rel.description]
            want = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: oracle {str(e)[:600]}", flush=True)
            continue
        if sorted(names_) != cols:
            bad.append(name)
            print(f"FAIL {name}: columns {cols} / {sorted(names_)}", flush=True)
            continue
        pick = [names_.index(c) for c in cols]
        a = sorted(tuple(plain(v) for v in r) for r in got)
        b = sorted(tuple(plain(r[i]) for i in pick) for r in want)
        if a != b:
            bad.append(name)
            in_a, in_b = set(a), set(b)
            only_a, only_b = sorted(in_a - in_b)[:3], sorted(in_b - in_a)[:3]
            print(f"DIFF {name}: {len(a)} / {len(b)} rows\n  cols {cols}\n  spark {only_a}\n  sql   {only_b} ({len(in_a - in_b)} differ)", flush=True)
        else:
            types = [t for _, t in df.select(*[f"`{c}`" for c in cols]).dtypes]
            print(f"ok   {name}: {len(a)} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s" + ("  EMPTY" if not a else ""), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
