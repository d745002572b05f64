"""Run queries against their DuckDB SQL: python -m tests.compare [sf] [name ...]"""

from __future__ import annotations

import math
import re
import sys
import time
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks segments actions jobs clips removed_files tasks retired_tasks eval_items".split()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        v = v.item() if getattr(v, "ndim", 0) == 0 else list(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    t = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    s = time.time() - t
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    if sorted(have) != cols:
        return False, f"columns {cols} against {sorted(have)}"
    order = [have.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
    ok = got == want
    more = "" if ok else f" only Spark {list((got - want).items())[:3]} only SQL {list((want - got).items())[:3]}"
    return ok, f"{sum(got.values())} rows, {s:.1f} s{more}"


def main(args: list[str]) -> int:
    import __spark_entry__ as e
    from frameloom.session import get_spark

    sf = args[0] if args else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    names = args[1:] or list(e.oracle_sql())
    if len(names) == 1 and not names[0].isidentifier():  # a pattern
        names = [n for n in e.oracle_sql() if re.search(names[0], n)]
    spark, con = get_spark(cpus=8), duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, what = compare(spark, con, n, e.queries()[n], e.oracle_sql()[n], sf_dir)
        except Exception as x:  # noqa: BLE001
            ok, what = False, f"{type(x).__name__}: {str(x)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, what, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
