"""Compare registered queries with their check statements in DuckDB.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pitsignal.plans.registry import all_oracles, all_queries  # noqa: E402
from pitsignal.sources.tables import TABLES  # noqa: E402


TIMES: dict[str, list[float]] = {}  # seconds in Spark and in DuckDB


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, sf_dir: str, name: str, report_only: bool = False) -> str | None:
    """None when equal, else a description of the first difference."""
    start = time.time()
    df = all_queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    TIMES[name] = [time.time() - start]
    sql = all_oracles().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    start = time.time()
    cur = con.execute(sql)
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    TIMES[name].append(time.time() - start)
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    if not got[1]:
        return "no rows on either side"
    for g, w in zip(got[1], want[1]):
        if g != w:
            bad = [(c, a, b) for c, a, b in zip(got[0], g, w) if a != b]
            return f"first difference {bad}\n   spark {g}\n   check {w}"
        types = [(c, type(a), type(b)) for c, a, b in zip(got[0], g, w) if type(a) is not type(b)]
        if types:
            return f"types {types}"
    return None


def main() -> None:
    from pitsignal.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries())
    spark = get_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, sf_dir, name)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += problem is not None
        kind = "" if name in all_oracles() else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {[round(t, 1) for t in TIMES.get(name, [])]} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
