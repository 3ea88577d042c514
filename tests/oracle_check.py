"""Run registered queries beside their SQL and compare the rows, whatever their order.

Usage: python tests/oracle_check.py SF_DIR [NAME ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, fn, text: str) -> str:
    """Empty when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    found = con.execute(text)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if a != b:
        only_a, only_b = list((a - b).items()), list((b - a).items())
        return f"{sum((a - b).values())} rows differ: {only_a[:2]} / {only_b[:2]}"
    return ""


def main() -> None:
    from cargolens.plans.staging import release
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, sf_dir, fn, oracle[name])
            else:
                problem = "" if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        kind = "sql" if name in oracle else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    release(spark)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
