"""Run registered queries in Spark and in DuckDB on the same tables and compare all rows.

    python tools/check_oracle.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pressgauge.session import local_session  # noqa: E402
from pressgauge.workload import registry  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when the two sides agree, else what differs."""
    df = registry.queries()[name](spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    text = registry.oracle_sql().get(name)
    if text is None:
        return "" if left else "no rows"
    cur = con.execute(text)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    right = rows_of(columns, cur.fetchall())
    if not left:
        return "no rows"
    if left != right:
        only_left = [r for r in left if r not in set(map(tuple, right))][:3]
        only_right = [r for r in right if r not in set(map(tuple, left))][:3]
        return f"{len(left)} / {len(right)} rows; spark only {only_left}; duckdb only {only_right}"
    types = {type(c) for r in left for c in r} | {type(c) for r in right for c in r}
    odd = [t.__name__ for t in types if t.__name__ not in ("str", "int", "float", "bool", "NoneType")]
    return f"uncomparable types {odd}" if odd else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(8), duck(sf_dir)
    bad = 0
    for name in registry.queries():
        if args.names and not any(part in name for part in args.names):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        kind = "sql" if name in registry.oracle_sql() else "rows"
        print(f"{'BAD' if problem else 'ok '} {name} [{kind}] {time.time() - started:.1f}s {problem}",
              flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
