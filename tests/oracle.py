"""Compares registered queries with their DuckDB counterparts.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("LOREKEEP_TESTDATA", "/root/testdata")
KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int", "hugeint": "wide",
         "varchar": "text", "string": "text", "double": "real", "float": "real", "boolean": "bool"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL's, empty when they agree."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = _rows(names, found.fetchall())
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1])) for d in found.description}
    got = _rows(df.columns, df.collect())
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} against {kinds[name]}")
    if got != want:
        problems.append(f"{sum(got.values())} rows against {sum(want.values())}")
        problems += [f"  only in Spark: {row}"[:400] for row in list((got - want).keys())[:3]]
        problems += [f"  only in SQL:   {row}"[:400] for row in list((want - got).keys())[:3]]
    return problems


def main() -> int:
    from lorekeep.plans.catalog import ORACLES, QUERIES
    from lorekeep.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"{DATA}/sf{args.sf}"
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problems = compare(df, con, ORACLES[name])
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        label = "ok  " if not problems else "FAIL"
        print(f"{label} {name} {'' if name in ORACLES else '(rows only) '}{time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
