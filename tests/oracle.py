"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> tuple[list[str], list[str], list[tuple]]:
    """Column names, value kinds and sorted rows."""
    frame = frame[sorted(frame.columns)]
    kinds = []
    for name in frame.columns:
        kind = frame[name].dtype.kind
        kinds.append({"i": "int", "u": "int", "f": "num", "b": "bool", "M": "time", "O": "obj"}.get(kind, kind))
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple("NULL" if pd.isna(v) else (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row))
    return list(frame.columns), kinds, sorted(rows)


def compare(spark, con, sf_dir: str, plan, sql: str) -> tuple[bool, str]:
    started = time.time()
    left = canonical(plan(spark, sf_dir).toPandas())
    took = time.time() - started
    right = canonical(con.execute(sql).df())
    if left[0] != right[0]:
        return False, f"columns {left[0]} vs {right[0]}"
    problems = []
    if left[1] != right[1] and left[2]:
        problems.append(f"kinds {list(zip(left[0], left[1], right[1]))}")
    if left[2] != right[2]:
        a, b = set(left[2]), set(right[2])
        problems.append(f"rows {len(left[2])} vs {len(right[2])}; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}")
    return not problems, "; ".join(problems) or f"{len(left[2])} rows, {took:.1f}s"


def session():
    from quarry.session import build_session

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": os.environ.get("SCRATCH", "/tmp/quarry-scratch")})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from quarry.session import release_scratch

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at : at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    plans, oracles = entry.queries(), entry.oracle_sql()
    names = argv or list(plans)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        try:
            if name in oracles:
                good, note = compare(spark, con, sf_dir, plans[name], oracles[name])
            else:
                started = time.time()
                good, note = True, f"{plans[name](spark, sf_dir).count()} rows, no oracle, {time.time() - started:.1f}s"
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        release_scratch(spark)
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
