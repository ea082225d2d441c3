"""Compares registered queries with their SQL on one data folder.

Usage: python tests/check_oracles.py [sf_dir] [name ...]
"""

import datetime as dt
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value:.6f}")
    if isinstance(value, (dt.date, dt.datetime)):
        return (1, value.isoformat()[:10])
    return (1, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, build, sql):
    """None when equal, else a description of the difference."""
    frame = build(spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    kinds = {c[0]: str(c[1]) for c in result.description}
    odd = [f"{k}:{kinds[k]}" for k in columns if "HUGEINT" in kinds[k] or "DECIMAL" in kinds[k]]
    if odd:
        return f"result types {odd}"
    if ours != theirs:
        known, wanted = set(ours), set(theirs)
        only = [r for r in ours if r not in wanted][:2], [r for r in theirs if r not in known][:2]
        return f"{len(ours)} rows, expected {len(theirs)}; only ours / only expected: {only}"
    return None if ours else "no rows"


def main(argv):
    from depotflow.plans.catalog import ORACLES, QUERIES
    from depotflow.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                problem = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "BAD "
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - begin:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
