"""Run registered queries against their SQL twins: ``python tests/verify.py [prefix ...]``.

Environment: ``SF`` (default 0.01).
"""

from __future__ import annotations

import logging
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from checks.bindings import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP"}


def compare(spark, con, name, query, sql, sf_dir):
    """``None`` when the two agree, else a short description of the difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}", len(got[1])
    spark_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    if spark_types != duck_types:
        bad = {c: (spark_types[c], duck_types[c]) for c in spark_types if spark_types[c] != duck_types[c]}
        return f"types {bad}", len(got[1])
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (f"rows {len(got[1])} / {len(want[1])}; only spark {sorted(map(str, a - b))[:3]}; "
                f"only sql {sorted(map(str, b - a))[:3]}"), len(got[1])
    return None, len(got[1])


def main():
    import __spark_entry__ as entry
    from clinprep.session import build_session

    sf_dir = f"/root/testdata/sf{os.environ.get('SF', '0.01')}"
    spark = build_session("verify", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:500]}", -1
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:40s} {n:7d} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
