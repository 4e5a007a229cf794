"""Run catalog queries on Spark and their SQL on DuckDB and compare the results.

usage: python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "item"):
        return normal(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted((tuple(normal(r[n]) for n in order) for r in rows), key=repr)


def oracle_rows(folder: str, sql: str):
    import duckdb

    def run(**config):
        connection = duckdb.connect(config=config)
        for table in TABLES:
            connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
        return connection.execute(sql)

    try:
        cursor = run()
    except duckdb.InternalException:  # an assertion inside the engine that single-threaded runs don't meet
        cursor = run(threads=1)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    return columns, cursor.fetchall(), types


def compare(spark, folder: str, name: str, query):
    started = time.time()
    df = query.run(spark, folder)
    rows = df.collect()
    spark_seconds = time.time() - started
    if query.sql is None:
        return "rows", len(rows), spark_seconds, ""
    started = time.time()
    columns, expected, types = oracle_rows(folder, query.sql)
    note = f"duck {time.time() - started:.1f}s"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{t}/{types.get(c)}" for c, t in spark_types.items() if same.get(t) != types.get(c)]
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(rows), spark_seconds, f"{sorted(df.columns)} vs {sorted(columns)}"
    mine, other = rows_of(df.columns, [tuple(r) for r in rows]), rows_of(columns, expected)
    if mine == other:
        return ("ok" if not odd else "TYPES"), len(rows), spark_seconds, note + " " + ",".join(odd)
    mine_set, other_set = set(mine), set(other)
    extra, missing = list(mine_set - other_set)[:3], list(other_set - mine_set)[:3]
    return "DIFF", len(rows), spark_seconds, f"{len(mine)}/{len(other)} rows; only spark {extra}; only sql {missing}; {note}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    from voxframe.plans.catalog import REGISTRY
    from voxframe.session import build_session

    spark = build_session()
    folder = f"/root/testdata/sf{options.sf}"
    bad = 0
    for name, query in REGISTRY.items():
        if options.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in options.names):
            continue
        try:
            status, count, seconds, note = compare(spark, folder, name, query)
        except Exception as error:  # report and go on with the next query
            status, count, seconds, note = "ERROR", 0, 0.0, str(error)[:1500]
        bad += status not in ("ok", "rows")
        print(f"{status:8s} {name:32s} {count:8d} rows {seconds:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
