"""Run registered queries against their DuckDB oracles: python tests/check_oracles.py [sf] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def compare(spark, db, name, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    pick = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in pick) for r in cursor.fetchall())
    spark_kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    if rows != expected:
        a, b = set(rows), set(expected)
        return (f"rows {len(rows)} vs {len(expected)}; columns {columns}; "
                f"only spark {sorted(a - b)[:3]}; only duckdb {sorted(b - a)[:3]}")
    alias = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER",
             "float": "FLOAT"}
    wrong = {c: (spark_kinds[c], kinds[c]) for c in columns if alias.get(spark_kinds[c]) != kinds[c].upper()}
    return f"types {wrong}" if wrong else None


def main(argv):
    import __spark_entry__ as E
    from sonde import build_session

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    if os.environ.get("PLAIN_SESSION"):  # no library settings at all
        from pyspark.sql import SparkSession

        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
        spark = SparkSession.active()
    else:
        spark = build_session("oracles", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                              spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db, queries, oracles, bad = duck(sf_dir), E.queries(), E.oracle_sql(), 0
    for name, query in queries.items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        begin = time.time()
        try:
            if name in oracles:
                outcome = compare(spark, db, name, query, oracles[name], sf_dir)
            else:
                outcome = None if (n := query(spark, sf_dir).count()) else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            outcome = f"{type(error).__name__}: {str(error)[:300]}"
        bad += outcome is not None
        print(f"{'ok  ' if outcome is None else 'FAIL'} {time.time() - begin:6.2f}s {name} "
              f"{'' if name in oracles else '(no oracle)'} {outcome or ''}", flush=True)
    print(f"{bad} bad; oracle-less: {sorted(set(queries) - set(oracles))}; orphan oracles {sorted(set(oracles) - set(queries))}")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
