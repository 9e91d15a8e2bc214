"""Compare a query with its SQL, as sorted rows with columns by name."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET threads=8")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(repr(r[i]) for i in order) for r in rows))


def difference(df, db, sql: str) -> str | None:
    """None when both give the same, else a short report."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    spark_kinds = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    bad = {c: (spark_kinds[c], kinds[c]) for c in names if same.get(spark_kinds[c]) != kinds[c]}
    if bad:
        return f"types {bad}"
    if not mine[1]:
        return "no rows"
    if mine[1] != theirs[1]:
        left, right = set(mine[1]), set(theirs[1])
        show = lambda s: [str(x)[:700] for x in sorted(s)[:2]]
        return f"{len(mine[1])} vs {len(theirs[1])} rows; mine only {show(left - right)}; sql only {show(right - left)}"
    return None


if __name__ == "__main__":
    import time
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    folder, only = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    db, sqls = connect(folder), entry.oracle_sql()
    failed = 0
    for name, plan in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            report = difference(plan(spark, folder), db, sqls[name]) if name in sqls else \
                (None if plan(spark, folder).collect() else "no rows")
        except Exception as e:
            report = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += report is not None
        print(f"{name:28} {time.time() - start:6.2f}s {'ok' if report is None else 'FAIL ' + report}", flush=True)
    print("failed:", failed)
