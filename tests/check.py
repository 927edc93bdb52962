"""Compare every registered query with its SQL on DuckDB; run as a script for a report."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def as_rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(canonical(r[i]) for i in order) for r in records)


def compare(spark_df, con, sql) -> str:
    """Empty text when both agree on names, type classes, row count and values."""
    table = spark_df.toArrow()
    left_names, left = as_rows(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])))
    cursor = con.execute(sql)
    right_table = cursor.to_arrow_table() if hasattr(cursor, "to_arrow_table") else cursor.fetch_arrow_table()
    right_names, right = as_rows(
        right_table.column_names, list(zip(*[c.to_pylist() for c in right_table.columns]))
    )
    if left_names != right_names:
        return f"columns {left_names} against {right_names}"
    types = {f.name: str(f.type) for f in right_table.schema}
    wrong = {
        f.name: (str(f.type), types[f.name])
        for f in table.schema
        if str(f.type).replace("large_", "") != types[f.name].replace("large_", "")
    }
    if wrong:
        return f"types {wrong}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{a} against {b}"
    return "" if left else "no rows"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from varloom.session import remove_written

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="varloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = oracle(sf_dir), entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                note = compare(df, con, sqls[name])
            else:
                n = len(df.toArrow())
                note = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(note)
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if note else 'ok':4} {kind:4} {time.time() - start:6.2f}s {name} {note}", flush=True)
    remove_written(spark)
    print("failed", failed)


if __name__ == "__main__":
    main()
