"""Compares a registered query with its SQL on DuckDB, as multisets of rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def differences(spark, con, query, sql, sf_dir, out):
    """(rows only in SQL, rows only in Spark, SQL's column types, Spark's)."""
    query(spark, sf_dir).write.mode("overwrite").parquet(str(out))
    con.execute(f"CREATE OR REPLACE TABLE s AS SELECT * FROM '{out}/*.parquet'")
    con.execute(f"CREATE OR REPLACE TABLE o AS {sql}")
    kinds = [{r[0]: r[1] for r in con.sql(f"DESCRIBE {t}").fetchall()} for t in "os"]
    names = ", ".join(f'"{n}"' for n in sorted(kinds[0]))
    counts = [con.sql(f"SELECT count(*) FROM (SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b})").fetchall()[0][0] for a, b in ("os", "so")]
    return *counts, *kinds
