"""Results of Spark and of DuckDB as sorted rows of text."""

import math
from pathlib import Path

import duckdb


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if hasattr(x, "__len__") and not isinstance(x, (str, bytes)):
        return "[" + ",".join(map(value, x)) + "]"
    if isinstance(x, str):
        return x
    return f"{float(x):.6f}" if hasattr(x, "__float__") else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(value, r)) for r in frame[columns].itertuples(index=False))


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(sql).df()
