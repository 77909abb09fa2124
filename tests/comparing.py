"""Run a query on Spark and its SQL on DuckDB over the same files and compare the rows as multisets."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


# DuckDB's name of each Spark type, to see that schemas agree.
_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


def compare(spark, query, sql: str, folder: str, con=None) -> list[str]:
    """Differences, empty when both sides agree."""
    con = con or connect(folder)
    df = query(spark, folder)
    got = _rows(df.columns, df.collect())
    result = con.execute(sql)
    columns = {d[0]: str(d[1]) for d in result.description}
    want = _rows(list(columns), result.fetchall())
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    types = {n: (_TYPES.get(t, t), columns.get(n)) for n, t in df.dtypes}
    wrong = {n: pair for n, pair in types.items() if pair[0] != pair[1]}
    if wrong:
        problems.append(f"types {wrong}")
    if got != want:
        extra, missing = got - want, want - got
        problems.append(
            f"{sum(got.values())} rows != {sum(want.values())}; only Spark {list(extra)[:2]}; only SQL {list(missing)[:2]}"
        )
    return problems
