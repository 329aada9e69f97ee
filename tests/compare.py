"""A query against its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "tzinfo") and hasattr(x, "replace"):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """An empty string, or what differs."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    wanted_columns, wanted = rows([d[0] for d in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"{name}: columns {columns} and {wanted_columns}"
    if got != wanted:
        a, b = set(got) - set(wanted), set(wanted) - set(got)
        return f"{name}: {len(got)} and {len(wanted)} rows; only here {sorted(a, key=repr)[:3]}; only in SQL {sorted(b, key=repr)[:3]}"
    return ""
