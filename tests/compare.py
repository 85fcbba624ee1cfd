"""Row comparison of a Spark result with SQL run in DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(table) -> list[tuple]:
    """Rows of an Arrow table as sortable tuples, columns by name."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns)]
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def types_of(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "").replace("string_view", "string") for f in table.schema}
