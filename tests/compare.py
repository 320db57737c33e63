"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = sorted(tuple(_plain(row[i]) for i in order) for row in rows)
    return [names[i] for i in order], out


def compare(df, con, sql):
    """Difference of a DataFrame and a SQL result, or None."""
    cursor = con.execute(sql)
    expected_names, expected = canonical([c[0] for c in cursor.description], cursor.fetchall())
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if names != expected_names:
        return f"columns {names} instead of {expected_names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows instead of {len(expected)}"
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(rows)} rows differ, e.g. {wrong[0]}"
    return None
