"""Compares a query with its SQL on the test tables."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def same(spark, con, query, sql):
    mine = query(spark, str(DATA))
    got = rows_of(mine.columns, [tuple(r) for r in mine.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(mine.columns)
    assert got == rows_of(names, found.fetchall())
