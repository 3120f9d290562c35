"""Runs SQL in DuckDB on the test tables and compares it with a DataFrame."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def rows_of(df):
    columns = sorted(df.columns)
    table = df.toArrow()
    return columns, sorted(map(repr, zip(*[[_plain(x) for x in table[c].to_pylist()] for c in columns], strict=True)))


def rows_of_sql(sql, folder):
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted(repr(tuple(_plain(r[i]) for i in order)) for r in result.fetchall())


def assert_same(df, sql, folder):
    columns, own = rows_of(df)
    names, other = rows_of_sql(sql, folder)
    assert columns == names
    assert own == other
