"""Compares a query's rows with DuckDB's, without order."""

import pathlib

import duckdb


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def plain(frame):
        return sorted(map(repr, frame[columns].astype(str).itertuples(index=False, name=None)))

    assert plain(left) == plain(right)
