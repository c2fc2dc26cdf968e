"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import glob
import math
import os

import duckdb


def open_tables(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def differences(df, con, sql):
    """None when equal, else a short account of the first differences."""
    result = con.execute(sql)
    want_names, want = _rows([d[0] for d in result.description], result.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(v) for v in g] != [type(v) for v in w]]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
