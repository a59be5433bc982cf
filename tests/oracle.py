"""Rows of a query against the rows of its DuckDB statement."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def shown(v):
    return "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def compare(df, connection, sql):
    columns = sorted(df.columns)
    own = sorted("|".join(shown(r[c]) for c in columns) for r in df.collect())
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted("|".join(shown(r[i]) for i in at) for r in found.fetchall())
    return own
