"""Runs a query and its SQL, and compares their rows without order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(rows, columns):
    def value(x):
        if isinstance(x, float):
            return round(x, 9)
        return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def assert_same(frame, relation):
    found = canonical([tuple(r) for r in frame.collect()], frame.columns)
    wanted = canonical(relation.fetchall(), relation.columns)
    assert found == wanted
