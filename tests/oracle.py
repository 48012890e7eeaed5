"""Side-by-side comparison of a query and its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if value != value else int(value) if value.is_integer() else value
    return list(value) if hasattr(value, "tolist") else value


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return columns, sorted(repr(tuple(plain(v) for v in row)) for row in frame.where(frame.notna(), None).itertuples(index=False))


def same(spark_frame, con, sql):
    mine, theirs = rows(spark_frame.toPandas()), rows(con.sql(sql).df())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
