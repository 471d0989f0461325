"""A query's rows against its SQL in DuckDB."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def plain(frame, columns):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return round(float(v), 6) + 0.0
        return str(v)

    return sorted(([one(v) for v in row] for row in frame[columns].astype(object).to_numpy().tolist()), key=str)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def same(spark, run, sql, sf):
    got, want = run(spark, f"{DATA}/{sf}").toPandas(), duck(sf).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)
    return len(got)
