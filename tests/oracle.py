"""Compare a Spark frame with DuckDB on the same tables, whatever the order of rows."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sql: str, **frames):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet") and f[:-8] not in frames:
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    for name, frame in frames.items():
        c.register(name, frame)
    return c.execute(sql).df()


def _rows(df):
    cols = sorted(df.columns)
    plain = df[cols].map(lambda v: repr(v.tolist()) if hasattr(v, "tolist") else "nan" if isinstance(v, float) and v != v else repr(v)) if len(df) else df[cols]
    return cols, sorted(map(tuple, plain.to_numpy().tolist()))


def same(spark_df, sql: str, **frames) -> None:
    mine, theirs = _rows(spark_df.toPandas()), _rows(duck(sql, **frames))
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
