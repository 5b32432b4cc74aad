"""Spark results against DuckDB's, without regard to order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).df()


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else bool(v) if isinstance(v, bool) else str(v)
    return sorted((tuple(cell(getattr(v, "item", lambda v=v: v)()) for v in row) for row in df.itertuples(index=False)), key=repr)


def same(spark_df, sql: str, sf: str) -> None:
    got, want = spark_df.toPandas(), duck(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
