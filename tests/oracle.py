"""Compare a query's rows with its DuckDB SQL's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    told = lambda v: "" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) and v % 1 else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(told(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def holds(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(sql).df(), query(spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)
