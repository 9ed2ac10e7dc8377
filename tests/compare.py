"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import math

import pandas as pd


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return str(round(x, 6)) if x != int(x) or abs(x) > 1e15 else str(int(x))
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted((tuple(map(_plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


def assert_same(spark_df, duck_rel) -> None:
    a, b = spark_df.toPandas(), duck_rel.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
