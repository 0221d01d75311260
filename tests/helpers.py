"""Compare a query's rows with its SQL's."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        return None if x is None or x is pd.NA or x != x else x

    rows = [tuple(plain(x) for x in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
