"""Compare a query with its SQL over the same tables: columns by name, rows in any order."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def norm(df):
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple("∅" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") else str(v) for v in r))
    return sorted(rows)


def difference(spark, con, f, sql, sf):
    got, want = f(spark, sf).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    for frame in (got, want):
        for c in frame.columns:
            if frame[c].dtype == float and frame[c].dropna().mod(1).eq(0).all() and (got[c].dtype != float or want[c].dtype != float or frame[c].isna().any()):
                frame[c] = frame[c].astype("Int64")
    a, b = norm(got), norm(want)
    if a != b:
        odd = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} rows against {len(b)}; only here {odd[0]}, only there {odd[1]}"
    return None
