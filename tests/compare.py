"""Holds a query against its SQL in DuckDB: same columns, same rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame):
    def norm(v):
        if v is None or pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return v + 0.0 if isinstance(v, float) else v

    cols = sorted(frame.columns)
    whole = [c for c in cols if pd.api.types.is_float_dtype(frame[c]) and (frame[c].dropna() % 1 == 0).all()]
    frame = frame.assign(**{c: frame[c].astype("Float64") for c in whole})
    return cols, sorted((tuple(float(x) if isinstance(x := norm(v), (int, float)) and not isinstance(x, bool) else x for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


def differences(spark_frame, sql_frame) -> str:
    (a, x), (b, y) = rows(spark_frame), rows(sql_frame)
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
