"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    return repr(v)


def digest(pdf: pd.DataFrame) -> str:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        spdf = sdf.toPandas()
        rec = {"rows": len(spdf), "sec": round(time.time() - t0, 2)}
        if name in sqls:
            opdf = con.execute(sqls[name]).df()
            rec["oracle_rows"] = len(opdf)
            rec["cols_match"] = sorted(spdf.columns) == sorted(opdf.columns)
            rec["match"] = rec["cols_match"] and len(spdf) == len(opdf) and digest(spdf) == digest(opdf)
            if not rec["match"] and verbose:
                rec["spark_cols"] = list(spdf.columns)
                rec["oracle_cols"] = list(opdf.columns)
        results[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from meterspark.config import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]")
    res = compare(spark, sf, names)
    bad = [n for n, r in res.items() if "match" in r and not r["match"]]
    print("MISMATCH:", bad)
