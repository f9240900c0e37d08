"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [key ...]
Compares row count, column names and an order-insensitive hash of the values.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proselens.plans import registry  # noqa: E402
from proselens.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _cell(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([round(float(a), 6) if isinstance(a, float) else a for a in list(v)])
    return v


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
        elif df[c].dtype == object:
            df[c] = df[c].map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = registry.queries(), registry.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        t0 = time.time()
        s = qs[k](spark, sf_dir).toPandas()
        t1 = time.time()
        if k not in sqls:
            print(f"{k}: spark rows={len(s)} ({t1 - t0:.1f}s) no oracle", flush=True)
            continue
        o = con.execute(sqls[k]).df()
        t2 = time.time()
        msg = []
        if len(s) != len(o):
            msg.append(f"rows {len(s)} vs {len(o)}")
        if sorted(s.columns) != sorted(o.columns):
            msg.append(f"cols {sorted(set(s.columns) ^ set(o.columns))}")
        else:
            a, b = canon(s), canon(o)
            for c in a.columns:
                if len(a) == len(b) and not a[c].astype(str).equals(b[c].astype(str)):
                    diff = (a[c].astype(str) != b[c].astype(str)).sum()
                    msg.append(f"{c}: {diff} diffs e.g. {a[c][a[c].astype(str) != b[c].astype(str)].head(2).tolist()} vs "
                               f"{b[c][a[c].astype(str) != b[c].astype(str)].head(2).tolist()}")
        bad += bool(msg)
        print(f"{k}: {'OK' if not msg else 'MISMATCH ' + '; '.join(msg)} "
              f"rows={len(s)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
