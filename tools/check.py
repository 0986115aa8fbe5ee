"""Run every registered query against its SQL on one table folder and report differences.

    python tools/check.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from motionlake.plans.catalog import REGISTRY  # noqa: E402
from motionlake.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def ordered(frame):
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns, na_position="last").reset_index(drop=True)


def compare(spark, con, folder: str, name: str) -> str:
    item = REGISTRY[name]
    df = item.run(spark, folder)
    got = df.toPandas()
    if item.sql is None:
        return f"rows only ({len(got)})"
    want = con.execute(item.oracle()).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    for column in got.columns:
        if str(got[column].dtype).startswith(("date", "time")) or str(want[column].dtype).startswith(("date", "time")):
            got[column], want[column] = got[column].astype("datetime64[us]"), want[column].astype("datetime64[us]")
    described = dict(con.execute(f"describe {item.oracle()}").df()[["column_name", "column_type"]].itertuples(index=False))
    notes = [f"{c}: {t}/{described[c]}" for c, t in df.dtypes if TYPES.get(t, t) != described[c]]
    for column in got.columns:
        if got[column].dtype.kind in "iuf" and want[column].dtype.kind in "iuf" and got[column].dtype != want[column].dtype:
            got[column], want[column] = got[column].astype(float), want[column].astype(float)
    a, b = ordered(got), ordered(want)
    if len(a) != len(b):
        return f"DIFFERENT rows {len(a)}/{len(b)}"
    unequal = [c for c in a.columns if not ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all()]
    if unequal:
        column = unequal[0]
        where = ~((a[column] == b[column]) | (a[column].isna() & b[column].isna()))
        return f"DIFFERENT in {unequal}: {where.sum()} rows of {column}\n{a[where].head(2).to_dict('records')}\n{b[where].head(2).to_dict('records')}"
    return f"ok ({len(a)})" + (f" types {notes}" if notes else "")


def main() -> int:
    folder, *parts = sys.argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    bad = 0
    for name in sorted(REGISTRY):
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += verdict.split(" ")[0] not in ("ok", "rows")
        print(f"{name:38s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
