"""Run the Spark queries and their SQL twins side by side.

``python -m sensorloom.catalog.crosscheck FOLDER [name ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from sensorloom.catalog import load
from sensorloom.session import build_session


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def kind(sql_type: str) -> str:
    """Types that hold the same values count as one."""
    return {"INTEGER": "BIGINT", "HUGEINT": "not allowed", "FLOAT": "DOUBLE"}.get(sql_type, sql_type)


def compare(df, con, text: str) -> str:
    """Empty when names, types, row count and all values agree; rows are compared as bags."""
    con.register("got_rows", df.toArrow())
    con.execute(f"CREATE OR REPLACE TEMP TABLE want_rows AS {text}")
    shape = [
        sorted((r[0], kind(r[1])) for r in con.execute(f"DESCRIBE {t}").fetchall()) for t in ("got_rows", "want_rows")
    ]
    if shape[0] != shape[1]:
        return f"shape {shape[0]} != {shape[1]}"
    n = [con.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("got_rows", "want_rows")]
    if n[0] != n[1]:
        return f"rows {n[0]} != {n[1]}"
    names = ", ".join(f'"{c}"' for c, _ in shape[0])
    odd = con.execute(f"SELECT {names} FROM got_rows EXCEPT ALL SELECT {names} FROM want_rows").fetchall()
    if odd:
        back = con.execute(f"SELECT {names} FROM want_rows EXCEPT ALL SELECT {names} FROM got_rows").fetchall()
        return f"{len(odd)} of {n[0]} rows differ; columns {names}; first {min(odd, key=str)} != {min(back, key=str)}"
    return ""


def main(argv: list[str]) -> int:
    folder, names = argv[0], argv[1:]
    cat = load()
    spark = build_session(
        "crosscheck", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names or cat.queries:
        start = time.time()
        try:
            df = cat.queries[name](spark, folder)
            if name in cat.sql:
                note = compare(df, con, cat.sql[name])
            else:
                note = f"rows only: {df.count()}"
            ok = not note or note.startswith("rows only")
        except Exception as e:  # noqa: BLE001
            note, ok = f"{type(e).__name__}: {str(e)[:600]}", False
        failed += not ok
        print(f"{'ok ' if ok else 'BAD'} {time.time() - start:6.2f}s {name} {note}", flush=True)
    print(f"{failed} failed of {len(names or cat.queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
