"""Run every query next to its SQL and compare names, row counts and values.

    python tools/check_queries.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from panelloom.catalogue import ORACLES, QUERIES  # noqa: E402
from panelloom.session import local_session  # noqa: E402

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((c is None, str(type(c)), c if c is not None else 0) for c in r))


def compare(spark, con, sf, name) -> str:
    df = QUERIES[name](spark, sf)
    ours = df.collect()
    if name not in ORACLES:
        return f"rows only: {len(ours)}"
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"DIFF columns {sorted(df.columns)} {sorted(names)}"
    if len(ours) != len(theirs):
        return f"DIFF rows {len(ours)} {len(theirs)}"
    a, b = _sorted_rows(df.columns, ours), _sorted_rows(names, theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    types = dict(df.dtypes)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    odd = {n: (types[n], kinds[n]) for n in names if _kind(types[n]) != _kind(kinds[n])}
    note = f" types {odd}" if odd else ""
    if bad:
        return f"DIFF {len(bad)} of {len(a)} values, first {bad[0]}{note}"
    return f"ok {len(a)}{note}"


def _kind(text: str) -> str:
    text = text.lower()
    kinds = {"double": "float", "varchar": "string", "integer": "int"}
    return kinds.get(text, "float" if text in ("double", "float") or text.startswith("decimal") else text)


def main(argv) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            result = compare(spark, con, sf, name)
        except Exception as error:  # noqa: BLE001
            result = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        failed += result.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
