"""Run registered queries against their SQL twins: `python tests/compare.py [sf] [names...]`."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, text):
    """None when equal, else what differs."""
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    want_columns, want = rows_of(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    return None, len(got), kinds


def main():
    from flowlattice.plans import catalog
    from flowlattice.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in catalog.ORACLES:
                result = compare(fn(spark, folder), con, catalog.ORACLES[name])
            else:
                result = (None, fn(spark, folder).count(), "no sql")
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        ok = isinstance(result, tuple)
        bad += not ok
        note = f"{result[1]} rows" + (" (rows only)" if ok and result[2] == "no sql" else "") if ok else result
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
