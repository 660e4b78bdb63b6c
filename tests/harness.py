"""Run registered queries on Spark and their SQL twins on the second engine and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n",
                                            round(x, 3) if isinstance(x, float) else x) if x is not None else (True,)
                                           for x in r))


def compare(spark, con, name, fn, sql, path) -> tuple[bool, str]:
    df = fn(spark, path)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want_cols = list(rel.columns)
    want = rows_of(want_cols, rel.fetchall())
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return False, f"rows {len(got)} vs {len(want)}; only spark {list(a - b)[:3]} only sql {list(b - a)[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} differ ({sorted(want_cols)}): {bad[:3]}"
    return True, f"{len(got)} rows"


def main(path: str, names: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    from labelloom.plans import registry
    from labelloom.session import build_session

    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    con = connect(path)
    failed = 0
    for name, fn in registry.QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in registry.ORACLES:
                ok, note = compare(spark, con, name, fn, registry.ORACLES[name], path)
            else:
                ok, note = True, f"{fn(spark, path).count()} rows, no twin"
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
