"""Run registered queries in Spark and DuckDB and compare them: columns, types, rows and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(df, con, statement: str) -> tuple[bool, str]:
    got_cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in got_cols) for r in df.collect())
    cur = con.execute(statement)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    if got_cols != cols:
        return False, f"columns {got_cols} vs {cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; only spark {[r for r in got if r not in set(want)][:2]}; only sql {[r for r in want if r not in set(got)][:2]}"
    if got != want:
        only, other = set(got) - set(want), set(want) - set(got)
        return False, f"{cols}: {len(only)} of {len(got)} rows differ\n   spark {sorted(only)[:3]}\n   sql   {sorted(other)[:3]}"
    return True, f"{len(got)} rows"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").appName("curbwatch").config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
            .config("spark.driver.extraJavaOptions", "-Xss16m").config("spark.log.level", "ERROR").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())


def main(folder: str, only: list[str]) -> None:
    import __spark_entry__ as entry
    spark = session()
    con = connect(folder)
    plans, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in plans.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            df = plan(spark, folder)
            if name in oracle:
                ok, note = compare(df, con, oracle[name])
            else:
                ok, note = True, f"{df.count()} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
