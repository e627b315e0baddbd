"""Runs registered queries beside their SQL in DuckDB and compares whole results.

Usage: python tests/compare.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = Path("/root/testdata")


def make_spark(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("treeledger")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: Path):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([canonical(r[i]) for i in order]) for r in rows))


def compare(spark, con, sf_dir, name, fn, sql):
    """Returns (matches, message)."""
    t0 = time.time()
    df = fn(spark, str(sf_dir))
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows {t1 - t0:.2f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
    family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if t in family and family[t] != kinds[c]]
    note = f"{len(a)} rows spark {t1 - t0:.2f}s duckdb {t2 - t1:.2f}s" + (f" TYPES {odd}" if odd else "")
    if a == b:
        return True, note
    from collections import Counter
    ca, cb = Counter(a), Counter(b)
    extra, missing = list((ca - cb).elements()), list((cb - ca).elements())
    return False, (f"{note} vs {len(b)}\n  cols {sorted(cols)}\n  spark only ({len(extra)}): {[e[:400] for e in extra[:3]]}"
                   f"\n  sql only ({len(missing)}): {[e[:400] for e in missing[:3]]}")


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    spark, sf_dir = make_spark(), DATA / args.sf
    con = duck(sf_dir)
    queries, checks, bad = entry.queries(), entry.oracle_sql(), []
    for name in args.names or queries:
        try:
            ok, message = compare(spark, con, sf_dir, name, queries[name], checks.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on to the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
