"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's check: row count, column names/types and an
order-insensitive comparison of the values (columns sorted by name).
Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_CANON = {"IntegerType": "int32", "LongType": "int64", "DoubleType": "float64",
                  "FloatType": "float32", "StringType": "string", "DateType": "date",
                  "BooleanType": "bool", "ShortType": "int16", "TimestampType": "timestamp"}
DUCK_TO_CANON = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "FLOAT": "float32",
                 "VARCHAR": "string", "DATE": "date", "BOOLEAN": "bool", "SMALLINT": "int16",
                 "TIMESTAMP": "timestamp"}


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(round(v, 9) + 0.0))
    return (1, str(v))


def compare(spark_df, con, sql):
    s_types = {f.name: SPARK_TO_CANON.get(type(f.dataType).__name__, str(f.dataType))
               for f in spark_df.schema.fields}
    rel = con.sql(sql)
    d_types = {n: DUCK_TO_CANON.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    problems = []
    if sorted(s_types) != sorted(d_types):
        return [f"columns differ: spark={sorted(s_types)} duck={sorted(d_types)}"]
    for c in s_types:
        if s_types[c] != d_types[c]:
            problems.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    cols = sorted(s_types)
    s_rows = spark_df.select(*cols).collect()
    d_rows = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    if len(s_rows) != len(d_rows):
        problems.append(f"rows: spark={len(s_rows)} duck={len(d_rows)}")
    s_set = sorted(tuple(_norm(v) for v in r) for r in s_rows)
    d_set = sorted(tuple(_norm(v) for v in r) for r in d_rows)
    if s_set != d_set:
        diff_s = [r for r in s_set if r not in set(d_set)][:3]
        diff_d = [r for r in d_set if r not in set(s_set)][:3]
        problems.append(f"values differ: spark-only={diff_s} duck-only={diff_d}")
    return problems


def main(argv):
    sys.path.insert(0, ".")
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from gridfold.session import get_session
    import __spark_entry__ as entry
    if os.environ.get("PLAIN_SESSION"):
        # the driver's own session: none of our defaults, other time zone
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]")
                 .config("spark.sql.session.timeZone", os.environ["PLAIN_SESSION"])
                 .getOrCreate())
    else:
        spark = get_session("local[8]", shuffle_partitions=8)
    qs, oracles = entry.queries(), entry.oracle_sql()
    con = duck_con(sf)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            if name in oracles:
                probs = compare(df, con, oracles[name])
            else:
                n = df.count()
                probs = [] if n >= 0 else ["no rows"]
                name += " (rows only)"
        except Exception as e:  # noqa: BLE001
            probs = [f"error: {type(e).__name__}: {str(e)[:600]}"]
        dt = time.time() - t0
        status = "OK " if not probs else "BAD"
        bad += bool(probs)
        print(f"{status} {name:34s} {dt:6.2f}s {' | '.join(probs)}", flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
