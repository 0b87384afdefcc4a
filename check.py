"""Runs registered queries and their SQL side by side.  Usage: check.py [sf folder] [name part …]"""

from __future__ import annotations

import math
import sys
import time

import duckdb


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(canonical(r[i]) for i in order) for r in rows)
    return sorted(columns), lines


def main() -> int:
    from pyspark.sql import SparkSession  # noqa: F401
    from codestrata.queries import load_all
    from codestrata.queries.views import BASE
    from codestrata.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for table in BASE:
        duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    bad = 0
    for name, q in load_all().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            cols, lines = digest(df.columns, rows)
            note = f"{len(rows)} rows"
            if q.sql:
                rel = duck.execute(q.sql)
                names = [d[0] for d in rel.description]
                dcols, dlines = digest(names, rel.fetchall())
                t2 = time.time()
                same = cols == dcols and lines == dlines
                note += f" duck {t2 - t1:.1f}s"
                if not same:
                    bad += 1
                    extra = [x for x in lines if x not in set(dlines)][:2]
                    missing = [x for x in dlines if x not in set(lines)][:2]
                    note += f" MISMATCH {len(dlines)} {cols} {dcols}\n  spark only: {[e[:300] for e in extra]}\n  duck only: {[e[:300] for e in missing]}"
            else:
                note += " (rows only)"
            if not rows:
                note += " EMPTY"
            print(f"{name}: {t1 - t0:.1f}s {note}", flush=True)
        except Exception as error:  # report and go on
            bad += 1
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:700]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
