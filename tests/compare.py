"""Run registered queries against their SQL: ``python tests/compare.py [--sf DIR] [NAME...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    import datetime
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)) or type(v).__name__ in ("ndarray", "Row"):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> list[str]:
    got, result = df.collect(), con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = rows(df.columns, got), rows(names, want)
    out = [] if len(a) == len(b) else [f"{len(a)} rows and {len(b)}"]
    sa, sb = set(map(repr, a)), set(map(repr, b))
    if sa != sb:
        out += [f"only Spark: {x}" for x in sorted(sa - sb)[:3]] + [f"only SQL:   {x}" for x in sorted(sb - sa)[:3]]
    return out


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("massq").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str]) -> int:
    import __spark_entry__ as e

    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--sf"]
    spark, con, q, s, bad = session(), oracle(sf), e.queries(), e.oracle_sql(), 0
    for name in names or q:
        t = time.time()
        try:
            found = differences(q[name](spark, sf), con, s[name]) if name in s else [] if q[name](spark, sf).count() >= 0 else []
        except Exception as x:  # noqa: BLE001  a report goes on
            found = [f"{type(x).__name__}: {str(x)[:900]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok' if name in s else 'ran'} {name} {time.time() - t:.1f}s", *found, sep="\n     ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
