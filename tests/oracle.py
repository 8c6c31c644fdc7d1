"""Run registered queries against their SQL twins on the parquet tables.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    names, rows = _rows(columns, result.fetchall())
    return names, rows, dict(zip(columns, types))


def difference(df, con, sql: str) -> str | None:
    """None when both sides give the same rows, else what differs first."""
    names, rows = spark_rows(df)
    other_names, other_rows, _ = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(rows) != len(other_rows):
        return f"rows {len(rows)} != {len(other_rows)}; e.g. {sorted(set(rows) ^ set(other_rows), key=repr)[:3]}"
    for a, b in zip(rows, other_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = sum(x != y for x, y in zip(rows, other_rows))
            return f"{bad} rows differ: {a} != {b}"
    return None


def main() -> int:
    import __spark_entry__ as e
    from assaykit.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls, bad = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problem = difference(df, con, sqls[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as ex:  # report and go on with the next query
            problem = f"{type(ex).__name__}: {str(ex)[:600]}"
        if problem:
            bad.append(name)
        note = "ok" if not problem else f"DIFFERS {problem}"
        print(f"{name:32s} {time.time() - start:6.2f}s {'' if name in sqls else '(rows only) '}{note}", flush=True)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
