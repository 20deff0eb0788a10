"""Compare registered queries with their SQL twins in DuckDB on one folder of tables."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 5) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, Counter(tuple(plain(row[i]) for i in order) for row in rows)


KIND = {"tinyint": "int", "smallint": "int", "integer": "int", "bigint": "int", "int": "int",
        "double": "double", "float": "float", "varchar": "str", "string": "str",
        "boolean": "bool"}


def check(spark, con, name, spark_query, sql, folder):
    """None when both sides agree, else what differs."""
    df = spark_query(spark, folder)
    left_types = {c: t for c, t in df.dtypes}
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if left[1] is not None else "no rows"
    shape = con.execute(f"describe {sql}").fetchall()
    right_types = {r[0]: str(r[1]).lower() for r in shape}
    result = con.execute(sql).fetchall()
    right = rows_of([r[0] for r in shape], result)
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    for c in left[0]:
        if KIND.get(left_types[c], left_types[c]) != KIND.get(right_types[c], right_types[c]):
            return f"type of {c}: {left_types[c]} against {right_types[c]}"
    if left[1] != right[1]:
        missing, extra = list((right[1] - left[1]).items()), list((left[1] - right[1]).items())
        return (
            f"rows {sum(left[1].values())} against {sum(right[1].values())}; columns {left[0]}; "
            f"only sql {missing[:3]}; only spark {extra[:3]}"
        )
    if not left[1]:
        return "EMPTY on both sides"
    return None


def main() -> int:
    from portmesh import registry
    from portmesh.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    registry.load()
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, f in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, con, name, f, registry.SQL.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        sql = "" if name in registry.SQL else " (rows only)"
        print(f"{mark} {name}{sql} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
