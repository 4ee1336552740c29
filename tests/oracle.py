"""Compare registered queries with their SQL on the driver's tables.

``python -m tests.oracle [name ...]`` prints one line per query.
"""

import math
import os
import sys
import time
import traceback

import duckdb

from tablemill.session import cleared

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def database(folder=FOLDER):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "float": "FLOAT", "tinyint": "TINYINT", "smallint": "SMALLINT",
}


def compare(spark, connection, name, function, sql, folder=FOLDER):
    """None when both agree, otherwise what differs."""
    df = function(spark, folder)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return None if mine else "no rows"
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {c[0]: c[1] for c in connection.execute(f"describe {sql}").fetchall()}
    types = [
        f"{f.name}: {f.dataType.simpleString()} / {kinds[f.name]}"
        for f in df.schema
        if KINDS.get(f.dataType.simpleString()) not in (None, kinds[f.name])
    ]
    if types:
        return "types " + ", ".join(types)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{str(a)[:300]} != {str(b)[:300]}"
    return None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(names):
    import __spark_entry__ as entry

    spark, connection = session(), database()
    sqls, bad = entry.oracle_sql(), []
    chosen = {n: f for n, f in entry.queries().items() if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)}
    for name, function in chosen.items():
        started = time.time()
        try:
            with cleared(spark):
                problem = compare(spark, connection, name, function, sqls.get(name))
        except Exception:
            problem = "".join(traceback.format_exc()[-1500:])
        if problem:
            bad.append(name)
        print(f"{'ok ' if not problem else 'BAD'} {time.time() - started:6.2f}s {name}{'' if sqls.get(name) else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} agree; bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
