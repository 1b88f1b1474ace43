"""Compare every registered query with its checking SQL.

Usage: python tests/check_queries.py [folder] [name ...]
"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from faultline.session import drop_staged  # noqa: E402
from tests.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def kind(series_type) -> str:
    text = str(series_type).lower()
    for group, words in {
        "float": ("double", "float"), "time": ("timestamp",), "text": ("string", "varchar", "utf8"),
        "bool": ("bool",), "decimal": ("decimal",),
    }.items():
        if any(word in text for word in words):
            return group
    return text


def rows_of(table) -> list[str]:
    names = sorted(table.column_names)
    frame = table.select(names).to_pandas(timestamp_as_object=True, types_mapper=pd.ArrowDtype)
    result = []
    for row in frame.itertuples(index=False, name=None):
        cells = []
        for value in row:
            if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
                cells.append("~")
            elif isinstance(value, float):
                cells.append(f"{value + 0.0:.6f}")
            else:
                cells.append(str(value))
        result.append("|".join(cells))
    return sorted(result)


def compare(spark, connection, folder, name, run, sql) -> str:
    start = time.time()
    df = run(spark, folder)
    got = df.toArrow()
    took = time.time() - start
    drop_staged(spark)
    if sql is None:
        return f"rows-only {got.num_rows} rows {took:.1f}s" if got.num_rows else "EMPTY"
    start = time.time()
    want = connection.sql(sql).to_arrow_table()
    slow = time.time() - start
    if sorted(got.column_names) != sorted(want.column_names):
        return f"FAIL columns {sorted(got.column_names)} {sorted(want.column_names)}"
    types = {
        n: (str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in got.column_names
        if kind(got.schema.field(n).type) != kind(want.schema.field(n).type)
    }
    a, b = rows_of(got), rows_of(want)
    if types:
        return f"FAIL types {types}"
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"FAIL {len(a)} and {len(b)} rows; only here {extra}; only there {missing}"
    note = " EMPTY" if not a else ""
    return f"ok {len(a)} rows {took:.1f}s sql {slow:.1f}s{note}"


def main() -> int:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, connection = local_session(), database(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if chosen and name not in chosen:
            continue
        try:
            result = compare(spark, connection, folder, name, run, oracles.get(name))
        except Exception as error:
            text = str(error).split("JVM stacktrace")[0]
            result = "ERROR " + (text if len(text) < 900 else text[:450] + " ... " + text[-450:])
            if "-v" in chosen:
                traceback.print_exc()
        failed += not result.startswith(("ok", "rows-only"))
        print(f"{name}: {result}", flush=True)
    print(f"{failed} failed of {len(chosen) or len(queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
