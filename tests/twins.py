"""Compare registered queries with their SQL twins, row by row.

Run as a script: python tests/twins.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 6) + 0.0)
    if isinstance(value, bool):
        return value
    return value


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when the results agree, otherwise what differs."""
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected_types = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} against {sorted(expected_columns)}"
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    for name, kind in expected_types.items():
        if (kind in ("DOUBLE", "FLOAT")) != (name in floats) or kind in ("HUGEINT",) or kind.startswith("DECIMAL"):
            return f"column {name}: {dict(df.dtypes)[name]} against {kind}"
    order = sorted(expected_columns)
    at = [expected_columns.index(c) for c in order]
    expected = Counter(tuple(_cell(row[i]) for i in at) for row in cursor.fetchall())
    found = Counter(tuple(_cell(row[c]) for c in order) for row in df.collect())
    if expected == found:
        return None
    only_found, only_expected = list((found - expected).elements()), list((expected - found).elements())
    return (
        f"{sum(found.values())} rows against {sum(expected.values())}; "
        f"{len(only_found)} only here, e.g. {str(only_found[:2])[:500]}; "
        f"{len(only_expected)} only in SQL, e.g. {str(only_expected[:2])[:500]}"
    )


def main(argv: list[str]) -> int:
    from wardlens.plans.catalog import QUERIES, TWINS
    from wardlens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark: SparkSession = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in TWINS:
                problem = compare(df, con, TWINS[name])
                n = con.execute(f"select count(*) from ({TWINS[name]})").fetchone()[0] if not problem else "?"
            else:
                n, problem = len(df.collect()), None
        except Exception as error:  # noqa: BLE001 - report and go on
            n, problem = "?", f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if not problem else 'BAD'} {time.time() - start:6.2f}s {name} rows={n} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    raise SystemExit(main(sys.argv[1:]))
