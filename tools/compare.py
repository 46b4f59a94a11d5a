"""Run registered queries against DuckDB: python tools/compare.py [sf] [name-part ...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pubmart.session import build_session  # noqa: E402
from pubmart.verification import build_registry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, connection, registry, name: str, sf_dir: str) -> tuple[str, int]:
    frame = registry.queries[name](spark, sf_dir)
    rows = frame.collect()
    if name not in registry.oracles:
        return "rows only", len(rows)
    result = connection.sql(registry.oracles[name])
    expected = result.fetchall()
    if sorted(frame.columns) != sorted(result.columns):
        return f"columns {sorted(frame.columns)} != {sorted(result.columns)}", len(rows)
    mine, theirs = bag(frame.columns, rows), bag(result.columns, expected)
    if mine == theirs:
        kinds = {field.name: field.dataType.simpleString() for field in frame.schema}
        wide = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
        wrong = [
            f"{column}: {kinds[column]} / {kind}"
            for column, kind in zip(result.columns, map(str, result.types))
            if wide.get(kinds[column]) != kind
        ]
        return ("ok" if not wrong else f"ok, types differ {wrong}"), len(rows)
    return f"only here {list((mine - theirs).items())[:3]} only in SQL {list((theirs - mine).items())[:3]}", len(rows)


def main() -> int:
    sf, parts = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry, connection, bad, ran = build_registry(), connect(sf_dir), 0, 0
    for name in registry.queries:
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        try:
            verdict, rows = difference(spark, connection, registry, name, sf_dir)
        except Exception as error:  # report every query, not only the first failure
            verdict, rows = f"ERROR {str(error)[:600]}", -1
        good = verdict in ("ok", "rows only")
        bad += not good
        ran += 1
        print(f"{'  ' if good else '!!'} {name:45s} rows={rows:7d} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} of {ran} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
