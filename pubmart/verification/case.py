"""A registered query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmart.operators.reshape import as_integers

DIGITS = 6


def comparable(frame: DataFrame) -> DataFrame:
    """Plain column types: 64-bit integers, rounded doubles, dates and flags as text."""
    frame = as_integers(frame)
    casts = {}
    for field in frame.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            casts[field.name] = F.round(column.cast("double"), DIGITS)
        elif isinstance(field.dataType, (T.DateType, T.BooleanType)):
            casts[field.name] = column.cast("string")
    return frame.withColumns(casts) if casts else frame


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(
        self, name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None
    ) -> None:
        if name in self.queries:
            raise ValueError(f"Query registered twice: {name}")
        self.queries[name] = lambda spark, sf_dir: comparable(build(spark, sf_dir))
        if sql is not None:
            self.oracles[name] = sql.strip()
