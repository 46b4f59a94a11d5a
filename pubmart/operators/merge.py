"""Entity merge that fills NULLs and reports contradictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _value(rows: DataFrame, field: str) -> Column:
    """The field; of fractions, -0.0 is 0.0, as it is for grouping keys."""
    kind = rows.schema[field].dataType
    return F.col(field) + F.lit(0.0).cast(kind) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.col(field)


def merge_entities(rows: DataFrame, key: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """One row per key: each field's only known value, and the fields with more than one.

    Equal copies go first: all fields are grouping keys of one hash aggregation, which needs no sort and
    shrinks a key with very many copies before the shuffle. A key with one row left is settled and passes
    through. Only the rows of other keys, found by a hashed count, are merged value by value: a field
    contradicts itself exactly when its smallest and largest known values differ. Text values make that a
    sorting aggregation, over these rows alone. Values of fixed width need neither the sort nor the joins: the
    smallest and largest of all keys go in one hash aggregation, which also merges equal copies before its
    only shuffle. The outcome does not depend on row order; NULL keys are one key.
    """
    values = [f for f in fields if f not in key]
    rows = rows.select(*fields)
    if not values:
        return rows.distinct().withColumn("conflicts", F.array().cast("array<string>"))
    sides = (("low", F.min), ("high", F.max))
    differing = [F.when(F.col(f"low_{f}") != F.col(f"high_{f}"), F.lit(f)) for f in values]
    columns = [F.col(f) if f in key else F.col(f"high_{f}").alias(f) for f in fields]
    columns.append(F.array_compact(F.array(*differing)).alias("conflicts"))
    if all(isinstance(rows.schema[f].dataType, _FIXED_WIDTH) for f in values):
        bounds = [bound(_value(rows, f)).alias(f"{name}_{f}") for f in values for name, bound in sides]
        return rows.groupBy(*key).agg(*bounds).select(*columns)
    rows = rows.distinct()
    found = rows.groupBy(*key).agg(F.count("*").alias("_rows"))
    contested = found.where("_rows > 1").select(*[F.col(k).alias(f"_{k}") for k in key])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    settled = rows.join(contested, same, "left_anti").withColumn("conflicts", F.array().cast("array<string>"))
    bounds = [bound(f).alias(f"{name}_{f}") for f in values for name, bound in sides]
    merged = rows.join(contested, same, "left_semi").groupBy(*key).agg(*bounds)
    return settled.unionByName(merged.select(*columns))


def conflicting(merged: DataFrame) -> DataFrame:
    return merged.where(F.size("conflicts") > 0)
