"""Strictly typed reading of VARIANT leaves and the rules their JSON types must meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubmart.functions.text import clean_text, is_country_code

# 20 digits before and 18 after the point: doubles of ordinary size keep all their digits.
DECIMAL = "decimal(38,18)"


def kind(leaf: Column) -> Column:
    """JSON type of a leaf; a missing or null one is VOID."""
    return F.coalesce(F.schema_of_variant(leaf), F.lit("VOID"))


def text(leaf: Column) -> Column:
    return clean_text(F.try_variant_get(leaf, "$", "string"))


def integer(leaf: Column) -> Column:
    return F.try_variant_get(leaf, "$", "bigint")


def decimal(leaf: Column) -> Column:
    return F.try_variant_get(leaf, "$", DECIMAL)


def inexact(leaf: Column) -> Column:
    """A number that ``decimal`` cannot hold: too large, or with digits beyond the last place."""
    held, given = decimal(leaf), F.try_variant_get(leaf, "$", "double")
    return given.isNotNull() & ~held.cast("double").eqNullSafe(given)


def not_text(leaf: Column) -> Column:
    return ~kind(leaf).isin("STRING", "VOID")


def not_integer(leaf: Column) -> Column:
    return ~kind(leaf).isin("BIGINT", "VOID")


def not_number(leaf: Column) -> Column:
    of = kind(leaf)
    return ~(of.isin("BIGINT", "DOUBLE", "FLOAT", "VOID") | of.startswith("DECIMAL"))


def not_flag(leaf: Column) -> Column:
    return ~kind(leaf).isin("BOOLEAN", "VOID")


def not_code(leaf: Column, length: int) -> Column:
    """A required country code is missing or malformed."""
    return not_text(leaf) | ~F.coalesce(is_country_code(text(leaf), length), F.lit(False))


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules a record breaks. They are listed only where one is broken: the test for
    that is compiled, the list is not."""
    names = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    broken = reduce(lambda a, b: a | b, rules.values())
    return F.when(broken, names).otherwise(F.array().cast("array<string>"))
