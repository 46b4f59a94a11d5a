"""Rates, growth, labels and date arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubmart.schemas import MISSING_LABEL, NOT_OPEN_LABEL, OPEN_LABEL

# Fractional totals are sums of k/n with whole numbers. They are added up as whole numbers for each n
# first; the whole part of every such sum is kept as a whole number and only its rest, below one, is
# divided, to 19 places. A total is then off by at most half of 1e-19 for each different n, whatever
# the number of rows and their order: ties stay ties. What is shown is rounded to 9 places.
WEIGHT_DIGITS = 9
FRACTION = "decimal(38,18)"


def members_of(weight: Column) -> Column:
    """n of a weight 1/n: exact, as both are doubles, for every n below 2**50."""
    return F.round(1 / weight).cast("bigint")


def sum_of_fractions(numerator: Column, denominator: Column) -> Column:
    """Sum of numerator/denominator over rows of whole numbers, as a decimal."""
    # 19 digits for a long, 18 places and one for the carry: nothing is cut from the sum
    whole = F.sum(F.call_function("div", numerator, denominator)).cast("decimal(19,0)")
    rest = (numerator % denominator).cast("decimal(18,0)") / denominator.cast("decimal(18,0)")
    return whole + F.sum(rest).cast("decimal(37,18)")


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast(FRACTION))


def stable(total: Column) -> Column:
    return F.round(total, WEIGHT_DIGITS).cast("double")


def rate(numerator: Column, denominator: Column, scale: float) -> Column:
    """scale * numerator / denominator; NULL for a missing or zero denominator."""
    below = F.nullif(denominator.cast("double"), F.lit(0.0))
    return numerator.cast("double") * F.lit(float(scale)) / below


def per_million(output: Column, population: Column) -> Column:
    return rate(output, population, 1e6)


def per_billion(output: Column, gdp: Column) -> Column:
    return rate(output, gdp, 1e9)


def growth_pct(current: Column, previous: Column) -> Column:
    return rate(current - previous, previous, 100)


def labelled(*candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit(MISSING_LABEL))


def open_access_label(flag: Column) -> Column:
    return (
        F.when(flag, F.lit(OPEN_LABEL))
        .when(~flag, F.lit(NOT_OPEN_LABEL))
        .otherwise(F.lit(MISSING_LABEL))
    )


def date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


# date_key is YYYYMMDD by contract, so a date's parts need no join with dim_date.
def year_of(key: Column) -> Column:
    return F.floor(key / 10000).cast("int")


def month_of(key: Column) -> Column:
    return (F.floor(key / 100) % 100).cast("int")


def quarter_of(key: Column) -> Column:
    return F.ceil(month_of(key) / 3).cast("int")


def date_of(key: Column) -> Column:
    return F.make_date(year_of(key), month_of(key), (key % 100).cast("int"))
