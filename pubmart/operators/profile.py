"""Completeness and range profile of the country-year panel. Nothing is repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.operators import checks as C
from pubmart.schemas import MEASURES, YEARS

KEY = ("country_code_iso3", "year")

# The range each measure must lie in when present.
RANGES = {
    "population": (0, False, None),
    "gdp_current_usd": (0, True, None),
    "gdp_per_capita_current_usd": (0, True, None),
    "internet_users_pct": (0, True, 100),
    "rd_expenditure_pct_gdp": (0, True, 100),
}


def long_form(panel: DataFrame, fields: tuple[str, ...] = MEASURES) -> DataFrame:
    """One row per country, year and measure."""
    doubles = panel.select(*KEY, *[F.col(f).cast("double").alias(f) for f in fields])
    return doubles.unpivot(list(KEY), list(fields), "field", "value")


def completeness(panel: DataFrame, fields: tuple[str, ...] = MEASURES) -> DataFrame:
    """Present and missing values per measure, over all years (NULL year) and per year."""
    counts = (
        long_form(panel, fields)
        .groupingSets([[F.col("field")], [F.col("field"), F.col("year")]], F.col("field"), F.col("year"))
        .agg(F.count("value").alias("present"), F.count("*").alias("rows"))
    )
    missing = F.col("rows") - F.col("present")
    share = F.round(F.col("present") * 100.0 / F.col("rows"), 4)
    return counts.select(
        "field",
        "year",
        "present",
        missing.alias("missing"),
        share.alias("coverage_pct"),
        F.round(missing * 100.0 / F.col("rows"), 4).alias("missing_pct"),
    )


def countries_without_values(panel: DataFrame, fields: tuple[str, ...] = MEASURES) -> DataFrame:
    per_country = long_form(panel, fields).groupBy("field", "country_code_iso3")
    return per_country.agg(F.count("value").alias("present")).where("present = 0").drop("present")


def country_coverage(panel: DataFrame, field: str) -> DataFrame:
    """How many countries have at least one value of a measure, and how many none."""
    per_country = panel.groupBy("country_code_iso3").agg(F.count(field).alias("present"))
    return per_country.agg(
        F.count_if(F.col("present") > 0).alias("countries_with_a_value"),
        F.count_if(F.col("present") == 0).alias("countries_without_a_value"),
    )


def all_null_rows(panel: DataFrame, fields: tuple[str, ...] = MEASURES) -> DataFrame:
    return panel.where(reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields])).select(*KEY)


def _outside(field: Column, value: Column, ranges: dict) -> Column:
    def rule(low, low_allowed, high) -> Column:
        below = value < low if low_allowed else value <= low
        return below if high is None else below | (value > high)

    return reduce(
        lambda a, b: a | b, [(field == name) & rule(*bounds) for name, bounds in ranges.items()]
    )


def out_of_range(panel: DataFrame, ranges: dict = RANGES) -> DataFrame:
    """Values outside the range of their measure, flagged and left as they are."""
    cells = long_form(panel, tuple(ranges)).where(F.col("value").isNotNull())
    return cells.where(_outside(F.col("field"), F.col("value"), ranges))


def rows_by_year(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year").agg(F.count("*").alias("rows"))


def duplicate_rows(panel: DataFrame) -> DataFrame:
    """Rows beyond the first of each country and year."""
    keys = panel.groupBy(*KEY).agg(F.count("*").alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return keys.agg(extra.alias("duplicate_rows"))


def panel_checks(panel: DataFrame, countries: DataFrame, years=YEARS) -> DataFrame:
    """Structural gates of the finished panel."""
    expected = countries.select("country_code_iso3").distinct().select(
        "country_code_iso3", F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year")
    )
    keys = panel.select(*KEY)
    known = countries.select("country_code_iso3")
    return C.all_checks(
        [
            C.not_empty(panel, "panel"),
            C.not_empty(countries, "countries"),
            C.duplicate_keys(panel, "panel", KEY),
            C.holds(panel, "year set", "panel", F.col("year").isin(list(years))),
            C.holds(panel, "iso3 present", "panel", F.coalesce(F.col("country_code_iso3") != "", F.lit(False))),
            C.holds(keys.join(known, "country_code_iso3", "left_anti"), "known country", "panel", F.lit(False)),
            C.holds(expected.join(keys, list(KEY), "left_anti"), "complete grid", "panel", F.lit(False)),
        ]
    )


def quality_lists(panel: DataFrame) -> dict[str, DataFrame]:
    """The cells, rows and countries behind the document's counts, each list complete."""
    return {
        "out_of_range": out_of_range(panel),
        "all_null_rows": all_null_rows(panel),
        "countries_without_values": countries_without_values(panel),
    }


def quality_document(panel: DataFrame, countries: DataFrame, years=YEARS) -> DataFrame:
    """Profile of the panel as one row. Its lists have one entry per measure and year; those of
    single cells, rows and countries are ``quality_lists``."""
    per_field = completeness(panel)
    overall = per_field.where(F.col("year").isNull()).drop("year")
    by_year = per_field.where(F.col("year").isNotNull())

    def as_list(rows: DataFrame, *order: str) -> Column:
        entry = F.struct(*order, *[c for c in rows.columns if c not in order])
        return rows.agg(F.sort_array(F.collect_list(entry)).alias("entries")).scalar()

    flagged = out_of_range(panel).groupBy("field").agg(F.count("*").alias("values"))
    without = countries_without_values(panel).groupBy("field").agg(F.count("*").alias("countries"))
    totals = panel.agg(F.count("*").alias("row_count"))
    country_count = countries.agg(F.count_distinct("country_code_iso3").alias("n")).scalar()
    return totals.select(
        F.lit("one country x one year").alias("grain"),
        F.lit(min(years)).alias("start_year"),
        F.lit(max(years)).alias("end_year"),
        country_count.alias("country_count"),
        "row_count",
        (country_count * len(tuple(years))).alias("expected_rows"),
        as_list(rows_by_year(panel), "year").alias("rows_by_year"),
        duplicate_rows(panel).scalar().alias("duplicate_rows"),
        as_list(overall, "field").alias("coverage"),
        as_list(by_year, "field", "year").alias("coverage_by_year"),
        as_list(without, "field").alias("countries_without_values"),
        all_null_rows(panel).agg(F.count("*").alias("n")).scalar().alias("all_null_rows"),
        as_list(flagged, "field").alias("out_of_range"),
        F.lit(True).alias("no_missing_values_imputed"),
    )
