"""Grids, calendar spines and long-to-wide reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pubmart.schemas import INDICATORS, YEARS

GRAINS = {"Year": ("year", 12), "Quarter": ("quarter", 3), "Month": ("month", 1)}


def _grain(grain: str) -> tuple[str, int]:
    if grain not in GRAINS:
        raise ValueError(f"{grain} is not a period; choose Year, Quarter or Month")
    return GRAINS[grain]


def period_of(day: Column, grain: str) -> Column:
    """First day of the year, quarter or month."""
    return F.trunc(day, _grain(grain)[0])


def _steps(first: Column, last: Column, months: int) -> Column:
    return F.explode(F.sequence(first, last, F.make_ym_interval(F.lit(0), F.lit(months))))


def calendar_spine(rows: DataFrame, day: str, grain: str) -> DataFrame:
    """Every period from the first to the last date; no rows when there is no date."""
    _, months = _grain(grain)
    bounds = rows.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    first, last = period_of(F.col("first"), grain), period_of(F.col("last"), grain)
    return bounds.where(F.col("first").isNotNull()).select(_steps(first, last, months).alias("period"))


def dense_series(counts: DataFrame, grain: str, value: str = "publications") -> DataFrame:
    """Fill the periods missing between observed ones with zero.

    Each observed period is stretched up to the next one, so the counts are read once instead
    of being joined to a spine that has to scan them again for its bounds. The window runs over
    one row per observed period.
    """
    _, months = _grain(grain)
    following = F.lead("period").over(Window.orderBy("period"))
    last = F.coalesce(F.add_months(following, -months), F.col("period"))
    stretched = counts.where(F.col("period").isNotNull()).withColumn("last", last)
    slots = stretched.select("period", value, _steps(F.col("period"), F.col("last"), months).alias("slot"))
    observed = F.when(F.col("slot") == F.col("period"), F.col(value)).otherwise(F.lit(0))
    return slots.select(F.col("slot").alias("period"), observed.alias(value))


def year_grid(entities: DataFrame, years: Column, name: str = "year") -> DataFrame:
    """Each entity once per year of an array column; no join is involved."""
    return entities.withColumn("_years", years).withColumn(name, F.explode("_years")).drop("_years")


def literal_years(years=YEARS) -> Column:
    return F.array(*[F.lit(int(year)) for year in years])


def observed_years(rows: DataFrame, year: str) -> Column:
    """The distinct years of a frame as one array value (a scalar subquery)."""
    return rows.agg(F.sort_array(F.collect_set(year)).alias("years")).scalar()


def build_skeleton(countries: DataFrame, years=YEARS) -> DataFrame:
    """Complete entity x year grain before any measure is known."""
    return year_grid(countries, literal_years(years))


def triage_observations(
    observations: DataFrame, countries: DataFrame, years=YEARS, indicators: dict = INDICATORS
) -> DataFrame:
    """Give every long observation a status, by the first rule that applies.

    Input columns: indicator, country_code_iso3, date, value (VARIANT). Order of the rules:
    unexpected indicator, not a country, bad year, out of period, duplicate, not a number.
    """
    known = countries.select("country_code_iso3").distinct().withColumn("is_country", F.lit(True))
    fields = F.create_map(*[F.lit(x) for field, code in indicators.items() for x in (code, field)])
    code = F.coalesce(F.trim("indicator"), F.lit(""))
    kind = F.coalesce(F.schema_of_variant("value"), F.lit("VOID"))
    numeric = kind.isin("VOID", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    rows = (
        observations.select(
            code.alias("indicator"),
            F.trim("country_code_iso3").alias("country_code_iso3"),
            F.col("date").try_cast("int").alias("year"),
            F.try_variant_get("value", "$", "double").alias("value"),
            numeric.alias("numeric"),
        )
        .withColumn("field", F.try_element_at(fields, F.col("indicator")))
        .join(known, "country_code_iso3", "left")
        .withColumn(
            "early",
            F.when(F.col("field").isNull(), "unexpected_indicator")
            .when(F.col("is_country").isNull(), "not_a_country")
            .when(F.col("year").isNull(), "bad_year")
            .when(~F.col("year").isin(list(years)), "out_of_period"),
        )
    )
    # Repeats are counted with a partial aggregate, not a window: one key may fill a partition.
    key = ["country_code_iso3", "year", "field"]
    repeated = (
        rows.where(F.col("early").isNull())
        .groupBy(*key)
        .count()
        .where("count > 1")
        .select(*key, F.lit(True).alias("repeated"))
    )
    status = F.coalesce(
        F.col("early"),
        F.when(F.col("repeated"), F.lit("duplicate")),
        F.when(~F.col("numeric"), F.lit("not_numeric")),
        F.lit("applied"),
    )
    return rows.join(repeated, key, "left").select(
        "indicator", "country_code_iso3", "year", "field", "value", status.alias("status")
    )


FATAL_STATUSES = ("bad_year", "duplicate", "not_numeric")


def triage_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("status", "indicator").agg(F.count("*").alias("observations"))


def pivot_observations(
    triaged: DataFrame, countries: DataFrame, years=YEARS, indicators: dict = INDICATORS
) -> DataFrame:
    """Applied observations, wide, on the complete skeleton; what is absent stays NULL."""
    applied = triaged.where(F.col("status") == "applied")
    wide = applied.groupBy("country_code_iso3", "year").pivot("field", list(indicators)).agg(F.max("value"))
    return build_skeleton(countries, years).join(wide, ["country_code_iso3", "year"], "left")


def as_integers(frame: DataFrame) -> DataFrame:
    """Counts and ranks as 64-bit integers, whatever width they were computed in."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    casts = {f.name: F.col(f.name).cast("long") for f in frame.schema if isinstance(f.dataType, narrow)}
    return frame.withColumns(casts) if casts else frame
