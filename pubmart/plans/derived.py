"""Second-step analyses over the results of the dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pubmart.functions import measures as M
from pubmart.functions.text import lenient_number
from pubmart.plans import dashboard as D
from pubmart.plans.attribution import FRACTIONAL
from pubmart.plans.filters import FilterState
from pubmart.plans.sessions import supported
from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import INCOME_GROUPS, MINIMUM_SUPPORT, MISSING_LABEL, MISSING_VALUE


def numeric(rows: DataFrame, *columns: str) -> DataFrame:
    """Turn the named columns that exist into numbers; what is not a number becomes NULL."""
    return rows.withColumns({c: lenient_number(F.col(c)) for c in columns if c in rows.columns})


def topic_annual_shares(evolution: DataFrame, annual: DataFrame) -> DataFrame:
    """Overlapping topic participation as a share of each year's corpus."""
    totals = annual.select("calendar_year", F.col("publications").alias("annual_publications"))
    share = M.rate(F.col("publications"), F.col("annual_publications"), 100)
    return evolution.join(totals, "calendar_year", "left").withColumn("annual_share", share)


def adjacent_year_growth(trend: DataFrame) -> DataFrame:
    """Growth over the calendar year before, only where that year exists and is positive."""
    by_year = Window.orderBy("calendar_year")
    previous, previous_year = F.lag("publications").over(by_year), F.lag("calendar_year").over(by_year)
    adjacent = (F.col("calendar_year") - previous_year == 1) & (previous > 0)
    growth = F.when(adjacent, M.growth_pct(F.col("publications"), previous))
    return trend.withColumn("year_over_year_growth", growth).orderBy(F.asc_nulls_last("calendar_year"))


def total_growth(trend: DataFrame) -> DataFrame:
    """First and last year of a trend and the growth between them, in one row.

    An undated row sorts last, as the trend presents it.
    """
    order = F.coalesce("calendar_year", F.lit(2**31 - 1))
    ends = trend.agg(
        F.min_by(F.struct("calendar_year", "publications"), order).alias("first"),
        F.max_by(F.struct("calendar_year", "publications"), order).alias("last"),
    ).where(F.col("first").isNotNull())
    first, last = F.col("first.publications"), F.col("last.publications")
    return ends.select(
        F.col("first.calendar_year").alias("first_year"),
        F.col("last.calendar_year").alias("last_year"),
        F.when(first > 0, M.growth_pct(last, first)).alias("total_growth_pct"),
    )


def leading_types_over_time(wh: Warehouse, f: FilterState, leaders: int = 6) -> DataFrame:
    """Publication types by year, for the types that lead over all years."""
    by_year = D.publication_type_by_year(wh, f)
    top = (
        by_year.groupBy("publication_type")
        .agg(F.sum("publications").alias("total"))
        .orderBy(F.desc("total"), "publication_type")
        .limit(leaders)
    )
    return by_year.join(top, "publication_type", "left_semi")


def source_ranking(sources: DataFrame, include_missing: bool, top: int) -> DataFrame:
    rows = sources if include_missing else sources.where(F.col("source_id") != MISSING_VALUE)
    return rows.orderBy(F.desc("publications"), "source_name", "source_id").limit(top)


def missing_source_share(wh: Warehouse, f: FilterState) -> DataFrame:
    """Share of publications without a known source, from the complete aggregate."""
    missing = F.when(F.col("source_id") == MISSING_VALUE, F.col("publications")).otherwise(0)
    totals = D.source_output(wh, f, limit=None).agg(
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_publications"),
        F.coalesce(F.sum("publications"), F.lit(0)).alias("publications"),
    )
    share = M.rate(F.col("missing_publications"), F.col("publications"), 100)
    return totals.withColumn("missing_share", F.coalesce(share, F.lit(0.0)))


def snapshot(rows: DataFrame, year: int, minimum: float = 0) -> DataFrame:
    """One year of country-year rows that reach the support threshold."""
    return supported(rows.where(F.col("calendar_year") == year), minimum)


def supported_ranks(
    wh: Warehouse, f: FilterState, year: int, minimum: float = MINIMUM_SUPPORT
) -> DataFrame:
    """Ranks of one year recomputed among the supported countries only."""
    return D.with_leadership_ranks(snapshot(D.normalized_country_year(wh, f), year, minimum)).select(
        "country_name",
        "full_publications",
        "fractional_publications",
        "absolute_rank",
        "per_million_rank",
        "per_gdp_rank",
        "population_rank_shift",
        "gdp_rank_shift",
    )


def normalised_snapshot(
    wh: Warehouse,
    f: FilterState,
    year: int,
    metric: str = "publications_per_million",
    minimum: float = MINIMUM_SUPPORT,
    top: int = 20,
) -> DataFrame:
    """The leading countries of one year by a normalised metric."""
    rows = snapshot(D.normalized_country_year(wh, f), year, minimum).dropna(subset=[metric])
    return rows.orderBy(F.desc(metric), "country_name", "country_code_iso2").limit(top)


def compared_countries(
    wh: Warehouse,
    f: FilterState,
    codes: tuple[str, ...],
    metric: str = "publications_per_million",
    minimum: float = MINIMUM_SUPPORT,
) -> DataFrame:
    """A normalised metric over time for chosen countries."""
    rows = supported(D.normalized_country_year(wh, f), minimum)
    return rows.where(F.col("country_code_iso2").isin(list(codes))).dropna(subset=[metric])


def income_group_shares(
    wh: Warehouse, f: FilterState, groups: tuple[str, ...] = INCOME_GROUPS
) -> DataFrame:
    """Fractional share among the known income groups of each year."""
    rows = D.country_group_capacity(wh, f, "Income level")
    known = rows.where(F.col("member").isin(list(groups)))
    annual = F.sum("fractional_publications").over(Window.partitionBy("calendar_year"))
    return known.withColumn("fractional_share", M.rate(F.col("fractional_publications"), annual, 100))


def unclassified_output(wh: Warehouse, f: FilterState) -> DataFrame:
    """Fractional output of countries without an income group."""
    rows = D.country_group_capacity(wh, f, "Income level")
    missing = rows.where(F.col("member") == MISSING_LABEL)
    total = F.coalesce(F.sum("fractional_publications"), F.lit(0.0))
    return missing.agg(M.stable(total).alias("fractional_publications"))


# The indicator behind each socioeconomic view.
PAIRED_INDICATORS = {
    "Wealth": "gdp_per_capita_current_usd",
    "R&D investment": "rd_expenditure_pct_gdp",
    "Digital access": "internet_users_pct",
}
PAIRED_CHANGES = {
    "GDP change": "gdp_change",
    "Internet access change": "internet_change_pp",
    "R&D investment change": "rd_change_pp",
}


def _chosen(options: dict[str, str], name: str) -> str:
    if name not in options:
        raise ValueError(f"Unsupported view: {name}")
    return options[name]


def paired_snapshot(
    wh: Warehouse, f: FilterState, view: str, year: int, minimum: float = MINIMUM_SUPPORT
) -> DataFrame:
    """Countries of one year with both the view's indicator and an intensity."""
    indicator = _chosen(PAIRED_INDICATORS, view)
    rows = snapshot(D.normalized_country_year(wh, f), year, minimum)
    pairs = rows.dropna(subset=[indicator, "publications_per_million"])
    return pairs.withColumn("income_level_name", M.labelled(F.col("income_level_name")))


def paired_changes(wh: Warehouse, f: FilterState, view: str) -> DataFrame:
    """Country-years with both an indicator change and an output change."""
    changed = _chosen(PAIRED_CHANGES, view)
    return D.socioeconomic_change(wh, f).dropna(subset=[changed, "output_change"])


def topic_shares(
    wh: Warehouse, f: FilterState, method: str = FRACTIONAL, level: str = "Subfield", limit: int | None = None
) -> DataFrame:
    """Evolution of the members of a level, or of the leading ones, as shares of each year."""
    return topic_annual_shares(
        D.topic_evolution(wh, f, method, level, limit), D.publications_by_year(wh, f)
    )
