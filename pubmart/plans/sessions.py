"""Fixed-parameter OLAP sessions. They look at dated publications only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pubmart.functions import measures as M
from pubmart.operators.reshape import dense_series, literal_years, period_of, year_grid
from pubmart.plans.attribution import (
    fractional_count,
    full_count,
    member_label,
    member_totals,
    parent_participation,
)
from pubmart.plans.filters import RELATIONS, FilterState, dated, with_calendar
from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import (
    END_YEAR,
    INCOME_GROUPS,
    MEASURES,
    MINIMUM_SUPPORT,
    START_YEAR,
)


def _dated_publications(wh: Warehouse, first: int, last: int) -> DataFrame:
    return with_calendar(dated(wh, first, last))


# ---- research growth -----------------------------------------------------------------


def yearly_growth(wh: Warehouse, first: int = START_YEAR, last: int = END_YEAR) -> DataFrame:
    """Publications per observed year and their growth over the observed year before."""
    counts = _dated_publications(wh, first, last).groupBy("calendar_year").agg(
        full_count().alias("publications")
    )
    previous = F.lag("publications").over(Window.orderBy("calendar_year"))
    return counts.select(
        "calendar_year",
        "publications",
        M.growth_pct(F.col("publications"), previous).alias("year_over_year_growth_pct"),
    ).orderBy("calendar_year")


def period_growth(publications: DataFrame, grain: str) -> DataFrame:
    """Dense series of one grain with growth; after a period of zero the growth is NULL."""
    counts = publications.groupBy(period_of(F.col("full_date"), grain).alias("period")).agg(
        full_count().alias("publications")
    )
    previous = F.lag("publications").over(Window.orderBy("period"))
    return (
        dense_series(counts, grain)
        .withColumn("period_growth_pct", M.growth_pct(F.col("publications"), previous))
        .orderBy("period")
    )


def quarterly_growth(wh: Warehouse, first: int = 2022, last: int = END_YEAR) -> DataFrame:
    return period_growth(_dated_publications(wh, first, last), "Quarter")


def monthly_growth(wh: Warehouse, first: int = END_YEAR, last: int = END_YEAR) -> DataFrame:
    return period_growth(_dated_publications(wh, first, last), "Month")


def type_by_year(wh: Warehouse, first: int = START_YEAR, last: int = END_YEAR) -> DataFrame:
    kind = M.labelled(F.col("publication_type")).alias("publication_type")
    return (
        _dated_publications(wh, first, last)
        .groupBy("calendar_year", kind)
        .agg(full_count().alias("publications"))
        .orderBy("calendar_year", "publication_type")
    )


def access_by_year(wh: Warehouse, first: int = START_YEAR, last: int = END_YEAR) -> DataFrame:
    return (
        _dated_publications(wh, first, last)
        .groupBy("calendar_year", "is_open_access")
        .agg(full_count().alias("publications"))
        .orderBy("calendar_year", F.desc_nulls_last("is_open_access"))
        .select(
            "calendar_year",
            M.open_access_label(F.col("is_open_access")).alias("open_access"),
            "publications",
        )
    )


# ---- geographic leadership -----------------------------------------------------------

_PLACE = (
    "country_code_iso2",
    "country_code_iso3",
    "country_name",
    "region_name",
    "income_level_name",
)


def _country_year(wh: Warehouse, f: FilterState) -> DataFrame:
    totals = member_totals(
        wh,
        f,
        "country",
        ["calendar_year"],
        full_publications=full_count(),
        fractional_publications=fractional_count(),
    )
    return totals.withColumn("country_name", member_label(RELATIONS["country"]))


def _by_year(column: str) -> object:
    return F.rank().over(Window.partitionBy("calendar_year").orderBy(F.desc_nulls_last(column)))


def country_rank_comparison(
    wh: Warehouse, first: int = START_YEAR, last: int = END_YEAR
) -> DataFrame:
    """Annual country ranks under both counting methods and the shift between them."""
    ranked = _country_year(wh, FilterState(first, last)).withColumns(
        {
            "full_rank": _by_year("full_publications"),
            "fractional_rank": _by_year("fractional_publications"),
        }
    )
    return ranked.select(
        "calendar_year",
        *_PLACE,
        "full_publications",
        "fractional_publications",
        "full_rank",
        "fractional_rank",
        (F.col("full_rank") - F.col("fractional_rank")).alias("rank_shift"),
    ).orderBy("calendar_year", "full_rank", "country_name")


def country_full_ranks(wh: Warehouse, first: int = START_YEAR, last: int = END_YEAR) -> DataFrame:
    return (
        country_rank_comparison(wh, first, last)
        .select("calendar_year", *_PLACE, "full_publications", "full_rank")
        .orderBy("calendar_year", "full_rank", "country_name")
    )


def country_fractional_ranks(
    wh: Warehouse, first: int = START_YEAR, last: int = END_YEAR
) -> DataFrame:
    return (
        country_rank_comparison(wh, first, last)
        .select("calendar_year", *_PLACE, "fractional_publications", "fractional_rank")
        .orderBy("calendar_year", "fractional_rank", "country_name")
    )


# ---- drill-across to the country-year panel ------------------------------------------


def drill_across(country_year: DataFrame, wh: Warehouse) -> DataFrame:
    """Join the panel only after publications have reached country x year."""
    panel = wh.fact_country_year.select(
        "country_key", F.col("year").alias("calendar_year"), *MEASURES
    )
    joined = country_year.join(panel, ["country_key", "calendar_year"], "left")
    output = F.col("fractional_publications")
    return joined.withColumns(
        {
            "publications_per_million": M.per_million(output, F.col("population")),
            "publications_per_billion_gdp": M.per_billion(output, F.col("gdp_current_usd")),
        }
    )


def supported(rows: DataFrame, minimum: float) -> DataFrame:
    """Support threshold on the full count, applied after aggregation."""
    return rows.where(F.col("full_publications") >= minimum)


def normalised_leadership(
    wh: Warehouse,
    first: int = START_YEAR,
    last: int = END_YEAR,
    minimum: float = MINIMUM_SUPPORT,
) -> DataFrame:
    """Annual rank by fractional publications per million inhabitants."""
    rows = supported(drill_across(_country_year(wh, FilterState(first, last)), wh), minimum)
    rows = rows.where(F.col("publications_per_million").isNotNull())
    ranked = rows.withColumn("normalized_rank", _by_year("publications_per_million"))
    return ranked.select(
        "calendar_year",
        "normalized_rank",
        *_PLACE,
        "full_publications",
        F.round("fractional_publications", 3).alias("fractional_publications"),
        "population",
        F.round("publications_per_million", 3).alias("publications_per_million"),
    ).orderBy("calendar_year", "normalized_rank", "country_name")


def wealth_and_intensity(
    wh: Warehouse,
    first: int = START_YEAR,
    last: int = END_YEAR,
    minimum: float = MINIMUM_SUPPORT,
) -> DataFrame:
    """Complete pairs of GDP per capita and intensity, with the number of pairs per year."""
    rows = supported(drill_across(_country_year(wh, FilterState(first, last)), wh), minimum)
    rows = rows.dropna(subset=["gdp_per_capita_current_usd", "publications_per_million"])
    pairs = F.count("*").over(Window.partitionBy("calendar_year"))
    return (
        rows.withColumn("complete_country_pairs", pairs)
        .orderBy("calendar_year", "gdp_per_capita_current_usd", "country_name")
        .select(
            "calendar_year",
            *_PLACE[:4],
            M.labelled(F.col("income_level_name")).alias("income_level_name"),
            "full_publications",
            F.round("fractional_publications", 3).alias("fractional_publications"),
            "population",
            F.round("gdp_per_capita_current_usd", 2).alias("gdp_per_capita_current_usd"),
            F.round("publications_per_million", 3).alias("publications_per_million"),
            "complete_country_pairs",
        )
    )


def group_year(
    wh: Warehouse, f: FilterState, parent: str, countries: DataFrame, years
) -> DataFrame:
    """Country groups on the full grid: zero-output countries count in the denominators.

    Ratios use numerator and denominator of the same countries, those whose denominator is
    positive; the plain population and GDP totals are not restricted.
    """
    grid = year_grid(
        countries.select("country_key", F.col(parent).alias("member")), years, "calendar_year"
    )
    output = member_totals(
        wh, f, "country", ["calendar_year"], fractional_publications=fractional_count()
    ).select("country_key", "calendar_year", "fractional_publications")
    panel = wh.fact_country_year.select(
        "country_key", F.col("year").alias("calendar_year"), "population", "gdp_current_usd"
    )
    key = ["country_key", "calendar_year"]
    cells = grid.join(output, key, "left").join(panel, key, "left")
    fractional = F.coalesce("fractional_publications", F.lit(0.0))
    peopled, moneyed = F.col("population") > 0, F.col("gdp_current_usd") > 0
    groups = cells.groupBy("member", "calendar_year").agg(
        M.stable(M.exact_sum(fractional)).alias("fractional_publications"),
        F.sum("population").alias("population"),
        F.sum("gdp_current_usd").alias("gdp_current_usd"),
        M.stable(M.exact_sum(F.when(peopled, fractional))).alias("matched_fractional_publications"),
        F.sum(F.when(peopled, F.col("population"))).alias("matched_population"),
        M.stable(M.exact_sum(F.when(moneyed, fractional))).alias("gdp_fractional_publications"),
        F.sum(F.when(moneyed, F.col("gdp_current_usd"))).alias("matched_gdp"),
        F.count("*").alias("countries"),
        F.count_if(peopled).alias("population_countries"),
        F.count_if(moneyed).alias("gdp_countries"),
    )
    full = (
        parent_participation(wh, f, "country", parent)
        .groupBy(F.col("member").alias("full_member"), F.col("calendar_year").alias("full_year"))
        .agg(F.count("*").alias("full_publications"))
    )
    same = F.col("member").eqNullSafe(F.col("full_member")) & (
        F.col("calendar_year") == F.col("full_year")
    )
    joined = groups.join(full, same, "left").drop("full_member", "full_year")
    return joined.withColumns(
        {
            "full_publications": F.coalesce("full_publications", F.lit(0)),
            "publications_per_million": M.per_million(
                F.col("matched_fractional_publications"), F.col("matched_population")
            ),
            "publications_per_billion_gdp": M.per_billion(
                F.col("gdp_fractional_publications"), F.col("matched_gdp")
            ),
        }
    )


def income_level_gap(
    wh: Warehouse,
    first: int = START_YEAR,
    last: int = END_YEAR,
    groups: tuple[str, ...] = INCOME_GROUPS,
) -> DataFrame:
    """Share and intensity of the named income groups on the full country x year grid."""
    countries = wh.dim_country.where(F.col("income_level_name").isin(list(groups)))
    years = literal_years(range(first, last + 1))
    rows = group_year(wh, FilterState(first, last), "income_level_name", countries, years)
    annual = M.exact_sum(F.col("fractional_publications")).over(Window.partitionBy("calendar_year"))
    rows = rows.withColumn("annual_known_fractional_publications", M.stable(annual))
    share = M.rate(
        F.col("fractional_publications"), F.col("annual_known_fractional_publications"), 100
    )
    position = F.coalesce(
        *[F.when(F.col("income_level") == name, F.lit(i)) for i, name in enumerate(groups, 1)],
        F.lit(len(groups) + 1),
    )
    return rows.select(
        "calendar_year",
        F.col("member").alias("income_level"),
        "full_publications",
        F.round("fractional_publications", 3).alias("fractional_publications"),
        F.round("annual_known_fractional_publications", 3).alias(
            "annual_known_fractional_publications"
        ),
        F.round(share, 2).alias("fractional_share_pct"),
        F.round("matched_fractional_publications", 3).alias("matched_fractional_publications"),
        "matched_population",
        F.round("publications_per_million", 3).alias("publications_per_million"),
        "countries",
        "population_countries",
    ).orderBy("calendar_year", position)


def topic_annual_leaders(
    wh: Warehouse, first: int = START_YEAR, last: int = END_YEAR, leaders: int = 4
) -> DataFrame:
    """Annual shares of the topics that lead over the whole period; shares may overlap."""
    f = FilterState(first, last)
    topic_year = (
        member_totals(wh, f, "topic", ["calendar_year"], topic_publications=F.count("*"))
        .withColumn("topic_name", M.labelled(F.col("topic_name"), F.col("topic_id")))
        .select("calendar_year", "topic_id", "topic_name", "topic_publications")
    )
    period = (
        topic_year.groupBy("topic_id")
        .agg(F.sum("topic_publications").alias("cumulative_publications"))
        .orderBy(F.desc("cumulative_publications"), "topic_id")
        .limit(leaders)
    )
    annual = (
        _dated_publications(wh, first, last)
        .groupBy("calendar_year")
        .agg(full_count().alias("annual_publications"))
    )
    share = M.rate(F.col("topic_publications"), F.col("annual_publications"), 100)
    return (
        topic_year.join(period, "topic_id")
        .join(annual, "calendar_year")
        .select(
            "calendar_year",
            "topic_id",
            "topic_name",
            "cumulative_publications",
            "topic_publications",
            "annual_publications",
            F.round(share, 2).alias("annual_share_pct"),
        )
        .orderBy("calendar_year", F.desc("cumulative_publications"), "topic_name")
    )


# ---- smoke queries -------------------------------------------------------------------


def smoke_year_trend(wh: Warehouse) -> DataFrame:
    dates = wh.dim_date.select("date_key", "calendar_year")
    return (
        wh.fact_publication.join(dates, "date_key")
        .groupBy("calendar_year")
        .agg(full_count().alias("publication_count"), F.sum("citation_count").alias("citation_count"))
        .orderBy("calendar_year")
    )


def smoke_countries(wh: Warehouse) -> DataFrame:
    return (
        member_totals(wh, FilterState(), "country", [], publications=full_count())
        .select(
            "country_code_iso2",
            "country_name",
            "region_name",
            "income_level_name",
            F.col("publications").alias("publication_count"),
        )
        .orderBy(F.desc("publication_count"), "country_code_iso2")
    )


def smoke_topics(wh: Warehouse) -> DataFrame:
    return (
        member_totals(wh, FilterState(), "topic", [], publications=full_count())
        .select(
            "topic_id", "topic_name", "subfield_name", F.col("publications").alias("publication_count")
        )
        .orderBy(F.desc("publication_count"), "topic_id")
    )


def smoke_institution_types(wh: Warehouse) -> DataFrame:
    """Two institutions of one type count their shared publication once."""
    return (
        parent_participation(wh, FilterState(), "institution", "institution_type")
        .groupBy(F.col("member").alias("institution_type"))
        .agg(F.count("*").alias("publication_count"))
        .orderBy(F.desc("publication_count"), F.asc_nulls_last("institution_type"))
    )


def source_key_totals(publications: DataFrame, wh: Warehouse, *totals) -> DataFrame:
    """Totals per source key, then the source's attributes.

    Reducing first keeps the outer join off the large table, where all publications without a
    source would meet in one partition.
    """
    sums = publications.groupBy("source_key").agg(*totals)
    return sums.join(wh.dim_source, "source_key", "left")


def smoke_source_types(wh: Warehouse) -> DataFrame:
    kind = F.coalesce("source_type", F.lit("<missing>")).alias("source_type")
    return (
        source_key_totals(wh.fact_publication, wh, full_count().alias("publications"))
        .groupBy(kind)
        .agg(F.sum("publications").alias("publication_count"))
        .orderBy(F.desc("publication_count"), "source_type")
    )


def smoke_publication_types(wh: Warehouse) -> DataFrame:
    return (
        wh.fact_publication.groupBy("publication_type")
        .agg(full_count().alias("publication_count"))
        .orderBy(F.desc("publication_count"), F.asc_nulls_last("publication_type"))
    )


def smoke_country_year(wh: Warehouse) -> DataFrame:
    """Fractional country x year with its normalised metrics."""
    only_dated = wh.replace(fact_publication=wh.fact_publication.where("date_key IS NOT NULL"))
    totals = member_totals(
        only_dated,
        FilterState(),
        "country",
        ["calendar_year"],
        fractional_publications=fractional_count(),
    )
    return (
        drill_across(totals, wh)
        .select(
            "country_code_iso2",
            "country_name",
            "calendar_year",
            F.col("fractional_publications").alias("publication_count"),
            "population",
            "gdp_current_usd",
            F.col("publications_per_million").alias("publications_per_million_inhabitants"),
            F.col("publications_per_billion_gdp").alias("publications_per_billion_usd_gdp"),
        )
        .orderBy("calendar_year", "country_code_iso2")
    )
