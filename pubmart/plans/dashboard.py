"""Parameterised queries over a filter state. Undated publications stay in as a NULL year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pubmart.functions import measures as M
from pubmart.operators.reshape import observed_years
from pubmart.plans.attribution import (
    FULL,
    Fractional,
    check_method,
    counted,
    fractional_count,
    full_count,
    hierarchy_output,
    leading,
    member_label,
    member_totals,
)
from pubmart.plans.filters import (
    RELATIONS,
    FilterState,
    country_members,
    filtered_publications,
    of_source_types,
)
from pubmart.plans.sessions import drill_across, group_year, period_growth, source_key_totals
from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import MEASURES, MISSING_LABEL, MISSING_VALUE


def year_bounds(wh: Warehouse) -> DataFrame:
    return wh.dim_date.agg(
        F.min("calendar_year").alias("min_year"), F.max("calendar_year").alias("max_year")
    )


# ---- filter catalogue ----------------------------------------------------------------


def _option(name: str, value: Column, label: Column, sort: Column | None = None) -> Column:
    """One entry of the catalogue; without a sort label it comes last."""
    return F.struct(
        F.lit(name).alias("filter_name"),
        value.alias("value"),
        label.alias("label"),
        (label if sort is None else sort).alias("sort_label"),
    )


def _attribute(name: str, column: str) -> Column:
    """Member of a nullable attribute; NULL shows as the sentinel, after all others."""
    value = F.col(column)
    return _option(name, F.coalesce(value, F.lit(MISSING_VALUE)), F.coalesce(value, F.lit(MISSING_LABEL)), value)


def _level(name: str, identifier: str, named: str, missing: bool = False) -> Column:
    """Member of a hierarchy level. A level that shows missing members takes a name of its own from the id."""
    value, label = F.col(identifier), F.col(named)
    if not missing:
        return _option(name, value, label)
    label = F.coalesce(label, value)
    return _option(name, F.coalesce(value, F.lit(MISSING_VALUE)), F.coalesce(label, F.lit(MISSING_LABEL)), label)


_ONE_NAME = ("field", "domain")  # levels whose members show one of their names


def _catalogue(rows: DataFrame, *options: Column) -> DataFrame:
    """Distinct options of several filters from one pass over a table; a NULL value is none."""
    entries = rows.select(F.explode(F.array(*options)).alias("o")).select("o.*").where("value IS NOT NULL")
    several = F.when(~F.col("filter_name").isin(*_ONE_NAME), F.col("label")).alias("_label")
    members = entries.groupBy("filter_name", "value", several)
    return members.agg(F.max("label").alias("label"), F.max("sort_label").alias("sort_label")).drop("_label")


def _fact_attributes(facts: DataFrame) -> DataFrame:
    """Members of the fact's own attributes from one pass over the fact."""
    combinations = facts.select("publication_type", "language", "is_open_access").distinct()
    flag = F.col("is_open_access")
    members = F.array(
        *[
            F.struct(F.lit(name).alias("filter_name"), value.alias("member"))
            for name, value in (
                ("publication_type", F.col("publication_type")),
                ("language", F.col("language")),
                ("open_access", flag.cast("string")),
            )
        ]
    )
    rows = combinations.select(F.explode(members).alias("m")).select("m.*").distinct()
    value, is_flag = F.col("member"), F.col("filter_name") == "open_access"
    label = F.when(is_flag, M.open_access_label(value.try_cast("boolean"))).otherwise(value)
    order = F.when(is_flag & (value == "true"), "").otherwise(value)
    return rows.select(
        "filter_name",
        F.coalesce(value, F.lit(MISSING_VALUE)).alias("value"),
        F.coalesce(label, F.lit(MISSING_LABEL)).alias("label"),
        F.when(value.isNotNull(), order).alias("sort_label"),
    )


def filter_options(wh: Warehouse) -> DataFrame:
    """Every selectable member of the twelve filters with its label; each dimension is read once."""
    iso2, topic_id = F.col("country_code_iso2"), F.col("topic_id")
    country_name = F.coalesce(F.col("country_name"), iso2)
    topic_name = F.coalesce(F.col("topic_name"), topic_id)
    families = [
        _catalogue(
            wh.dim_country,
            _option("country", iso2, F.concat(country_name, F.lit(" ("), iso2, F.lit(")")), country_name),
            _attribute("region", "region_name"),
            _attribute("income_level", "income_level_name"),
        ),
        _catalogue(
            wh.dim_topic,
            _option("topic", topic_id, F.concat(topic_name, F.lit(" · "), M.labelled(F.col("subfield_name"))), topic_name),
            _level("subfield", "subfield_id", "subfield_name", missing=True),
            _level("field", "field_id", "field_name"),
            _level("domain", "domain_id", "domain_name"),
        ),
        _catalogue(wh.dim_institution, _attribute("institution_type", "institution_type")),
        _catalogue(wh.dim_source.where(F.col("source_type").isNotNull()), _attribute("source_type", "source_type")),
        of_source_types(wh.fact_publication, wh, (MISSING_VALUE,))
        .limit(1)
        .select(_option("source_type", F.lit(MISSING_VALUE), F.lit(MISSING_LABEL), F.lit(None).cast("string")).alias("o"))
        .select("o.*"),
        _fact_attributes(wh.fact_publication),
    ]
    catalogue = reduce(DataFrame.unionByName, families)
    return catalogue.orderBy("filter_name", F.asc_nulls_last("sort_label"), "value").select(
        "filter_name", "value", "label"
    )


# ---- corpus overview -----------------------------------------------------------------


def _participation(wh: Warehouse, f: FilterState) -> DataFrame:
    """Publication, relation and member key of the selected bridge rows of all relations."""
    rows = [
        relation.selected_bridge(wh, f).select("publication_key", F.lit(name).alias("relation"), F.col(relation.key).alias("member"))
        for name, relation in RELATIONS.items()
    ]
    return reduce(DataFrame.unionAll, rows)


def _bitmaps(rows: DataFrame) -> DataFrame:
    """Bitmaps of the members of each relation. Surrogate keys are 1..n, so that they are dense."""
    bucket, bit = F.bitmap_bucket_number("member"), F.bitmap_bit_position("member")
    return rows.groupBy("relation", bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def overview_metrics(wh: Warehouse, f: FilterState) -> DataFrame:
    """Totals of the filtered publications and the numbers of members that they reach.

    The publications are filtered once. Each one is taken four times: for its own measures, which meet no
    bridge row, and for each relation. Members are counted as bits of mergeable bitmaps, so that a
    shuffle carries a few kilobytes for 32,768 members instead of the distinct pairs.
    """
    tags = F.explode(F.array(*[F.lit(t) for t in ("", *RELATIONS)])).alias("relation")
    cited, flag = (F.when(F.col("relation") == "", F.col(c)).alias(c) for c in ("citation_count", "is_open_access"))
    taken = filtered_publications(wh, f).select("publication_key", "publication_count", "citation_count", "is_open_access", tags)
    taken = taken.select("publication_key", "relation", F.when(F.col("relation") == "", F.col("publication_count")).alias("publication_count"), cited, flag)
    reached = taken.join(_participation(wh, f), ["publication_key", "relation"], "left")
    reached = reached.where((F.col("relation") == "") | F.col("member").isNotNull())
    bucket, bit = F.bitmap_bucket_number("member"), F.bitmap_bit_position("member")
    parts = reached.groupBy("relation", bucket.alias("bucket")).agg(
        full_count().alias("publications"),
        F.sum("citation_count").alias("cumulative_citations"),
        F.sum(F.col("is_open_access").cast("int")).alias("open"),
        F.count("is_open_access").alias("known"),
        F.bitmap_construct_agg(bit).alias("bitmap"),
    )
    # members without a row in their dimension do not count
    present = reduce(
        DataFrame.unionAll,
        [r.dimension(wh).select(F.lit(name).alias("relation"), F.col(r.key).alias("member")) for name, r in RELATIONS.items()],
    )
    both = parts.unionByName(_bitmaps(present), allowMissingColumns=True).groupBy("relation", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("publications", "cumulative_citations", "open", "known")],
        F.when(F.count("*") == 2, F.bitmap_count(F.bitmap_and_agg("bitmap"))).otherwise(0).alias("members"),
    )
    own = F.col("relation") == ""
    return both.agg(
        F.coalesce(F.sum("publications"), F.lit(0)).alias("publications"),
        F.sum("cumulative_citations").alias("cumulative_citations"),
        *[
            F.coalesce(F.sum(F.when(F.col("relation") == name, F.col("members"))), F.lit(0)).alias(plural)
            for name, plural in (("country", "countries"), ("institution", "institutions"), ("topic", "topics"))
        ],
        (100 * F.sum(F.when(own, F.col("open"))) / F.nullif(F.sum(F.when(own, F.col("known"))), F.lit(0))).alias("open_access_share"),
    )


def publications_by_year(wh: Warehouse, f: FilterState) -> DataFrame:
    return (
        filtered_publications(wh, f)
        .groupBy("calendar_year")
        .agg(
            full_count().alias("publications"),
            F.sum("citation_count").alias("cumulative_citations"),
            F.avg("citation_count").alias("average_citations"),
        )
        .orderBy(F.asc_nulls_last("calendar_year"))
    )


def open_access_by_year(wh: Warehouse, f: FilterState) -> DataFrame:
    return (
        filtered_publications(wh, f)
        .groupBy("calendar_year", "is_open_access")
        .agg(full_count().alias("publications"))
        .orderBy(F.asc_nulls_last("calendar_year"), F.desc_nulls_last("is_open_access"))
        .select(
            "calendar_year",
            M.open_access_label(F.col("is_open_access")).alias("open_access"),
            "publications",
        )
    )


def publication_type_by_year(wh: Warehouse, f: FilterState) -> DataFrame:
    return (
        filtered_publications(wh, f)
        .groupBy("calendar_year", M.labelled(F.col("publication_type")).alias("publication_type"))
        .agg(full_count().alias("publications"))
        .orderBy(F.asc_nulls_last("calendar_year"), "publication_type")
    )


def temporal_navigation(wh: Warehouse, f: FilterState, grain: str = "Year") -> DataFrame:
    """Dense growth by year, quarter or month."""
    return period_growth(filtered_publications(wh, f), grain)


# ---- members of one relation ---------------------------------------------------------


def _leading(rows: DataFrame, metric: str, *names: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(metric), *[F.asc_nulls_last(name) for name in names])


def country_output(wh: Warehouse, f: FilterState, method: str, limit: int | None = None) -> DataFrame:
    rows = member_totals(wh, f, "country", [], publications=counted(method)).select(
        "country_code_iso2",
        "country_code_iso3",
        member_label(RELATIONS["country"]).alias("country_name"),
        "region_name",
        "income_level_name",
        "has_indicator_data",
        "publications",
    )
    return leading(_leading(rows, "publications", "country_name", "country_code_iso2"), limit)


def institution_output(wh: Warehouse, f: FilterState, method: str, limit: int | None = None) -> DataFrame:
    rows = member_totals(wh, f, "institution", [], publications=counted(method)).select(
        "institution_id",
        member_label(RELATIONS["institution"]).alias("institution_name"),
        "institution_type",
        "country_code_iso2",
        "publications",
    )
    return leading(_leading(rows, "publications", "institution_name", "institution_id"), limit)


def institution_evolution(
    wh: Warehouse, f: FilterState, method: str, institution_ids: tuple[str, ...]
) -> DataFrame:
    """Chosen institutions per year."""
    if not institution_ids:
        raise ValueError("At least one institution is required")
    check_method(method)
    relation = RELATIONS["institution"]
    chosen = wh.dim_institution.where(F.col("institution_id").isin(list(institution_ids)))
    narrowed = wh.replace(
        dim_institution=chosen,
        bridge_publication_institution=wh.stored(relation.bridge_name).join(
            chosen.select(relation.key), relation.key, "left_semi"
        ),
    )
    rows = member_totals(narrowed, f, "institution", ["calendar_year"], publications=counted(method))
    return rows.select(
        "institution_id",
        member_label(relation).alias("institution_name"),
        "calendar_year",
        "publications",
    ).orderBy(F.asc_nulls_last("calendar_year"), "institution_name")


def topic_output(
    wh: Warehouse, f: FilterState, method: str, level: str = "Topic", limit: int | None = None
) -> DataFrame:
    return hierarchy_output(wh, f, method, "topic", level, limit)


def topic_evolution(
    wh: Warehouse, f: FilterState, method: str, level: str = "Subfield", limit: int | None = None
) -> DataFrame:
    return hierarchy_output(wh, f, method, "topic", level, limit, evolution=True)


def regional_output(wh: Warehouse, f: FilterState, method: str) -> DataFrame:
    rows = hierarchy_output(wh, f, method, "country", "Region")
    return rows.select(F.col("member_name").alias("region"), "publications")


def institution_type_output(wh: Warehouse, f: FilterState, method: str) -> DataFrame:
    rows = hierarchy_output(wh, f, method, "institution", "Type")
    return rows.select(F.col("member_name").alias("institution_type"), "publications")


# ---- sources, types and citations ----------------------------------------------------


def source_output(wh: Warehouse, f: FilterState, limit: int | None = None) -> DataFrame:
    """Sources by publications; publications without a source form one row."""
    publications = filtered_publications(wh, f)
    rows = (
        source_key_totals(publications, wh, full_count().alias("n"))
        .groupBy("source_id", "source_name", "source_type")
        .agg(F.sum("n").alias("publications"))
        .select(
            F.coalesce("source_id", F.lit(MISSING_VALUE)).alias("source_id"),
            M.labelled(F.col("source_name")).alias("source_name"),
            M.labelled(F.col("source_type")).alias("source_type"),
            "publications",
        )
    )
    rows = _leading(rows, "publications", "source_name", "source_id")
    return leading(rows, limit)


def source_type_output(wh: Warehouse, f: FilterState) -> DataFrame:
    rows = (
        source_key_totals(filtered_publications(wh, f), wh, full_count().alias("n"))
        .groupBy(M.labelled(F.col("source_type")).alias("source_type"))
        .agg(F.sum("n").alias("publications"))
    )
    return _leading(rows, "publications", "source_type")


def publication_type_output(wh: Warehouse, f: FilterState) -> DataFrame:
    rows = (
        filtered_publications(wh, f)
        .groupBy(M.labelled(F.col("publication_type")).alias("publication_type"))
        .agg(full_count().alias("publications"))
    )
    return _leading(rows, "publications", "publication_type")


# Upper bound of each citation band, its label and its place.
CITATION_BANDS = ((0, "0", 1), (5, "1–5", 2), (20, "6–20", 3), (100, "21–100", 4))
ABOVE_BANDS = ("101+", 5)
NO_CITATIONS = ("Unavailable", 6)


def citation_distribution(wh: Warehouse, f: FilterState) -> DataFrame:
    count = F.col("citation_count")

    def banded(part: int) -> Column:
        rule = F.when(count.isNull(), F.lit(NO_CITATIONS[part]))
        for bound, *band in CITATION_BANDS:
            rule = rule.when(count <= bound, F.lit(band[part]))
        return rule.otherwise(F.lit(ABOVE_BANDS[part]))

    return (
        filtered_publications(wh, f)
        .groupBy(banded(0).alias("citation_band"), banded(1).alias("band_order"))
        .agg(F.count("*").alias("publications"))
        .select("citation_band", "publications", "band_order")
        .orderBy("band_order")
    )


def citation_ranking(
    wh: Warehouse, f: FilterState, dimension: str, method: str = FULL, limit: int | None = None
) -> DataFrame:
    """Citation snapshots by one dimension. Types have no bridge, so the method is ignored."""
    if dimension in ("Publication type", "Source type"):
        return leading(_citations_by_type(wh, f, dimension), limit)
    relation = RELATIONS.get(dimension.lower())
    if relation is None or dimension != dimension.capitalize():
        raise ValueError(f"No citations by {dimension}; choose a relation or a type")
    check_method(method)
    cited = F.col("citation_count")
    citations = (
        F.sum(cited).cast("double")
        if method == FULL
        else Fractional(cited)
    )
    rows = member_totals(
        wh, f, relation.name, [], cumulative_citations=citations, publications=counted(method)
    )
    rows = rows.withColumn("member_name", member_label(relation))
    rows = _leading(rows, "cumulative_citations", "member_name", relation.key)
    return leading(rows.select("member_name", "cumulative_citations", "publications"), limit)


def _citations_by_type(wh: Warehouse, f: FilterState, dimension: str) -> DataFrame:
    publications = filtered_publications(wh, f)
    # Sum and number of known counts, so an average can still be formed after the second step.
    parts = (
        F.sum("citation_count").alias("cited"),
        F.count("citation_count").alias("known"),
        full_count().alias("n"),
    )
    if dimension == "Source type":
        rows, key = source_key_totals(publications, wh, *parts), "source_type"
    else:
        rows, key = publications.groupBy("publication_type").agg(*parts), "publication_type"
    totals = rows.groupBy(key).agg(
        F.sum("cited").alias("cumulative_citations"),
        (F.sum("cited").cast("double") / F.nullif(F.sum("known"), F.lit(0))).alias(
            "average_citations"
        ),
        F.sum("n").alias("publications"),
    )
    named = totals.select(
        M.labelled(F.col(key)).alias("member_name"),
        "cumulative_citations",
        "average_citations",
        "publications",
    )
    return _leading(named, "cumulative_citations", "member_name")


# ---- drill-across --------------------------------------------------------------------


def normalized_country_year(wh: Warehouse, f: FilterState) -> DataFrame:
    """Country x year output next to the panel, with normalised rates."""
    totals = member_totals(
        wh,
        f,
        "country",
        ["calendar_year"],
        full_publications=full_count(),
        fractional_publications=fractional_count(),
    ).withColumn("country_name", member_label(RELATIONS["country"]))
    return (
        drill_across(totals, wh)
        .select(
            "country_code_iso2",
            "country_code_iso3",
            "country_name",
            "region_name",
            "income_level_name",
            "has_indicator_data",
            "calendar_year",
            "fractional_publications",
            *MEASURES,
            "publications_per_million",
            "publications_per_billion_gdp",
            "full_publications",
        )
        .orderBy(F.asc_nulls_last("calendar_year"), "country_name")
    )


def rank_kept_null(metric: str) -> Column:
    """Annual rank by a metric; a NULL metric has no rank."""
    window = Window.partitionBy("calendar_year").orderBy(F.desc_nulls_last(metric))
    return F.when(F.col(metric).isNotNull(), F.rank().over(window))


def with_leadership_ranks(country_year: DataFrame) -> DataFrame:
    ranked = country_year.withColumns(
        {
            "absolute_rank": rank_kept_null("fractional_publications"),
            "per_million_rank": rank_kept_null("publications_per_million"),
            "per_gdp_rank": rank_kept_null("publications_per_billion_gdp"),
        }
    )
    absolute = F.col("absolute_rank")
    return ranked.withColumns(
        {
            "population_rank_shift": absolute - F.col("per_million_rank"),
            "gdp_rank_shift": absolute - F.col("per_gdp_rank"),
        }
    )


def leadership_ranks(wh: Warehouse, f: FilterState) -> DataFrame:
    return with_leadership_ranks(normalized_country_year(wh, f)).orderBy(
        F.asc_nulls_last("calendar_year"), "absolute_rank", "country_code_iso2"
    )


def socioeconomic_change(wh: Warehouse, f: FilterState) -> DataFrame:
    """Differences to the calendar year before, per country.

    The year before is looked up with a window over one country's years, which reads the
    country-year table once where a self-join would build it twice.
    """
    by_country = Window.partitionBy("country_code_iso2").orderBy("calendar_year")
    previous_year = F.lag("calendar_year").over(by_country)

    def change(metric: str) -> Column:
        previous = F.when(
            previous_year == F.col("calendar_year") - 1, F.lag(metric).over(by_country)
        )
        return F.col(metric) - previous

    return (
        normalized_country_year(wh, f)
        .select(
            "country_name",
            "region_name",
            "income_level_name",
            "calendar_year",
            change("fractional_publications").alias("output_change"),
            change("publications_per_million").alias("intensity_change"),
            change("gdp_current_usd").alias("gdp_change"),
            change("internet_users_pct").alias("internet_change_pp"),
            change("rd_expenditure_pct_gdp").alias("rd_change_pp"),
        )
        .orderBy(F.asc_nulls_last("calendar_year"), "country_name")
    )


def country_group_capacity(wh: Warehouse, f: FilterState, hierarchy: str = "Region") -> DataFrame:
    """Output and capacity of regions or income levels, zero-output countries included."""
    parents = {"Region": "region_name", "Income level": "income_level_name"}
    if hierarchy not in parents:
        raise ValueError(f"Countries are not grouped by {hierarchy}")
    predicate = country_members(f)
    countries = wh.dim_country if predicate is None else wh.dim_country.where(predicate)
    panel = wh.fact_country_year
    if f.start_year is not None:
        panel = panel.where(F.col("year") >= f.start_year)
    if f.end_year is not None:
        panel = panel.where(F.col("year") <= f.end_year)
    rows = group_year(wh, f, parents[hierarchy], countries, observed_years(panel, "year"))
    return rows.select(
        M.labelled(F.col("member")).alias("member"),
        "calendar_year",
        "full_publications",
        "fractional_publications",
        "population",
        "gdp_current_usd",
        "publications_per_million",
        "publications_per_billion_gdp",
        "countries",
        "population_countries",
        "gdp_countries",
    ).orderBy("calendar_year", F.desc("fractional_publications"), "member")
