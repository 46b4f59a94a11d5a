"""Warehouse tables from the reconciled tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.functions import measures as M
from pubmart.operators.keys import ordered_keys
from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import BRIDGES, BY_YEAR, STORED_YEAR, RECONCILED, WAREHOUSE


def dim_date(r: Mapping[str, DataFrame]) -> DataFrame:
    """Observed dates only."""
    day = F.col("full_date")
    days = r["r_work"].select(F.col("publication_date").alias("full_date"))
    return days.where(day.isNotNull()).distinct().select(
        M.date_key(day).alias("date_key"),
        "full_date",
        F.dayofmonth(day).alias("day_of_month"),
        F.month(day).alias("month_number"),
        F.quarter(day).alias("quarter_number"),
        F.year(day).alias("calendar_year"),
    )


def dim_country(r: Mapping[str, DataFrame]) -> DataFrame:
    rows = r["r_country"].select(*RECONCILED["r_country"])
    return ordered_keys(rows, ("country_code_iso2",), "country_key")


def dim_topic(r: Mapping[str, DataFrame]) -> DataFrame:
    return ordered_keys(r["r_topic"].select(*RECONCILED["r_topic"]), ("topic_id",), "topic_key")


def dim_institution(r: Mapping[str, DataFrame]) -> DataFrame:
    rows = r["r_institution"].select(*RECONCILED["r_institution"])
    rows = rows.withColumnRenamed("display_name", "institution_name")
    return ordered_keys(rows, ("institution_id",), "institution_key")


def dim_source(r: Mapping[str, DataFrame]) -> DataFrame:
    rows = r["r_source"].select(*RECONCILED["r_source"])
    rows = rows.withColumnRenamed("display_name", "source_name")
    return ordered_keys(rows, ("source_id",), "source_key")


def fact_publication(r: Mapping[str, DataFrame], sources: DataFrame) -> DataFrame:
    """One row per work. The date key is computed, so only the source is looked up.

    Works without a source skip the lookup: as NULL keys they would all meet in one partition.
    """
    works = r["r_work"].select(
        "work_id",
        M.date_key(F.col("publication_date")).alias("date_key"),
        F.year("publication_date").alias(STORED_YEAR),
        "source_id",
        F.col("work_type").alias("publication_type"),
        "language",
        "is_open_access",
        F.lit(1).cast("smallint").alias("publication_count"),
        F.col("cited_by_count").alias("citation_count"),
    )
    keys = sources.select("source_id", "source_key")
    known = works.where(F.col("source_id").isNotNull()).join(keys, "source_id", "left")
    unknown = works.where(F.col("source_id").isNull()).withColumn("source_key", F.lit(None).cast("bigint"))
    return ordered_keys(known.unionByName(unknown).drop("source_id"), ("work_id",), "publication_key")


def fact_country_year(r: Mapping[str, DataFrame], countries: DataFrame) -> DataFrame:
    keys = countries.select("country_code_iso2", "country_key")
    rows = r["r_country_year_indicator"].join(keys, "country_code_iso2")
    return ordered_keys(rows, ("country_code_iso2", "year"), "country_year_key")


_PUBLICATION = ("work_id", "publication_key", STORED_YEAR)


def _bridge(
    pairs: DataFrame,
    publications: DataFrame,
    members: DataFrame,
    member_id: str,
    of_pairs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Pairs with surrogate keys and weight 1/n.

    The number of members is attached to the publication, by the key both sides are shuffled
    on anyway; a window over the pairs would hold all pairs of one work in one task. ``of_pairs``
    are columns made of a pair and its publication, before the rows are shuffled to the members.
    """
    counts = pairs.groupBy("work_id").agg(F.count("*").alias("members"))
    publications = publications.join(counts, "work_id")
    rows = pairs.join(publications, "work_id").withColumns(of_pairs or {}).join(members, member_id)
    return rows.withColumn("fractional_weight", F.lit(1.0) / F.col("members"))


def bridge_publication_topic(
    r: Mapping[str, DataFrame], publications: DataFrame, topics: DataFrame
) -> DataFrame:
    primary = r["r_work"].select("work_id", "primary_topic_id")
    keys = publications.select(*_PUBLICATION).join(primary, "work_id")
    members = topics.select("topic_id", "topic_key")
    is_primary = F.coalesce(F.col("topic_id") == F.col("primary_topic_id"), F.lit(False))
    return _bridge(r["r_work_topic"], keys, members, "topic_id", {"is_primary_topic": is_primary})


def bridge_publication_country(
    r: Mapping[str, DataFrame], publications: DataFrame, countries: DataFrame
) -> DataFrame:
    keys = publications.select(*_PUBLICATION)
    members = countries.select("country_code_iso2", "country_key")
    return _bridge(r["r_work_country"], keys, members, "country_code_iso2")


def bridge_publication_institution(
    r: Mapping[str, DataFrame], publications: DataFrame, institutions: DataFrame
) -> DataFrame:
    keys = publications.select(*_PUBLICATION)
    members = institutions.select("institution_id", "institution_key")
    return _bridge(r["r_work_institution"], keys, members, "institution_id")


# Builder of each table and the warehouse tables it looks keys up in.
BUILDERS = {
    "dim_date": (dim_date, ()),
    "dim_country": (dim_country, ()),
    "dim_topic": (dim_topic, ()),
    "dim_institution": (dim_institution, ()),
    "dim_source": (dim_source, ()),
    "fact_publication": (fact_publication, ("dim_source",)),
    "fact_country_year": (fact_country_year, ("dim_country",)),
    "bridge_publication_topic": (bridge_publication_topic, ("fact_publication", "dim_topic")),
    "bridge_publication_country": (bridge_publication_country, ("fact_publication", "dim_country")),
    "bridge_publication_institution": (
        bridge_publication_institution,
        ("fact_publication", "dim_institution"),
    ),
}


def stored_columns(name: str) -> tuple[str, ...]:
    return (*WAREHOUSE[name], STORED_YEAR) if name in BY_YEAR else WAREHOUSE[name]


def with_years(wh: Warehouse) -> dict[str, DataFrame]:
    """The tables of a warehouse that was not stored by year, with the year that its folders need."""
    tables = wh.tables()
    facts = tables["fact_publication"].withColumn(STORED_YEAR, M.year_of(F.col("date_key")))
    years = facts.select("publication_key", STORED_YEAR)
    bridges = {name: tables[name].join(years, "publication_key", "left") for name in BRIDGES}
    return {**tables, "fact_publication": facts, **bridges}


def build_warehouse(r: Mapping[str, DataFrame], stage=None) -> Warehouse:
    """All ten tables in dependency order; the fact and the bridges also carry the publication's year.

    ``stage(name, rows)`` writes a finished table and gives back the frame to go on with, so
    that later tables look keys up in what was written.
    """
    built: dict[str, DataFrame] = {}
    for name, (builder, lookups) in BUILDERS.items():
        rows = builder(r, *[built[lookup] for lookup in lookups]).select(*stored_columns(name))
        built[name] = stage(name, rows) if stage else rows
    return Warehouse(built)
