"""Nested works and the panel, reconciled into nine natural-key tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmart.operators import nested as N
from pubmart.operators.merge import merge_entities
from pubmart.schemas import RECONCILED, RECONCILED_KEYS, UNCOVERED_PLACES


def _merged(rows: DataFrame, name: str) -> DataFrame:
    return merge_entities(rows, RECONCILED_KEYS[name], RECONCILED[name])


def panel_countries(panel: DataFrame) -> DataFrame:
    rows = panel.withColumn("has_indicator_data", F.lit(True))
    return _merged(rows.select(*RECONCILED["r_country"]).distinct(), "r_country")


def place_policy(spark, places=UNCOVERED_PLACES) -> DataFrame:
    schema = "country_code_iso2 STRING, country_code_iso3 STRING, country_name STRING"
    return spark.createDataFrame(list(places), schema)


def uncovered_codes(work_countries: DataFrame, master: DataFrame) -> DataFrame:
    """Country codes that works use and the panel does not cover."""
    used = work_countries.select("country_code_iso2").distinct()
    return used.join(master, "country_code_iso2", "left_anti")


def unrecognised_codes(uncovered: DataFrame, policy: DataFrame) -> DataFrame:
    return uncovered.join(policy, "country_code_iso2", "left_anti")


def completed_countries(master: DataFrame, uncovered: DataFrame, policy: DataFrame) -> DataFrame:
    """Panel countries plus the recognised uncovered places, without invented attributes."""
    added = policy.join(uncovered, "country_code_iso2", "left_semi").select(
        "country_code_iso2",
        "country_code_iso3",
        "country_name",
        *[F.lit(None).cast("string").alias(c) for c in RECONCILED["r_country"][3:7]],
        F.lit(False).alias("has_indicator_data"),
        F.array().cast("array<string>").alias("conflicts"),
    )
    return master.unionByName(added)


def reconcile(
    works: DataFrame,
    panel: DataFrame,
    policy: DataFrame,
    work_countries: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The nine tables, each with a ``conflicts`` column naming contradictory fields.

    ``works`` and ``panel`` are typed frames. Stage them as tables first: each is read by
    several of the nine, which then scan only the columns they need. ``work_countries`` takes
    the finished work-country pairs when they are staged already.
    """
    countries = N.work_countries(works) if work_countries is None else work_countries
    master = panel_countries(panel)
    indicator = panel.select(*RECONCILED["r_country_year_indicator"])
    no_conflict = F.array().cast("array<string>").alias("conflicts")
    return {
        "r_country": completed_countries(master, uncovered_codes(countries, master), policy),
        "r_topic": _merged(N.topic_entities(works), "r_topic"),
        "r_institution": _merged(N.institution_entities(works), "r_institution"),
        "r_source": _merged(N.source_entities(works), "r_source"),
        "r_work": _merged(N.work_rows(works), "r_work"),
        "r_work_topic": _merged(N.work_topics(works), "r_work_topic"),
        "r_work_country": countries.select("*", no_conflict),
        "r_work_institution": N.work_institutions(works).select("*", no_conflict),
        "r_country_year_indicator": indicator.select("*", no_conflict),
    }


def coverage_summary(countries: DataFrame) -> DataFrame:
    """Reconciled places, those with panel data, and the codes of those without.

    The list is bounded by the place policy.
    """
    covered = F.col("has_indicator_data")
    without = F.collect_list(F.when(~covered, F.col("country_code_iso2")))
    return countries.agg(
        F.count("*").alias("reconciled_places"),
        F.count_if(covered).alias("places_with_indicators"),
        F.sort_array(without).alias("places_without_indicators"),
    )
