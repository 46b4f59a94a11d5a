"""Queries on a warehouse stored in year folders and buckets, against the same SQL as in memory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pubmart.plans import dashboard as D
from pubmart.plans.attribution import FRACTIONAL, FULL, hierarchy_output
from pubmart.plans.build import with_years
from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import BY_YEAR
from pubmart.session import ensure_checkpoint_dir
from pubmart.sources.releases import Release
from pubmart.verification.case import Registry
from pubmart.verification.dashboard_cases import country_sql, hierarchy_sql
from pubmart.verification.roles import role_warehouse, table
from pubmart.verification.selections import EVERYTHING, MIXED, PERIOD


BUCKET_ROWS = 1_000_000


def buckets_for(tables: list[DataFrame], least: int, each: int = BUCKET_ROWS) -> int:
    """So many buckets that the largest table has about ``each`` rows in one, ``least`` of them at least."""
    return max(least, -(-max(rows.count() for rows in tables) // each))


def stored_by_year(spark: SparkSession, sf_dir: str, *names: str, buckets: int | None = None) -> Warehouse:
    """The roles with the named relations' bridges and the fact written in folders by year, and in
    ``buckets`` buckets, or in more where these would hold too many rows for a task."""
    ensure_checkpoint_dir(spark)
    if buckets:
        # the bridges are distinct pairs of line items, which are counted without making the pairs
        buckets = buckets_for([table(spark, sf_dir, name) for name in ("orders", "lineitem")], buckets)
    release = Release(spark, f"{spark.sparkContext.getCheckpointDir()}/by-year-{uuid.uuid4().hex}", buckets)
    tables = with_years(role_warehouse(spark, sf_dir))
    wanted = [n for n in BY_YEAR if n == "fact_publication" or n.removeprefix("bridge_publication_") in names]
    return Warehouse({**tables, **{n: release.stage(n, tables[n], ("publication_key",)) for n in wanted}})


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "by_year_country_output",
        lambda spark, sf_dir: D.country_output(stored_by_year(spark, sf_dir, "country"), PERIOD.state, FRACTIONAL),
        country_sql(PERIOD, FRACTIONAL),
    )
    add(
        "by_year_bucketed_subfields",
        lambda spark, sf_dir: hierarchy_output(
            stored_by_year(spark, sf_dir, "country", "topic", "institution", buckets=4), MIXED.state, FULL, "topic", "Subfield"
        ),
        hierarchy_sql(MIXED, FULL, "topic", "Subfield"),
    )
    add(
        "by_year_undated_kept",
        lambda spark, sf_dir: D.country_output(stored_by_year(spark, sf_dir, "country"), EVERYTHING.state, FULL),
        country_sql(EVERYTHING, FULL),
    )
