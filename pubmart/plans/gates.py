"""Which checks the reconciled tables, the warehouse and a ready installation must pass."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.functions.text import is_country_code
from pubmart.operators import checks as C
from pubmart.schemas import (
    BRIDGES,
    END_YEAR,
    MEASURES,
    RECONCILED_KEYS,
    RECONCILED_REFERENCES,
    START_YEAR,
    WAREHOUSE,
    WAREHOUSE_KEYS,
    WAREHOUSE_REFERENCES,
    WAREHOUSE_SOURCES,
    YEARS,
)


def _codes() -> Column:
    iso2, iso3 = F.col("country_code_iso2"), F.col("country_code_iso3")
    return is_country_code(iso2, 2) & is_country_code(iso3, 3)


def fabricated_indicators(
    indicators: DataFrame, countries: DataFrame, key: str, relation: str
) -> DataFrame:
    """Panel rows of places that have no panel data."""
    without = countries.where(~F.col("has_indicator_data")).select(key)
    found = indicators.join(without, key, "left_semi")
    return C.holds(found, "fabricated indicator", relation, F.lit(False))


def primary_topic_membership(works: DataFrame, work_topics: DataFrame) -> DataFrame:
    """Works whose primary topic is not among their topics."""
    primary = works.where(F.col("primary_topic_id").isNotNull()).select(
        "work_id", F.col("primary_topic_id").alias("topic_id")
    )
    lost = primary.join(work_topics.select("work_id", "topic_id"), ["work_id", "topic_id"], "left_anti")
    return C.holds(lost, "primary topic among topics", "r_work", F.lit(False))


def reconciled_checks(r: Mapping[str, DataFrame], panel: DataFrame | None = None) -> DataFrame:
    """Keys, references and row rules of the nine tables; NULL parity when the panel is given."""
    work, country, indicator = r["r_work"], r["r_country"], r["r_country_year_indicator"]
    year = F.col("publication_year")
    rules = {name: {"missing value": C.present(key)} for name, key in RECONCILED_KEYS.items()}
    rules["r_country"]["country codes"] = _codes()
    rules["r_work"]["citations not negative"] = F.col("cited_by_count") >= 0
    rules["r_work"]["year range"] = year.between(1, 9999)
    rules["r_work"]["date and year agree"] = F.year("publication_date") == year
    rules["r_work_topic"]["rank positive"] = F.col("topic_rank") > 0
    rules["r_country_year_indicator"]["year range"] = F.col("year").between(1, 9999)
    found = [C.not_empty(r[name], name) for name in ("r_work", "r_country", "r_country_year_indicator")]
    found += [C.row_rules(r[name], name, checks) for name, checks in rules.items()]
    found += C.table_checks(r, RECONCILED_KEYS, RECONCILED_REFERENCES)
    found += [
        C.duplicate_keys(country, "r_country.country_code_iso3", ("country_code_iso3",)),
        primary_topic_membership(work, r["r_work_topic"]),
        fabricated_indicators(indicator, country, "country_code_iso2", "r_country_year_indicator"),
    ]
    if panel is not None:
        found += [
            C.same_count(indicator, panel, "r_country_year_indicator"),
            C.same_nulls(indicator, panel, "r_country_year_indicator", MEASURES),
        ]
    return C.all_checks(found)


def primary_markers(bridge: DataFrame, publications: DataFrame, topics: DataFrame, works: DataFrame) -> DataFrame:
    """Bridge rows whose primary marker differs from the work's primary topic."""
    rows = (
        bridge.join(publications.select("publication_key", "work_id"), "publication_key")
        .join(topics.select("topic_key", "topic_id"), "topic_key")
        .join(works.select("work_id", "primary_topic_id"), "work_id")
    )
    expected = F.coalesce(F.col("topic_id") == F.col("primary_topic_id"), F.lit(False))
    return C.holds(
        rows, "primary marker parity", "bridge_publication_topic", F.col("is_primary_topic") == expected
    )


def warehouse_checks(
    w: Mapping[str, DataFrame],
    r: Mapping[str, DataFrame],
    first: int = START_YEAR,
    last: int = END_YEAR,
) -> DataFrame:
    """Counts, keys, measures, references, weights and markers against the reconciled tables."""
    work, indicator = r["r_work"], r["r_country_year_indicator"]
    fact, panel = w["fact_publication"], w["fact_country_year"]
    topic_bridge = w["bridge_publication_topic"]
    days = work.where(F.col("publication_date").isNotNull()).select("publication_date").distinct()
    found = [C.same_count(w["dim_date"], days, "dim_date")]
    found += [C.same_count(w[name], r[source], name) for name, source in WAREHOUSE_SOURCES.items()]
    found += C.table_checks(w, WAREHOUSE_KEYS, WAREHOUSE_REFERENCES)
    source_works = work.select(
        "work_id", F.col("cited_by_count").alias("citation_count"), "is_open_access"
    )
    panel_codes = panel.join(w["dim_country"].select("country_key", "country_code_iso2"), "country_key")
    weight = F.col("fractional_weight")
    rules = {name: {"weight range": (weight > 0) & (weight <= 1)} for name in BRIDGES}
    rules["bridge_publication_topic"]["rank positive"] = F.col("topic_rank") > 0
    rules["dim_country"] = {"country codes": _codes()}
    rules["fact_publication"] = {
        "counted once": F.col("publication_count") == 1,
        "citations not negative": F.col("citation_count") >= 0,
    }
    rules["fact_country_year"] = {"year range": F.col("year").between(first, last)}
    found += [C.row_rules(w[name], name, checks) for name, checks in rules.items()]
    found += [C.weight_sums(w[name], name) for name in BRIDGES]
    found += [
        C.same_values(
            fact, source_works, "fact_publication", ("work_id",), ("citation_count", "is_open_access")
        ),
        C.same_values(
            panel_codes, indicator, "fact_country_year", ("country_code_iso2", "year"), MEASURES
        ),
        fabricated_indicators(panel, w["dim_country"], "country_key", "fact_country_year"),
        primary_markers(topic_bridge, fact, w["dim_topic"], work),
        C.same_count(
            topic_bridge.where("is_primary_topic"),
            work.where(F.col("primary_topic_id").isNotNull()),
            "bridge_publication_topic.is_primary_topic",
        ),
    ]
    return C.all_checks(found)


# Leftovers of an older model that a ready warehouse must not have.
OBSOLETE_TABLES = ("dim_year",)
OBSOLETE_COLUMNS = {"fact_country_year": ("year_key",), "fact_publication": ("open_access_status",)}


def readiness_problems(tables: Mapping[str, DataFrame], years: Iterable[int] = YEARS) -> list[str]:
    """What keeps a warehouse from being queried; empty when it is ready."""
    found = C.missing_columns(tables, WAREHOUSE)
    found += [f"{name} is obsolete" for name in OBSOLETE_TABLES if name in tables]
    for name, columns in OBSOLETE_COLUMNS.items():
        present = tables[name].columns if name in tables else []
        found += [f"{name}.{column} is obsolete" for column in columns if column in present]
    if found:
        return found
    found = [
        f"{name} is empty" for name in ("fact_publication", *BRIDGES) if tables[name].isEmpty()
    ]
    wanted = list(years)
    panel_years = tables["fact_country_year"].where(F.col("year").isin(wanted)).select("year").distinct()
    covered = {row.year for row in panel_years.collect()}  # at most the wanted years
    absent = [str(year) for year in wanted if year not in covered]
    return found + ([f"fact_country_year lacks years {', '.join(absent)}"] if absent else [])


