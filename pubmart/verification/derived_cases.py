"""Second-step analyses on the driver's tables, with their SQL."""

from __future__ import annotations

from pubmart.plans import dashboard as D
from pubmart.plans import derived as V
from pubmart.plans.attribution import FRACTIONAL, FULL
from pubmart.schemas import INCOME_GROUPS
from pubmart.verification.case import Registry
from pubmart.verification.dashboard_cases import (
    CAPACITY_COLUMNS,
    CHANGE_COLUMNS,
    CHANGES,
    COUNTRY_YEAR_COLUMNS,
    NO_ID,
    NO_NAME,
    RANK_COLUMNS,
    RANKED,
    capacity_ctes,
    country_year_cte,
    hierarchy_ctes,
    on,
)
from pubmart.verification.selections import EVERYTHING, MIXED, PERIOD

_GROUPS = ", ".join(f"'{name}'" for name in INCOME_GROUPS)
_TREND = "trend AS (SELECT calendar_year, count(*) AS publications FROM filtered GROUP BY 1)"
_TYPES = f"""types AS (SELECT calendar_year, coalesce(publication_type, {NO_NAME}) AS publication_type, count(*) AS publications
  FROM filtered GROUP BY 1, 2)"""
_SOURCES = f"""sources AS (SELECT coalesce(source_id, {NO_ID}) AS source_id, coalesce(source_name, {NO_NAME}) AS source_name,
  coalesce(source_type, {NO_NAME}) AS source_type, count(*) AS publications
  FROM filtered LEFT JOIN dim_source USING (source_key) GROUP BY ALL)"""


def _trend(query):
    return lambda wh, f: query(D.publications_by_year(wh, f))


def _ranking(include_missing: bool):
    return lambda wh, f: V.source_ranking(D.source_output(wh, f, None), include_missing, 20)


def register(registry: Registry) -> None:
    add = registry.add
    for method, s in ((FULL, PERIOD), (FRACTIONAL, EVERYTHING)):
        add(
            f"topic_shares_{method.lower()}",
            on(V.topic_shares, s, method, "Subfield", 8),
            s.sql(
                *hierarchy_ctes(s, method, "topic", "Subfield", 8, True),
                _TREND,
                select="""SELECT member_id, member_name, calendar_year, round(led.publications, 6) AS publications,
                  trend.publications AS annual_publications, round(100 * led.publications / trend.publications, 6) AS annual_share
                FROM led LEFT JOIN trend USING (calendar_year)""",
            ),
        )
    add(
        "adjacent_year_growth",
        on(_trend(V.adjacent_year_growth), EVERYTHING),
        EVERYTHING.sql(
            """trend AS (SELECT calendar_year, count(*) AS publications, sum(citation_count)::BIGINT AS cumulative_citations,
              avg(citation_count) AS average_citations FROM filtered GROUP BY 1)""",
            select="""SELECT a.calendar_year, a.publications, a.cumulative_citations, round(a.average_citations, 6) AS average_citations,
              round(100e0 * (a.publications - b.publications) / b.publications, 6) AS year_over_year_growth
            FROM trend a LEFT JOIN trend b ON b.calendar_year = a.calendar_year - 1""",
        ),
    )
    add(
        "total_growth",
        on(_trend(V.total_growth), MIXED),
        MIXED.sql(
            _TREND,
            select="""SELECT min(calendar_year) AS first_year, max(calendar_year) AS last_year,
              round(100e0 * (arg_max(publications, calendar_year) - arg_min(publications, calendar_year))
                / arg_min(publications, calendar_year), 6) AS total_growth_pct FROM trend""",
        ),
    )
    add(
        "leading_types_over_time",
        on(V.leading_types_over_time, EVERYTHING, 4),
        EVERYTHING.sql(
            _TYPES,
            select="""SELECT calendar_year, publication_type, publications FROM types WHERE publication_type IN (
              SELECT publication_type FROM types GROUP BY 1 ORDER BY sum(publications) DESC, 1 LIMIT 4)""",
        ),
    )
    for include in (True, False):
        condition = "true" if include else f"source_id <> {NO_ID}"
        add(
            f"source_ranking_{'with' if include else 'without'}_missing",
            on(_ranking(include), PERIOD),
            PERIOD.sql(
                _SOURCES,
                select=f"""SELECT source_id, source_name, source_type, publications FROM sources WHERE {condition}
                ORDER BY publications DESC, source_name, source_id LIMIT 20""",
            ),
        )
    add(
        "missing_source_share",
        on(V.missing_source_share, EVERYTHING),
        EVERYTHING.sql(
            select="""SELECT count(*) FILTER (WHERE source_key IS NULL OR source_id IS NULL) AS missing_publications, count(*) AS publications,
              round(100e0 * count(*) FILTER (WHERE source_key IS NULL OR source_id IS NULL) / count(*), 6) AS missing_share
            FROM filtered LEFT JOIN dim_source USING (source_key)"""
        ),
    )
    add(
        "supported_ranks",
        on(V.supported_ranks, EVERYTHING, 1999, 300),
        EVERYTHING.sql(
            *country_year_cte(EVERYTHING),
            "supported AS (SELECT * FROM country_year WHERE calendar_year = 1999 AND full_publications >= 300)",
            RANKED.format(source="supported"),
            select=f"""SELECT country_name, full_publications, round(fractional_publications, 6) AS fractional_publications,
              {RANK_COLUMNS} FROM ranked""",
        ),
    )
    for metric in ("publications_per_million", "publications_per_billion_gdp"):
        add(
            f"normalised_snapshot_{metric.split('_')[-1]}",
            on(V.normalised_snapshot, MIXED, 1999, metric, 5, 10),
            MIXED.sql(
                *country_year_cte(MIXED),
                f"""top AS (SELECT * FROM country_year WHERE calendar_year = 1999 AND full_publications >= 5 AND {metric} IS NOT NULL
                  ORDER BY {metric} DESC, country_name, country_code_iso2 LIMIT 10)""",
                select=f"SELECT {COUNTRY_YEAR_COLUMNS} FROM top",
            ),
        )
    add(
        "compared_countries",
        on(V.compared_countries, PERIOD, ("AA", "AD", "AK", "AY"), "publications_per_million", 30),
        PERIOD.sql(
            *country_year_cte(PERIOD),
            select=f"""SELECT {COUNTRY_YEAR_COLUMNS} FROM country_year WHERE full_publications >= 30
              AND country_code_iso2 IN ('AA', 'AD', 'AK', 'AY') AND publications_per_million IS NOT NULL""",
        ),
    )
    add(
        "income_group_shares",
        on(V.income_group_shares, EVERYTHING),
        EVERYTHING.sql(
            *capacity_ctes(EVERYTHING, "income_level_name"),
            select=f"""SELECT {CAPACITY_COLUMNS}, round(100 * fractional_publications
              / sum(fractional_publications) OVER (PARTITION BY calendar_year), 6) AS fractional_share
            FROM capacity WHERE member IN ({_GROUPS})""",
        ),
    )
    add(
        "unclassified_output",
        on(V.unclassified_output, PERIOD),
        PERIOD.sql(
            *capacity_ctes(PERIOD, "income_level_name"),
            select=f"SELECT round(sum(fractional_publications), 6) AS fractional_publications FROM capacity WHERE member = {NO_NAME}",
        ),
    )
    for view, indicator in V.PAIRED_INDICATORS.items():
        columns = COUNTRY_YEAR_COLUMNS.replace(
            "income_level_name,", f"coalesce(income_level_name, {NO_NAME}) AS income_level_name,"
        )
        add(
            f"paired_snapshot_{indicator.split('_')[0]}",
            on(V.paired_snapshot, EVERYTHING, view, 1999, 30),
            EVERYTHING.sql(
                *country_year_cte(EVERYTHING),
                select=f"""SELECT {columns} FROM country_year WHERE calendar_year = 1999 AND full_publications >= 30
                  AND {indicator} IS NOT NULL AND publications_per_million IS NOT NULL""",
            ),
        )
    for view, change in V.PAIRED_CHANGES.items():
        add(
            f"paired_changes_{change.split('_')[0]}",
            on(V.paired_changes, PERIOD, view),
            PERIOD.sql(
                *country_year_cte(PERIOD),
                CHANGES,
                select=f"SELECT {CHANGE_COLUMNS} FROM changes WHERE {change} IS NOT NULL AND output_change IS NOT NULL",
            ),
        )
