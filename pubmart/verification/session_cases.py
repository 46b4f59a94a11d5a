"""The OLAP sessions on the driver's tables, with their SQL."""

from __future__ import annotations

from pubmart.plans import sessions as S
from pubmart.verification.case import Registry
from pubmart.verification.dashboard_cases import dense_growth
from pubmart.verification.roles import ROLE_SQL, role_warehouse

FIRST, LAST = 1995, 2001
_MISSING = "'Missing / unavailable'"


def _sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([ROLE_SQL.strip(), *ctes]) + "\n" + select


def _on(query, *args, **kwargs):
    return lambda spark, sf_dir: query(role_warehouse(spark, sf_dir), *args, **kwargs)


def _dense(months: int, first: int, last: int) -> str:
    ctes, select = dense_growth(months, "picked")
    return _sql(
        f"picked AS (SELECT full_date FROM fact_publication WHERE calendar_year BETWEEN {first} AND {last})", *ctes, select=select
    )


_COUNTRY_YEAR = f"""country_year AS (
  SELECT calendar_year, country_key, country_code_iso2, country_code_iso3,
         coalesce(country_name, country_code_iso2) AS country_name, region_name, income_level_name,
         count(*) AS full_publications, round(sum(fractional_weight), 9) AS fractional_publications
  FROM fact_publication JOIN bridge_publication_country USING (publication_key) JOIN dim_country USING (country_key)
  WHERE calendar_year BETWEEN {FIRST} AND {LAST} GROUP BY ALL)"""
_PANEL_JOIN = """normalised AS (
  SELECT cy.*, population, gdp_current_usd, gdp_per_capita_current_usd,
         fractional_publications * 1e6 / nullif(population, 0) AS per_million,
         fractional_publications * 1e9 / nullif(gdp_current_usd, 0) AS per_billion
  FROM country_year cy LEFT JOIN fact_country_year f ON f.country_key = cy.country_key AND f.year = cy.calendar_year)"""
_PLACE = "country_code_iso2, country_code_iso3, country_name, region_name, income_level_name"


def _leadership(minimum: int) -> str:
    return _sql(
        _COUNTRY_YEAR,
        _PANEL_JOIN,
        select=f"""SELECT calendar_year, rank() OVER (PARTITION BY calendar_year ORDER BY per_million DESC) AS normalized_rank,
          {_PLACE}, full_publications, round(fractional_publications, 3) AS fractional_publications, population,
          round(per_million, 3) AS publications_per_million
        FROM normalised WHERE full_publications >= {minimum} AND per_million IS NOT NULL""",
    )


def _wealth(minimum: int) -> str:
    return _sql(
        _COUNTRY_YEAR,
        _PANEL_JOIN,
        select=f"""SELECT calendar_year, country_code_iso2, country_code_iso3, country_name, region_name,
          coalesce(income_level_name, {_MISSING}) AS income_level_name, full_publications,
          round(fractional_publications, 3) AS fractional_publications, population,
          round(gdp_per_capita_current_usd, 2) AS gdp_per_capita_current_usd,
          round(per_million, 3) AS publications_per_million,
          count(*) OVER (PARTITION BY calendar_year) AS complete_country_pairs
        FROM normalised WHERE full_publications >= {minimum} AND per_million IS NOT NULL
          AND gdp_per_capita_current_usd IS NOT NULL""",
    )


_INCOME = "('High income', 'Upper middle income', 'Lower middle income', 'Low income')"


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "yearly_growth",
        _on(S.yearly_growth, FIRST, LAST),
        _sql(
            f"counts AS (SELECT calendar_year, count(*) AS n FROM fact_publication WHERE calendar_year BETWEEN {FIRST} AND {LAST} GROUP BY 1)",
            select="SELECT calendar_year, n AS publications, round(100e0 * (n - lag(n) OVER (ORDER BY calendar_year)) "
            "/ nullif(lag(n) OVER (ORDER BY calendar_year), 0), 6) AS year_over_year_growth_pct FROM counts",
        ),
    )
    add("quarterly_growth", _on(S.quarterly_growth, 1998, LAST), _dense(3, 1998, LAST))
    add("monthly_growth", _on(S.monthly_growth, 2000, 2000), _dense(1, 2000, 2000))
    add(
        "type_by_year",
        _on(S.type_by_year, FIRST, LAST),
        _sql(
            select=f"""SELECT calendar_year, coalesce(publication_type, {_MISSING}) AS publication_type, count(*) AS publications
            FROM fact_publication WHERE calendar_year BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2"""
        ),
    )
    add(
        "access_by_year",
        _on(S.access_by_year, FIRST, LAST),
        _sql(
            select=f"""SELECT calendar_year, CASE WHEN is_open_access IS TRUE THEN 'Open Access'
              WHEN is_open_access IS FALSE THEN 'Not Open Access' ELSE {_MISSING} END AS open_access, count(*) AS publications
            FROM fact_publication WHERE calendar_year BETWEEN {FIRST} AND {LAST} GROUP BY calendar_year, is_open_access"""
        ),
    )
    ranked = """ranked AS (SELECT *, rank() OVER (PARTITION BY calendar_year ORDER BY full_publications DESC) AS full_rank,
      rank() OVER (PARTITION BY calendar_year ORDER BY fractional_publications DESC) AS fractional_rank FROM country_year)"""
    add(
        "country_full_ranks",
        _on(S.country_full_ranks, FIRST, LAST),
        _sql(_COUNTRY_YEAR, ranked, select=f"SELECT calendar_year, {_PLACE}, full_publications, full_rank FROM ranked"),
    )
    add(
        "country_fractional_ranks",
        _on(S.country_fractional_ranks, FIRST, LAST),
        _sql(
            _COUNTRY_YEAR,
            ranked,
            select=f"SELECT calendar_year, {_PLACE}, round(fractional_publications, 6) AS fractional_publications, fractional_rank FROM ranked",
        ),
    )
    add(
        "country_rank_comparison",
        _on(S.country_rank_comparison, FIRST, LAST),
        _sql(
            _COUNTRY_YEAR,
            ranked,
            select=f"""SELECT calendar_year, {_PLACE}, full_publications, round(fractional_publications, 6) AS fractional_publications,
              full_rank, fractional_rank, full_rank - fractional_rank AS rank_shift FROM ranked""",
        ),
    )
    add("normalised_leadership", _on(S.normalised_leadership, FIRST, LAST), _leadership(30))
    add(
        "normalised_leadership_high_support",
        _on(S.normalised_leadership, FIRST, LAST, 250),
        _leadership(250),
    )
    add("wealth_and_intensity", _on(S.wealth_and_intensity, FIRST, LAST), _wealth(30))
    add(
        "wealth_and_intensity_high_support",
        _on(S.wealth_and_intensity, FIRST, LAST, 250),
        _wealth(250),
    )
    add(
        "income_level_gap",
        _on(S.income_level_gap, FIRST, LAST + 1),
        _sql(
            f"""cell AS (SELECT c.country_key, c.income_level_name AS level, y AS year,
              coalesce((SELECT round(sum(w.fractional_weight), 9) FROM fact_publication p JOIN bridge_publication_country w USING (publication_key)
                WHERE w.country_key = c.country_key AND p.calendar_year = y), 0) AS own,
              (SELECT max(i.population) FROM fact_country_year i WHERE i.country_key = c.country_key AND i.year = y AND i.population > 0) AS people
              FROM dim_country c, (SELECT unnest(range({FIRST}, {LAST + 2})) AS y) WHERE c.income_level_name IN {_INCOME})""",
            """heard AS (SELECT DISTINCT c.income_level_name AS level, calendar_year AS year, publication_key FROM fact_publication
              JOIN bridge_publication_country USING (publication_key) JOIN dim_country c USING (country_key))""",
            """level_year AS (SELECT level, year, round(sum(own), 9) AS own, round(sum(own * (people IS NOT NULL)::INT), 9) AS beside_people,
              sum(people) AS people, count(*) AS countries, count(people) AS population_countries FROM cell GROUP BY level, year)""",
            select="""SELECT year AS calendar_year, level AS income_level,
              (SELECT count(*) FROM heard h WHERE h.level = l.level AND h.year = l.year) AS full_publications,
              round(own, 3) AS fractional_publications,
              round(sum(own) OVER (PARTITION BY year), 3) AS annual_known_fractional_publications,
              round(100 * own / nullif(round(sum(own) OVER (PARTITION BY year), 9), 0), 2) AS fractional_share_pct,
              round(CASE WHEN people IS NOT NULL THEN beside_people END, 3) AS matched_fractional_publications, people::BIGINT AS matched_population,
              round(1e6 * beside_people / people, 3) AS publications_per_million, countries, population_countries FROM level_year l""",
        ),
    )
    add(
        "topic_annual_leaders",
        _on(S.topic_annual_leaders, FIRST, LAST),
        _sql(
            f"picked AS (SELECT * FROM fact_publication WHERE calendar_year BETWEEN {FIRST} AND {LAST})",
            "topic_year AS (SELECT topic_id, coalesce(topic_name, topic_id) AS topic_name, calendar_year, count(*) AS n FROM picked "
            "JOIN bridge_publication_topic USING (publication_key) JOIN dim_topic USING (topic_key) GROUP BY ALL)",
            "leaders AS (SELECT topic_id, sum(n)::BIGINT AS total FROM topic_year GROUP BY 1 ORDER BY total DESC, topic_id LIMIT 4)",
            "annual AS (SELECT calendar_year, count(*) AS m FROM picked GROUP BY 1)",
            select="""SELECT calendar_year, topic_id, topic_name, total AS cumulative_publications, n AS topic_publications,
              m AS annual_publications, round(100e0 * n / m, 2) AS annual_share_pct
            FROM topic_year JOIN leaders USING (topic_id) JOIN annual USING (calendar_year)""",
        ),
    )
    add(
        "smoke_year_trend",
        _on(S.smoke_year_trend),
        _sql(
            select="""SELECT calendar_year, count(*) AS publication_count, sum(citation_count)::BIGINT AS citation_count
            FROM fact_publication WHERE calendar_year IS NOT NULL GROUP BY 1"""
        ),
    )
    add(
        "smoke_countries",
        _on(S.smoke_countries),
        _sql(
            select="""SELECT country_code_iso2, country_name, region_name, income_level_name, count(*) AS publication_count
            FROM fact_publication JOIN bridge_publication_country USING (publication_key) JOIN dim_country USING (country_key)
            GROUP BY ALL"""
        ),
    )
    add(
        "smoke_topics",
        _on(S.smoke_topics),
        _sql(
            select="""SELECT topic_id, topic_name, subfield_name, count(*) AS publication_count
            FROM fact_publication JOIN bridge_publication_topic USING (publication_key) JOIN dim_topic USING (topic_key)
            GROUP BY ALL"""
        ),
    )
    add(
        "smoke_institution_types",
        _on(S.smoke_institution_types),
        _sql(
            select="""SELECT institution_type, count(DISTINCT publication_key) AS publication_count
            FROM fact_publication JOIN bridge_publication_institution USING (publication_key)
            JOIN dim_institution USING (institution_key) GROUP BY 1"""
        ),
    )
    add(
        "smoke_source_types",
        _on(S.smoke_source_types),
        _sql(
            select="""SELECT coalesce(source_type, '<missing>') AS source_type, count(*) AS publication_count
            FROM fact_publication LEFT JOIN dim_source USING (source_key) GROUP BY 1"""
        ),
    )
    add(
        "smoke_publication_types",
        _on(S.smoke_publication_types),
        _sql(select="SELECT publication_type, count(*) AS publication_count FROM fact_publication GROUP BY 1"),
    )
    add(
        "smoke_country_year",
        _on(S.smoke_country_year),
        _sql(
            """country_year AS (
              SELECT country_key, country_code_iso2, country_name, calendar_year, round(sum(fractional_weight), 9) AS fractional_publications
              FROM fact_publication JOIN bridge_publication_country USING (publication_key) JOIN dim_country USING (country_key)
              WHERE calendar_year IS NOT NULL GROUP BY ALL)""",
            _PANEL_JOIN,
            select="""SELECT country_code_iso2, country_name, calendar_year, round(fractional_publications, 6) AS publication_count,
              population, gdp_current_usd, round(per_million, 6) AS publications_per_million_inhabitants,
              round(per_billion, 6) AS publications_per_billion_usd_gdp FROM normalised""",
        ),
    )
