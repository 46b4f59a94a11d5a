"""Reconciliation and warehouse build on records made from the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pubmart.plans import build as B
from pubmart.plans import gates
from pubmart.plans.reconcile import coverage_summary
from pubmart.schemas import BRIDGES, RECONCILED, WAREHOUSE, WAREHOUSE_SOURCES
from pubmart.verification.case import Registry
from pubmart.verification.raw_roles import BROKEN_SQL, RAW_SQL, broken_works, record_problems, role_reconciled, staged

_TYPES = {
    "publication_date": "publication_date::VARCHAR",
    "full_date": "full_date::VARCHAR",
    "is_open_access": "is_open_access::VARCHAR",
    "has_indicator_data": "has_indicator_data::VARCHAR",
    "is_primary_topic": "is_primary_topic::VARCHAR",
    "fractional_weight": "round(fractional_weight, 6)",
}


def _columns(names) -> str:
    return ", ".join(f"{_TYPES[n]} AS {n}" if n in _TYPES else n for n in names)


def _reconciled(name: str):
    return lambda spark, sf_dir: role_reconciled(spark, sf_dir)[name]


def _built(name: str):
    def build(spark, sf_dir):
        reconciled, done = role_reconciled(spark, sf_dir), {}
        if name in BRIDGES:
            # a bridge reads the works and its pairs several times: merged once and staged, as a load does
            for relation in ("r_work", WAREHOUSE_SOURCES[name]):
                reconciled[relation] = staged(spark, sf_dir, relation, partial(reconciled.get, relation))

        def make(table: str):
            if table not in done:
                builder, lookups = B.BUILDERS[table]
                done[table] = builder(reconciled, *[make(lookup) for lookup in lookups])
            return done[table]

        return make(name).select(*WAREHOUSE[name])

    return build


def _bridge_sql(relation: str, member: str, dim: str, key: str, extra: str = "") -> str:
    return f"""SELECT publication_key, {key}{extra}, 1e0 / count(*) OVER (PARTITION BY b.work_id) AS fractional_weight
      FROM {relation} b JOIN built_fact f ON f.work_id = b.work_id JOIN {dim} d ON d.{member} = b.{member}"""


BUILT_SQL = (
    RAW_SQL
    + """,
built_date AS (SELECT DISTINCT year(publication_date) * 10000 + month(publication_date) * 100 + day(publication_date) AS date_key,
  publication_date AS full_date, day(publication_date) AS day_of_month, month(publication_date) AS month_number,
  quarter(publication_date) AS quarter_number, year(publication_date) AS calendar_year FROM r_work WHERE publication_date IS NOT NULL),
built_country AS (SELECT row_number() OVER (ORDER BY country_code_iso2) AS country_key, * FROM r_country),
built_topic AS (SELECT row_number() OVER (ORDER BY topic_id) AS topic_key, * FROM r_topic),
built_institution AS (SELECT row_number() OVER (ORDER BY institution_id) AS institution_key, institution_id,
  display_name AS institution_name, institution_type, country_code_iso2 FROM r_institution),
built_source AS (SELECT row_number() OVER (ORDER BY source_id) AS source_key, source_id, display_name AS source_name,
  source_type, issn_l FROM r_source),
built_fact AS (SELECT row_number() OVER (ORDER BY work_id) AS publication_key, work_id, primary_topic_id,
  year(publication_date) * 10000 + month(publication_date) * 100 + day(publication_date) AS date_key, source_key,
  work_type AS publication_type, language, is_open_access, 1::BIGINT AS publication_count, cited_by_count AS citation_count
  FROM r_work LEFT JOIN built_source USING (source_id)),
built_country_year AS (SELECT row_number() OVER (ORDER BY country_code_iso2, year) AS country_year_key, country_key, i.*
  FROM r_country_year_indicator i JOIN built_country USING (country_code_iso2)),
built_topic_bridge AS ("""
    + _bridge_sql(
        "r_work_topic",
        "topic_id",
        "built_topic",
        "topic_key",
        ", topic_rank, topic_score, coalesce(b.topic_id = f.primary_topic_id, false) AS is_primary_topic",
    )
    + "),\nbuilt_country_bridge AS ("
    + _bridge_sql("r_work_country", "country_code_iso2", "built_country", "country_key")
    + "),\nbuilt_institution_bridge AS ("
    + _bridge_sql("r_work_institution", "institution_id", "built_institution", "institution_key")
    + ")"
)
_BUILT = {
    "dim_date": "built_date",
    "dim_country": "built_country",
    "dim_topic": "built_topic",
    "dim_institution": "built_institution",
    "dim_source": "built_source",
    "fact_publication": "built_fact",
    "fact_country_year": "built_country_year",
    "bridge_publication_topic": "built_topic_bridge",
    "bridge_publication_country": "built_country_bridge",
    "bridge_publication_institution": "built_institution_bridge",
}


def _checks(spark, sf_dir):
    return gates.reconciled_checks(role_reconciled(spark, sf_dir))


def register(registry: Registry) -> None:
    add = registry.add
    for name, columns in RECONCILED.items():
        add(
            f"reconciled_{name}",
            _reconciled(name),
            f"WITH {RAW_SQL}\nSELECT {_columns(columns)} FROM {name}",
        )
    add(
        "coverage_summary",
        lambda spark, sf_dir: coverage_summary(role_reconciled(spark, sf_dir)["r_country"]).withColumn(
            "places_without_indicators", F.array_join("places_without_indicators", ",")
        ),
        f"""WITH {RAW_SQL} SELECT count(*) AS reconciled_places, count(*) FILTER (WHERE has_indicator_data) AS places_with_indicators,
          coalesce(string_agg(country_code_iso2, ',' ORDER BY country_code_iso2) FILTER (WHERE NOT has_indicator_data), '') AS places_without_indicators
        FROM r_country""",
    )
    add(
        "record_problems",
        record_problems,
        "SELECT NULL::VARCHAR AS problem, 0::BIGINT AS count WHERE false",
    )
    add("broken_works", broken_works, BROKEN_SQL)
    for name, columns in WAREHOUSE.items():
        add(
            f"build_{name}",
            _built(name),
            f"WITH {BUILT_SQL}\nSELECT {_columns(columns)} FROM {_BUILT[name]}",
        )
    add(
        "reconciled_checks_failed",
        lambda spark, sf_dir: _checks(spark, sf_dir).where("violations > 0"),
        """SELECT NULL::VARCHAR AS "check", NULL::VARCHAR AS relation, 0::BIGINT AS violations WHERE false""",
    )

