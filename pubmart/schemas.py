"""Record shapes, table contracts and the fixed values the analyses rely on."""

from __future__ import annotations

# --------------------------------------------------------------------------------------
# Fixed values (results depend on them)
# --------------------------------------------------------------------------------------
START_YEAR = 2018
END_YEAR = 2025
YEARS = tuple(range(START_YEAR, END_YEAR + 1))
MINIMUM_SUPPORT = 30

MISSING_VALUE = "__MISSING__"
MISSING_LABEL = "Missing / unavailable"
OPEN_LABEL = "Open Access"
NOT_OPEN_LABEL = "Not Open Access"

INCOME_GROUPS = ("High income", "Upper middle income", "Lower middle income", "Low income")

CORPUS_SUBFIELD = "1702"
ALLOWED_WORK_TYPES = ("article", "review", "conference-paper", "preprint", "book", "book-chapter")
SAMPLE_TARGET = 50_000
SAMPLE_SEED = 20_260_910

INDICATORS = {
    "population": "SP.POP.TOTL",
    "gdp_current_usd": "NY.GDP.MKTP.CD",
    "gdp_per_capita_current_usd": "NY.GDP.PCAP.CD",
    "internet_users_pct": "IT.NET.USER.ZS",
    "rd_expenditure_pct_gdp": "GB.XPD.RSDV.GD.ZS",
}
MEASURES = tuple(INDICATORS)
INDICATOR_SOURCE_ID = "2"
INDICATOR_SOURCE_NAME = "World Development Indicators"

# Places that works may name although the panel does not cover them: iso2, iso3, name.
UNCOVERED_PLACES = (
    ("GF", "GUF", "French Guiana"),
    ("GP", "GLP", "Guadeloupe"),
    ("MQ", "MTQ", "Martinique"),
    ("MS", "MSR", "Montserrat"),
    ("RE", "REU", "Réunion"),
    ("TW", "TWN", "Taiwan"),
)

# --------------------------------------------------------------------------------------
# Raw records
# --------------------------------------------------------------------------------------
_NAMED = "STRUCT<id: STRING, display_name: STRING>"
_TOPIC = (
    "STRUCT<id: STRING, display_name: STRING, score: DOUBLE, "
    f"subfield: {_NAMED}, field: {_NAMED}, domain: {_NAMED}>"
)
_INSTITUTION = "STRUCT<id: STRING, display_name: STRING, type: STRING, country_code: STRING>"
WORK_RECORD = (
    "id STRING, doi STRING, title STRING, display_name STRING, publication_date STRING, "
    "publication_year BIGINT, type STRING, language STRING, cited_by_count BIGINT, "
    f"is_retracted BOOLEAN, primary_topic {_TOPIC}, topics ARRAY<{_TOPIC}>, "
    f"authorships ARRAY<STRUCT<countries: ARRAY<STRING>, institutions: ARRAY<{_INSTITUTION}>>>, "
    "primary_location STRUCT<source: STRUCT<id: STRING, display_name: STRING, type: STRING, issn_l: STRING>>, "
    "open_access STRUCT<is_oa: BOOLEAN>"
)
# The text fields of a work at any depth.
WORK_TEXTS = (
    "id", "doi", "title", "display_name", "publication_date", "type", "language", "issn_l",
    "country_code", "countries",
)
# VARIANT leaves keep the JSON type of each value.
PANEL_RECORD = (
    "country_code_iso2 VARIANT, country_code_iso3 VARIANT, country_name VARIANT, region_id VARIANT, "
    "region_name VARIANT, income_level_id VARIANT, income_level_name VARIANT, year VARIANT, "
    + ", ".join(f"{measure} VARIANT" for measure in MEASURES)
)
COUNTRY_RECORD = (
    "id STRING, iso2Code STRING, name STRING, region STRUCT<id: STRING, value: STRING>, "
    "incomeLevel STRUCT<id: STRING, value: STRING>"
)
OBSERVATION_RECORD = (
    "indicator STRUCT<id: STRING, value: STRING>, country STRUCT<id: STRING, value: STRING>, "
    "countryiso3code STRING, date STRING, value VARIANT"
)
INDICATOR_RECORD = (
    "id STRING, name STRING, unit STRING, source STRUCT<id: STRING, value: STRING>, "
    "sourceNote STRING, sourceOrganization STRING"
)
SOURCE_RECORD = "id STRING, name STRING"

# --------------------------------------------------------------------------------------
# Reconciled tables: columns in order, and the natural key
# --------------------------------------------------------------------------------------
RECONCILED = {
    "r_country": (
        "country_code_iso2", "country_code_iso3", "country_name", "region_id", "region_name",
        "income_level_id", "income_level_name", "has_indicator_data",
    ),
    "r_topic": (
        "topic_id", "topic_name", "subfield_id", "subfield_name", "field_id", "field_name",
        "domain_id", "domain_name",
    ),
    "r_institution": ("institution_id", "display_name", "institution_type", "country_code_iso2"),
    "r_source": ("source_id", "display_name", "source_type", "issn_l"),
    "r_work": (
        "work_id", "doi", "title", "publication_date", "publication_year", "work_type", "language",
        "cited_by_count", "primary_topic_id", "source_id", "is_open_access",
    ),
    "r_work_topic": ("work_id", "topic_id", "topic_rank", "topic_score"),
    "r_work_country": ("work_id", "country_code_iso2"),
    "r_work_institution": ("work_id", "institution_id"),
    "r_country_year_indicator": ("country_code_iso2", "year", *MEASURES),
}
RECONCILED_KEYS = {
    "r_country": ("country_code_iso2",),
    "r_topic": ("topic_id",),
    "r_institution": ("institution_id",),
    "r_source": ("source_id",),
    "r_work": ("work_id",),
    "r_work_topic": ("work_id", "topic_id"),
    "r_work_country": ("work_id", "country_code_iso2"),
    "r_work_institution": ("work_id", "institution_id"),
    "r_country_year_indicator": ("country_code_iso2", "year"),
}
# What the warehouse build reads from each reconciled table.
WAREHOUSE_INPUT = {
    **{name: columns for name, columns in RECONCILED.items() if name != "r_work"},
    "r_work": tuple(c for c in RECONCILED["r_work"] if c not in ("doi", "title", "publication_year")),
}
# child table, child columns, parent table, parent column
RECONCILED_REFERENCES = (
    ("r_work", "primary_topic_id", "r_topic", "topic_id"),
    ("r_work", "source_id", "r_source", "source_id"),
    ("r_work_topic", "work_id", "r_work", "work_id"),
    ("r_work_topic", "topic_id", "r_topic", "topic_id"),
    ("r_work_country", "work_id", "r_work", "work_id"),
    ("r_work_country", "country_code_iso2", "r_country", "country_code_iso2"),
    ("r_work_institution", "work_id", "r_work", "work_id"),
    ("r_work_institution", "institution_id", "r_institution", "institution_id"),
    ("r_institution", "country_code_iso2", "r_country", "country_code_iso2"),
    ("r_country_year_indicator", "country_code_iso2", "r_country", "country_code_iso2"),
)

# --------------------------------------------------------------------------------------
# Warehouse tables
# --------------------------------------------------------------------------------------
WAREHOUSE = {
    "dim_date": (
        "date_key", "full_date", "day_of_month", "month_number", "quarter_number", "calendar_year",
    ),
    "dim_country": ("country_key", *RECONCILED["r_country"]),
    "dim_topic": ("topic_key", *RECONCILED["r_topic"]),
    "dim_institution": (
        "institution_key", "institution_id", "institution_name", "institution_type",
        "country_code_iso2",
    ),
    "dim_source": ("source_key", "source_id", "source_name", "source_type", "issn_l"),
    "fact_publication": (
        "publication_key", "work_id", "date_key", "source_key", "publication_type", "language",
        "is_open_access", "publication_count", "citation_count",
    ),
    "fact_country_year": ("country_year_key", "country_key", "year", *MEASURES),
    "bridge_publication_topic": (
        "publication_key", "topic_key", "topic_rank", "topic_score", "is_primary_topic",
        "fractional_weight",
    ),
    "bridge_publication_country": ("publication_key", "country_key", "fractional_weight"),
    "bridge_publication_institution": ("publication_key", "institution_key", "fractional_weight"),
}
# Natural or grain keys, and the reconciled table whose row count each table must repeat.
WAREHOUSE_KEYS = {
    "dim_date": ("full_date",),
    "dim_country": ("country_code_iso2",),
    "dim_topic": ("topic_id",),
    "dim_institution": ("institution_id",),
    "dim_source": ("source_id",),
    "fact_publication": ("work_id",),
    "fact_country_year": ("country_key", "year"),
    "bridge_publication_topic": ("publication_key", "topic_key"),
    "bridge_publication_country": ("publication_key", "country_key"),
    "bridge_publication_institution": ("publication_key", "institution_key"),
}
WAREHOUSE_SOURCES = {
    "dim_country": "r_country",
    "dim_topic": "r_topic",
    "dim_institution": "r_institution",
    "dim_source": "r_source",
    "fact_publication": "r_work",
    "fact_country_year": "r_country_year_indicator",
    "bridge_publication_topic": "r_work_topic",
    "bridge_publication_country": "r_work_country",
    "bridge_publication_institution": "r_work_institution",
}
WAREHOUSE_REFERENCES = (
    ("fact_publication", "date_key", "dim_date", "date_key"),
    ("fact_publication", "source_key", "dim_source", "source_key"),
    ("fact_country_year", "country_key", "dim_country", "country_key"),
    ("bridge_publication_topic", "publication_key", "fact_publication", "publication_key"),
    ("bridge_publication_topic", "topic_key", "dim_topic", "topic_key"),
    ("bridge_publication_country", "publication_key", "fact_publication", "publication_key"),
    ("bridge_publication_country", "country_key", "dim_country", "country_key"),
    ("bridge_publication_institution", "publication_key", "fact_publication", "publication_key"),
    ("bridge_publication_institution", "institution_key", "dim_institution", "institution_key"),
)
BRIDGES = tuple(name for name in WAREHOUSE if name.startswith("bridge_"))
# Stored in one folder a year. The folder's column is no part of any table's contract, and named like none of theirs.
BY_YEAR = ("fact_publication", *BRIDGES)
STORED_YEAR = "stored_year"
