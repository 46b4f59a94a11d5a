"""Filter states used by the registered queries, each next to its SQL meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pubmart.plans.filters import FilterState
from pubmart.schemas import MISSING_VALUE
from pubmart.verification.roles import ROLE_SQL


@dataclass(frozen=True)
class Selection:
    state: FilterState
    where: str = "true"  # over fact_publication p LEFT JOIN dim_source s
    country: str = "true"  # over dim_country c
    topic: str = "true"  # over dim_topic t
    institution: str = "true"  # over dim_institution i

    def sql(self, *ctes: str, select: str) -> str:
        """WITH the roles, the filtered publications and further expressions."""
        exists = [
            f"EXISTS (SELECT 1 FROM bridge_publication_{name} b JOIN dim_{name} {alias} USING ({name}_key) "
            f"WHERE b.publication_key = p.publication_key AND {condition})"
            for name, alias, condition in (
                ("country", "c", self.country),
                ("topic", "t", self.topic),
                ("institution", "i", self.institution),
            )
            if condition != "true"
        ]
        filtered = (
            "filtered AS (SELECT p.* FROM fact_publication p LEFT JOIN dim_source s USING (source_key) WHERE "
            + " AND ".join([self.where, *exists])
            + ")"
        )
        return "WITH " + ",\n".join([ROLE_SQL.strip(), filtered, *ctes]) + "\n" + select


EVERYTHING = Selection(FilterState())

PERIOD = Selection(FilterState(start_year=1996, end_year=2000), "calendar_year BETWEEN 1996 AND 2000")

MIXED = Selection(
    FilterState(
        start_year=1996,
        end_year=2000,
        regions=("ASIA", "EUROPE", MISSING_VALUE),
        income_levels=("High income", "Low income", MISSING_VALUE),
        institution_types=("education", MISSING_VALUE),
        source_types=("BUILDING", "MACHINERY", MISSING_VALUE),
        publication_types=("1-URGENT", "5-LOW", MISSING_VALUE),
        open_access_values=("true", MISSING_VALUE),
    ),
    "calendar_year BETWEEN 1996 AND 2000 "
    "AND (s.source_type IN ('BUILDING', 'MACHINERY') OR s.source_type IS NULL) "
    "AND (p.publication_type IN ('1-URGENT', '5-LOW') OR p.publication_type IS NULL) "
    "AND (p.is_open_access OR p.is_open_access IS NULL)",
    country="(c.region_name IN ('ASIA', 'EUROPE') OR c.region_name IS NULL) "
    "AND (c.income_level_name IN ('High income', 'Low income') OR c.income_level_name IS NULL)",
    institution="(i.institution_type = 'education' OR i.institution_type IS NULL)",
)

MEMBERS = Selection(
    FilterState(
        countries=("AB", "AF", "AK", "AM", "AW"),
        fields=("Brand#1", "Brand#12", "Brand#23", MISSING_VALUE),
        domains=("D1", "D2", "D3", MISSING_VALUE),
        source_types=("MACHINERY", "HOUSEHOLD"),
        languages=("F", "O"),
    ),
    "s.source_type IN ('MACHINERY', 'HOUSEHOLD') AND p.language IN ('F', 'O')",
    country="c.country_code_iso2 IN ('AB', 'AF', 'AK', 'AM', 'AW')",
    topic="(t.field_id IN ('Brand#1', 'Brand#12', 'Brand#23') OR t.field_id IS NULL) "
    "AND (t.domain_id IN ('D1', 'D2', 'D3') OR t.domain_id IS NULL)",
)

ONLY_MISSING = Selection(
    FilterState(
        regions=(MISSING_VALUE,),
        subfields=(MISSING_VALUE,),
        source_types=(MISSING_VALUE,),
        languages=(MISSING_VALUE, "P"),
        open_access_values=(MISSING_VALUE,),
    ),
    "s.source_type IS NULL AND (p.language = 'P' OR p.language IS NULL) AND p.is_open_access IS NULL",
    country="c.region_name IS NULL",
    topic="t.subfield_id IS NULL",
)

NOTHING = Selection(FilterState(start_year=2100), "calendar_year >= 2100")
