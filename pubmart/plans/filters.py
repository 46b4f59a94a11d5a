"""Filter state and the publication grain it selects.

Every filter on a many-to-many relation is one semi-join on that relation's bridge, with all
its conditions on the same bridge row. A query then joins one bridge only, so relations never
multiply each other's measures.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.functions import measures as M
from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import MISSING_VALUE


@dataclass(frozen=True)
class FilterState:
    """Selected members per filter; an empty tuple selects everything.

    ``MISSING_VALUE`` among the members of a nullable attribute also selects NULL.
    """

    start_year: int | None = None
    end_year: int | None = None
    countries: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    income_levels: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    subfields: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    institution_types: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    publication_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    open_access_values: tuple[str, ...] = ()


def nullable_members(column: Column, selected: tuple) -> Column | None:
    """Predicate for the chosen members, NULL among them when the sentinel is chosen."""
    if not selected:
        return None
    concrete = [value for value in selected if value != MISSING_VALUE]
    if len(concrete) == len(selected):
        return column.isin(concrete)
    if not concrete:
        return column.isNull()
    return column.isin(concrete) | column.isNull()


def open_access_members(selected: tuple[str, ...]) -> Column | None:
    """Three-valued flag: NULL is its own member and never counts as false."""
    known = {"true": True, "false": False, MISSING_VALUE: MISSING_VALUE}
    unknown = [value for value in selected if value not in known]
    if unknown:
        raise ValueError(f"Unsupported open access values: {unknown}")
    return nullable_members(F.col("is_open_access"), tuple(known[value] for value in selected))


def all_of(predicates: list[Column | None]) -> Column | None:
    present = [predicate for predicate in predicates if predicate is not None]
    return reduce(lambda left, right: left & right, present) if present else None


def country_members(f: FilterState) -> Column | None:
    return all_of(
        [
            F.col("country_code_iso2").isin(list(f.countries)) if f.countries else None,
            nullable_members(F.col("region_name"), f.regions),
            nullable_members(F.col("income_level_name"), f.income_levels),
        ]
    )


def topic_members(f: FilterState) -> Column | None:
    return all_of(
        [
            F.col("topic_id").isin(list(f.topics)) if f.topics else None,
            nullable_members(F.col("subfield_id"), f.subfields),
            nullable_members(F.col("field_id"), f.fields),
            nullable_members(F.col("domain_id"), f.domains),
        ]
    )


def institution_members(f: FilterState) -> Column | None:
    return nullable_members(F.col("institution_type"), f.institution_types)


@dataclass(frozen=True)
class Relation:
    """One many-to-many relation of publications: its tables, keys and member filter."""

    name: str
    key: str
    member_id: str
    member_name: str
    members: object = field(compare=False)
    levels: dict = field(default_factory=dict, compare=False)

    def dimension(self, wh: Warehouse) -> DataFrame:
        return wh.table(f"dim_{self.name}")

    @property
    def bridge_name(self) -> str:
        return f"bridge_publication_{self.name}"

    def selected_bridge(self, wh: Warehouse, f: FilterState) -> DataFrame:
        """Bridge rows of the filter's years whose member passes the member filter."""
        rows = wh.within(self.bridge_name, f.start_year, f.end_year)
        rows = rows.select("publication_key", self.key, "fractional_weight")
        predicate = self.members(f)
        if predicate is None:
            return rows
        chosen = self.dimension(wh).where(predicate).select(self.key)
        return rows.join(chosen, self.key, "left_semi")


RELATIONS = {
    "country": Relation(
        "country",
        "country_key",
        "country_code_iso2",
        "country_name",
        country_members,
        {
            "Region": ("region_name", "region_name"),
            "Income level": ("income_level_name", "income_level_name"),
        },
    ),
    "topic": Relation(
        "topic",
        "topic_key",
        "topic_id",
        "topic_name",
        topic_members,
        {
            "Topic": ("topic_id", "topic_name"),
            "Subfield": ("subfield_id", "subfield_name"),
            "Field": ("field_id", "field_name"),
            "Domain": ("domain_id", "domain_name"),
        },
    ),
    "institution": Relation(
        "institution",
        "institution_key",
        "institution_id",
        "institution_name",
        institution_members,
        {"Type": ("institution_type", "institution_type")},
    ),
}


def dated(wh: Warehouse, first: int | None, last: int | None) -> DataFrame:
    """Facts of a closed range of years: its folders, where facts are stored by year, and a range of date_key."""
    publications = wh.within("fact_publication", first, last)
    if first is not None:
        publications = publications.where(F.col("date_key") >= first * 10000)
    if last is not None:
        publications = publications.where(F.col("date_key") < (last + 1) * 10000)
    return publications


def with_calendar(publications: DataFrame) -> DataFrame:
    key = F.col("date_key")
    return publications.withColumns(
        {
            "calendar_year": M.year_of(key),
            "full_date": M.date_of(key),
            "quarter_number": M.quarter_of(key),
            "month_number": M.month_of(key),
        }
    )


def of_source_types(publications: DataFrame, wh: Warehouse, selected: tuple) -> DataFrame:
    """Keep publications by the type of their source.

    A publication without a source, or whose source has no type, is of the missing type. That
    makes "missing" the absence of a typed source: an anti-join, which needs no outer join on a
    mostly NULL key.
    """
    if not selected:
        return publications
    concrete = [value for value in selected if value != MISSING_VALUE]
    kind = F.col("source_type")
    if len(concrete) == len(selected):
        keys = wh.dim_source.where(kind.isin(concrete)).select("source_key")
        return publications.join(keys, "source_key", "left_semi")
    other = kind.isNotNull() & ~kind.isin(concrete) if concrete else kind.isNotNull()
    keys = wh.dim_source.where(other).select("source_key")
    return publications.join(keys, "source_key", "left_anti")


def filtered_publications(
    wh: Warehouse, f: FilterState, attributed: str | None = None
) -> DataFrame:
    """Publications that pass every filter, undated ones included unless a year is set.

    ``attributed`` names the relation the caller joins next through ``selected_bridge``. That
    inner join already keeps exactly the publications its semi-join would keep, so the
    semi-join is left out.
    """
    publications = dated(wh, f.start_year, f.end_year)
    own = all_of(
        [
            nullable_members(F.col("publication_type"), f.publication_types),
            nullable_members(F.col("language"), f.languages),
            open_access_members(f.open_access_values),
        ]
    )
    if own is not None:
        publications = publications.where(own)
    publications = of_source_types(publications, wh, f.source_types)
    for relation in RELATIONS.values():
        if relation.name != attributed and relation.members(f) is not None:
            matching = relation.selected_bridge(wh, f).select("publication_key")
            publications = publications.join(matching, "publication_key", "left_semi")
    return with_calendar(publications).select(
        "publication_key",
        "source_key",
        "publication_type",
        "language",
        "is_open_access",
        "publication_count",
        "citation_count",
        "calendar_year",
        "full_date",
        "quarter_number",
        "month_number",
    )
