"""The fact constellation: ten tables with declared columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmart.schemas import STORED_YEAR, WAREHOUSE


class Warehouse:
    """Ten tables by name, each opened when a query first asks for it.

    Opening lazily means that a query touches the files of the tables it joins and no others.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> None:
        missing = [name for name in WAREHOUSE if name not in tables]
        if missing:
            raise ValueError(f"Warehouse tables are missing: {missing}")
        self._sources = {name: tables[name] for name in WAREHOUSE}
        self._opened: dict[str, DataFrame] = {}

    def stored(self, name: str) -> DataFrame:
        """The table as it is stored: with its publication year, if it lies in folders by year."""
        if name not in self._opened:
            source = self._sources[name]
            self._opened[name] = source() if callable(source) else source
        return self._opened[name]

    def table(self, name: str) -> DataFrame:
        return self.stored(name).select(*WAREHOUSE[name])

    def within(self, name: str, first: int | None, last: int | None) -> DataFrame:
        """The table, read from the folders of a closed range of years only where it is stored by year.

        A fact still needs its own predicate on dates; a bridge is joined with such a fact.
        """
        rows = self.stored(name)
        if STORED_YEAR in rows.columns:
            if first is not None:
                rows = rows.where(F.col(STORED_YEAR) >= first)
            if last is not None:
                rows = rows.where(F.col(STORED_YEAR) <= last)
        return rows.select(*WAREHOUSE[name])

    def replace(self, **tables: DataFrame) -> Warehouse:
        return Warehouse({**self._sources, **self._opened, **tables})

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in WAREHOUSE}

    dim_date = property(lambda self: self.table("dim_date"))
    dim_country = property(lambda self: self.table("dim_country"))
    dim_topic = property(lambda self: self.table("dim_topic"))
    dim_institution = property(lambda self: self.table("dim_institution"))
    dim_source = property(lambda self: self.table("dim_source"))
    fact_publication = property(lambda self: self.table("fact_publication"))
    fact_country_year = property(lambda self: self.table("fact_country_year"))
    bridge_publication_topic = property(lambda self: self.table("bridge_publication_topic"))
    bridge_publication_country = property(lambda self: self.table("bridge_publication_country"))
    bridge_publication_institution = property(
        lambda self: self.table("bridge_publication_institution")
    )
