"""A bibliometric warehouse on Spark: from raw records to OLAP answers."""

from pubmart.plans.filters import FilterState
from pubmart.plans.warehouse import Warehouse

__all__ = ["FilterState", "Warehouse"]
