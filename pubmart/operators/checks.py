"""Data checks. Each is a one-row frame (check, relation, violations); zero means passed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """Raised with the names of all failed checks."""


def _result(rows: DataFrame, check: str, relation: str, violations: Column) -> DataFrame:
    return rows.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(check).alias("check"), F.lit(relation).alias("relation"), "violations"
    )


def all_checks(checks: Iterable[DataFrame]) -> DataFrame:
    """Union of checks, pairwise: every union is analysed anew, so the tree is kept flat."""
    level = list(checks)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [pair[0].unionAll(pair[1]) if len(pair) == 2 else pair[0] for pair in pairs]
    return level[0]


def require(checks: DataFrame) -> None:
    """Raise when a check found violations. Collects one row per check."""
    failed = [f"{row.check} on {row.relation}: {row.violations}" for row in checks.where("violations > 0").collect()]
    if failed:
        raise CheckFailed("; ".join(sorted(failed)))


def missing_columns(tables: Mapping[str, DataFrame], contract: Mapping[str, Iterable[str]]) -> list[str]:
    """Every contracted table or column that is absent, all at once."""
    gaps = []
    for name, required in contract.items():
        present = tables[name].columns if name in tables else []
        lacking = sorted(set(required) - set(present))
        if lacking:
            gaps.append(f"{name}: {', '.join(lacking)}")
    return gaps


def require_columns(tables: Mapping[str, DataFrame], contract: Mapping[str, Iterable[str]]) -> None:
    gaps = missing_columns(tables, contract)
    if gaps:
        raise CheckFailed("Required tables or columns are missing: " + "; ".join(gaps))


def not_empty(rows: DataFrame, relation: str) -> DataFrame:
    return _result(rows.limit(1), "not empty", relation, 1 - F.count("*"))


def duplicate_keys(rows: DataFrame, relation: str, key: tuple[str, ...]) -> DataFrame:
    repeated = rows.groupBy(*key).count().where("count > 1")
    return _result(repeated, "duplicate key", relation, F.count("*"))


def present(columns: Iterable[str]) -> Column:
    """All columns have a value."""
    return reduce(lambda a, b: a & b, [F.col(column).isNotNull() for column in columns])


def missing_values(rows: DataFrame, relation: str, columns: Iterable[str]) -> DataFrame:
    return holds(rows, "missing value", relation, present(columns))


def orphans(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str, relation: str
) -> DataFrame:
    """Rows whose reference has no parent. NULL references nothing and passes.

    References are counted per value before they meet the parent, so a value held by very many
    rows crosses the shuffle once per task.
    """
    references = child.groupBy(F.col(column).alias("_ref")).agg(F.count("*").alias("_rows"))
    keys = parent.select(F.col(parent_column).alias("_ref"))
    lost = references.where(F.col("_ref").isNotNull()).join(keys, "_ref", "left_anti")
    return _result(lost, "orphan", f"{relation}.{column}", F.sum("_rows"))


def key_checks(
    parent: DataFrame,
    column: str,
    children: Iterable[tuple[DataFrame, str, str]],
    unique: str | None = None,
) -> DataFrame:
    """All checks that meet on one key, from one aggregation: references of every child, and duplicates.

    The parent's keys and the children's references, (rows, column, relation), are tagged and counted
    side by side per key: each table is read once and one shuffle serves all. Partial counts shrink
    a key that very many rows hold. ``unique`` names the relation whose duplicate keys are counted as well.
    """
    children = list(children)
    tagged = [parent.select(F.col(column).alias("_key"), F.lit(0).alias("_side"))]
    tagged += [rows.select(F.col(name).alias("_key"), F.lit(i).alias("_side")) for i, (rows, name, _) in enumerate(children, 1)]
    sides = [F.count_if(F.col("_side") == i).alias(f"n{i}") for i in range(len(tagged))]
    keys = reduce(DataFrame.unionAll, tagged).groupBy("_key").agg(*sides)
    lost = F.col("_key").isNotNull() & (F.col("n0") == 0)
    found = {("orphan", f"{relation}.{name}"): F.sum(F.when(lost, F.col(f"n{i}"))) for i, (_, name, relation) in enumerate(children, 1)}
    if unique:
        found["duplicate key", unique] = F.count_if(F.col("n0") > 1)
    counts = [F.coalesce(violations, F.lit(0)).cast("bigint").alias(f"v{i}") for i, violations in enumerate(found.values())]
    entries = [
        F.struct(F.lit(check).alias("check"), F.lit(relation).alias("relation"), F.col(f"v{i}").alias("violations"))
        for i, (check, relation) in enumerate(found)
    ]
    return keys.agg(*counts).select(F.inline(F.array(*entries)))


def table_checks(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, tuple[str, ...]],
    references: Iterable[tuple[str, str, str, str]],
) -> list[DataFrame]:
    """Duplicate keys of all tables and all references, (child, column, parent, key), fused by parent key."""
    by_parent: dict[tuple[str, str], list] = {}
    for child, column, parent, key in references:
        by_parent.setdefault((parent, key), []).append((tables[child], column, child))
    fused = {parent for parent, key in by_parent if keys.get(parent) == (key,)}
    found = [
        key_checks(tables[parent], key, children, parent if keys.get(parent) == (key,) else None)
        for (parent, key), children in by_parent.items()
    ]
    return found + [duplicate_keys(tables[name], name, key) for name, key in keys.items() if name not in fused]


def same_count(left: DataFrame, right: DataFrame, relation: str) -> DataFrame:
    """Difference in row counts of a table and its source."""
    counts = left.select(F.lit(1).alias("n")).unionAll(right.select(F.lit(-1).alias("n")))
    return _result(counts, "row count", relation, F.abs(F.sum("n")))


def row_rules(rows: DataFrame, relation: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that contradict each predicate, all counted in one pass; an unknown outcome passes."""
    counts = [F.count_if(~predicate).alias(f"n{i}") for i, predicate in enumerate(rules.values())]
    entries = [
        F.struct(
            F.lit(check).alias("check"), F.lit(relation).alias("relation"), F.col(f"n{i}").alias("violations")
        )
        for i, check in enumerate(rules)
    ]
    return rows.agg(*counts).select(F.inline(F.array(*entries)))


def holds(rows: DataFrame, check: str, relation: str, predicate: Column) -> DataFrame:
    return row_rules(rows, relation, {check: predicate})


def same_nulls(left: DataFrame, right: DataFrame, relation: str, columns: Iterable[str]) -> DataFrame:
    """Difference in the number of NULLs, summed over the columns."""

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*[F.when(F.col(c).isNull(), sign).otherwise(0).alias(c) for c in columns])

    both = counted(left, 1).unionByName(counted(right, -1))
    return _result(
        both, "null count", relation, reduce(lambda a, b: a + b, [F.abs(F.sum(c)) for c in columns])
    )


def same_values(
    left: DataFrame, right: DataFrame, relation: str, key: tuple[str, ...], columns: Iterable[str]
) -> DataFrame:
    """Rows of equal key whose values differ; NULL equals NULL."""
    renamed = right.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return _result(left.join(renamed, list(key)), "value parity", relation, F.count_if(differ))


def weight_sums(bridge: DataFrame, relation: str, step: float = 1e-15) -> DataFrame:
    """Publications whose weights do not add up to one, but for a last place of each member."""
    weight = F.col("fractional_weight").cast("decimal(28,15)")
    sums = bridge.groupBy("publication_key").agg(F.sum(weight).alias("total"), F.count("*").alias("members"))
    off = F.count_if(F.abs(F.col("total").cast("double") - 1) > F.col("members") * step + step)
    return _result(sums, "weights sum to one", relation, off)
