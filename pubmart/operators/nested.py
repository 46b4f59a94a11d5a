"""Relations inside nested works, as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.schemas import RECONCILED


def _members(*arrays: str) -> Column:
    return F.concat(*[F.coalesce(F.col(name), F.array()) for name in arrays])


def topic_entities(works: DataFrame) -> DataFrame:
    """Topics named in topics[] or as primary topic, repeated ones removed early."""
    columns = RECONCILED["r_topic"]

    def plain(t: Column) -> Column:
        return F.struct(*[t[name].alias(name) for name in columns])

    listed = F.transform(F.coalesce("topics", F.array()), plain)
    primary = F.array_compact(F.array(F.when(F.col("primary_topic").isNotNull(), plain(F.col("primary_topic")))))
    named = works.select(F.explode(F.array_distinct(F.concat(listed, primary))).alias("t"))
    return named.select("t.*").distinct()


def work_topics(works: DataFrame) -> DataFrame:
    """Work-topic pairs with 1-based rank and score."""
    rows = works.select("work_id", F.posexplode("topics").alias("position", "t"))
    return rows.select(
        "work_id",
        F.col("t.topic_id").alias("topic_id"),
        (F.col("position") + 1).alias("topic_rank"),
        F.col("t.score").alias("topic_score"),
    )


def work_countries(works: DataFrame) -> DataFrame:
    """Distinct work-country pairs from authors and from their institutions."""
    of_institutions = F.transform(
        F.coalesce("institutions", F.array()), lambda i: i["country_code_iso2"]
    )
    codes = F.array_distinct(F.array_compact(F.concat(_members("author_countries"), of_institutions)))
    return works.select("work_id", F.explode(codes).alias("country_code_iso2")).distinct()


def institution_entities(works: DataFrame) -> DataFrame:
    named = works.select(F.explode(F.array_distinct("institutions")).alias("i"))
    return named.select("i.*").distinct()


def work_institutions(works: DataFrame) -> DataFrame:
    """Distinct work-institution pairs."""
    ids = F.array_distinct(F.transform("institutions", lambda i: i["institution_id"]))
    return works.select("work_id", F.explode(ids).alias("institution_id")).distinct()


def source_entities(works: DataFrame) -> DataFrame:
    return works.where(F.col("source").isNotNull()).select("source.*").distinct()


def work_rows(works: DataFrame) -> DataFrame:
    return works.select(
        "work_id",
        "doi",
        "title",
        "publication_date",
        "publication_year",
        "work_type",
        "language",
        "cited_by_count",
        F.col("primary_topic.topic_id").alias("primary_topic_id"),
        F.col("source.source_id").alias("source_id"),
        "is_open_access",
    )
