"""Landed pages of a paged list source: ``[{page, pages, total, ...}, [record, ...]]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmart.functions.text import clean_text, trimmed, trimmed_or_empty
from pubmart.operators import checks as C
from pubmart.schemas import INDICATORS, INDICATOR_SOURCE_ID, INDICATOR_SOURCE_NAME


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file, with its folder as the endpoint name."""
    pages = spark.read.option("wholetext", True).text(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return pages.select(folder.alias("endpoint"), "value")


def parse_pages(pages: DataFrame) -> DataFrame:
    """Page numbers, declared totals and the records as JSON text; ``bad_shape`` for others."""
    body = F.col("body")
    meta_kind = F.schema_of_variant(F.try_variant_get(body, "$[0]", "variant"))
    records_kind = F.schema_of_variant(F.try_variant_get(body, "$[1]", "variant"))
    objects = records_kind.startswith("ARRAY<OBJECT") | records_kind.isin("VOID", "ARRAY<VOID>")
    shaped = meta_kind.startswith("OBJECT") & objects

    def meta(name: str, default) -> Column:
        return F.coalesce(F.try_variant_get(body, f"$[0].{name}", "int"), default)

    rows = pages.withColumn("body", F.try_parse_json("value"))
    return rows.select(
        "endpoint",
        meta("page", F.lit(None).cast("int")).alias("page"),
        meta("pages", F.lit(1)).alias("pages"),
        meta("total", F.lit(None).cast("int")).alias("total"),
        F.coalesce(F.get_json_object("value", "$[1]"), F.lit("[]")).alias("records"),
        (~F.coalesce(shaped, F.lit(False))).alias("bad_shape"),
    )


def page_records(parsed_pages: DataFrame, record: str) -> DataFrame:
    """All records of the pages as rows of the given type."""
    fields = F.from_json("records", f"array<struct<{_as_struct(record)}>>")
    return parsed_pages.select("endpoint", F.explode(fields).alias("r")).select("endpoint", "r.*")


def _as_struct(columns: str) -> str:
    """Column list ``a INT, b STRUCT<x: INT>`` as struct fields ``a: INT, b: STRUCT<x: INT>``."""
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(columns))


def page_checks(parsed_pages: DataFrame) -> DataFrame:
    """Per endpoint: pages 1..N all there once, N constant, and as many records as declared."""
    size = F.json_array_length("records")
    per_endpoint = parsed_pages.groupBy("endpoint").agg(
        F.count("*").alias("files"),
        F.count_distinct("page").alias("distinct_pages"),
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
        F.min("pages").alias("least_pages"),
        F.max("pages").alias("most_pages"),
        F.sum(size).alias("records"),
        F.max(F.when(F.col("page") == 1, F.col("total"))).alias("total"),
    )
    complete = (
        (F.col("least_pages") >= 1)
        & (F.col("first_page") == 1)
        & (F.col("last_page") == F.col("most_pages"))
        & (F.col("files") == F.col("most_pages"))
        & (F.col("distinct_pages") == F.col("most_pages"))
    )
    return C.all_checks(
        [
            C.holds(parsed_pages, "page shape", "pages", ~F.col("bad_shape")),
            C.holds(per_endpoint, "pages complete", "endpoints", F.coalesce(complete, F.lit(False))),
            C.holds(
                per_endpoint, "page count constant", "endpoints", F.col("least_pages") == F.col("most_pages")
            ),
            C.holds(per_endpoint, "declared records", "endpoints", F.col("records") == F.col("total")),
        ]
    )


# ---- countries -----------------------------------------------------------------------


def is_aggregate(region: Column) -> Column:
    """Marks entries that stand for groups of countries."""
    return (F.upper(trimmed_or_empty(region["id"])) == "NA") | (
        F.lower(trimmed_or_empty(region["value"])) == "aggregates"
    )


def normalised_countries(records: DataFrame) -> DataFrame:
    region, income = F.col("region"), F.col("incomeLevel")
    parts = {
        "country_code_iso3": F.col("id"),
        "country_code_iso2": F.col("iso2Code"),
        "country_name": F.col("name"),
        "region_id": region["id"],
        "region_name": region["value"],
        "income_level_id": income["id"],
        "income_level_name": income["value"],
    }
    return records.select(*[trimmed_or_empty(value).alias(name) for name, value in parts.items()])


def split_countries(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Real countries, normalised, and the records of aggregates."""
    aggregate = is_aggregate(F.col("region"))
    real = normalised_countries(records.where(~aggregate)).orderBy("country_code_iso3")
    return real, records.where(aggregate)


def country_checks(real: DataFrame) -> DataFrame:
    return C.all_checks(
        [
            C.holds(real, "iso3 present", "countries", F.col("country_code_iso3") != ""),
            C.duplicate_keys(real, "countries.country_code_iso3", ("country_code_iso3",)),
        ]
    )


# ---- indicators ----------------------------------------------------------------------


def indicator_metadata(records: DataFrame, indicators: dict = INDICATORS) -> DataFrame:
    """Each configured indicator with its official metadata and the number of matches."""
    wanted = records.sparkSession.createDataFrame(list(indicators.items()), "output_field STRING, code STRING")
    source = F.col("source")
    found = records.where(
        (trimmed(source["id"]) == INDICATOR_SOURCE_ID) & F.upper("id").isin(list(indicators.values()))
    ).select(
        F.upper(trimmed(F.col("id"))).alias("code"),
        trimmed_or_empty(F.col("name")).alias("official_name"),
        trimmed_or_empty(F.col("unit")).alias("unit"),
        trimmed_or_empty(source["id"]).alias("source_id"),
        trimmed_or_empty(source["value"]).alias("source_name"),
        trimmed_or_empty(F.col("sourceNote")).alias("source_note"),
        trimmed_or_empty(F.col("sourceOrganization")).alias("source_organization"),
    )
    texts = [c for c in found.columns if c != "code"]
    one = found.groupBy("code").agg(F.count("*").alias("matches"), *[F.max(c).alias(c) for c in texts])
    joined = wanted.join(one, "code", "left")
    return joined.select(
        "code", "output_field", *texts, F.coalesce("matches", F.lit(0)).alias("matches")
    )


def indicator_checks(metadata: DataFrame, source_records: DataFrame) -> DataFrame:
    """One named record per indicator, and the source record itself by id and name."""
    named = clean_text(F.col("official_name")).isNotNull()
    source = source_records.where(F.col("id") == INDICATOR_SOURCE_ID).agg(
        F.count("*").alias("n"), F.max(trimmed(F.col("name"))).alias("name")
    )
    right = (F.col("n") == 1) & (F.col("name") == INDICATOR_SOURCE_NAME)
    return C.all_checks(
        [
            C.holds(metadata, "one metadata record", "indicators", F.col("matches") == 1),
            C.holds(metadata, "official name", "indicators", (F.col("matches") == 0) | named),
            C.holds(source, "source identity", "sources", F.coalesce(right, F.lit(False))),
        ]
    )


def long_observations(records: DataFrame) -> DataFrame:
    """Observation records in the columns that triage works on."""
    return records.select(
        trimmed(F.col("indicator")["id"]).alias("indicator"),
        trimmed(F.col("countryiso3code")).alias("country_code_iso3"),
        "date",
        "value",
    )
