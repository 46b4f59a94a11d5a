"""The driver's tables in the roles of the warehouse, in Spark and in SQL.

Orders play publications, nations countries, parts topics, suppliers institutions, customers
sources; the bridges are the distinct pairs that line items hold. Missing values of every kind
are put in by rule, so that each NULL path is met. Both forms are written independently and
cover the whole tables.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmart.functions import measures as M
from pubmart.plans.warehouse import Warehouse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unless(condition: Column, value) -> Column:
    return F.when(~condition, value)


def _letter(key: Column) -> Column:
    return F.char((key + 65).cast("long"))


def country_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    placeless = key == 24

    def income(*names: str) -> Column:
        rule = F.when(key < 5, names[0])
        for position, name in enumerate(names[1:], 2):
            rule = rule.when(key < 5 * position, name)
        return rule

    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return nations.select(
        key.cast("long").alias("country_key"),
        F.concat(F.lit("A"), _letter(key)).alias("country_code_iso2"),
        F.concat(F.lit("QA"), _letter(key)).alias("country_code_iso3"),
        _unless(key == 10, F.col("n_name")).alias("country_name"),
        _unless(placeless, F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))).alias("region_id"),
        _unless(placeless, F.col("r_name")).alias("region_name"),
        income("HIC", "UMC", "LMC", "LIC").alias("income_level_id"),
        income("High income", "Upper middle income", "Lower middle income", "Low income").alias(
            "income_level_name"
        ),
        (~placeless).alias("has_indicator_data"),
    )


def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, brand = F.col("p_partkey"), F.col("p_brand")
    no_subfield, no_field, no_domain = key % 29 == 0, key % 31 == 0, key % 23 == 0
    return table(spark, sf_dir, "part").select(
        key.alias("topic_key"),
        F.concat(F.lit("T"), key.cast("string")).alias("topic_id"),
        _unless(key % 41 == 0, F.col("p_name")).alias("topic_name"),
        _unless(no_subfield, F.concat(brand, F.lit("/"), F.col("p_type"))).alias("subfield_id"),
        _unless(no_subfield, F.concat(F.col("p_type"), F.lit(" of "), brand)).alias("subfield_name"),
        _unless(no_field, brand).alias("field_id"),
        _unless(no_field, F.lower(brand)).alias("field_name"),
        _unless(no_domain, F.concat(F.lit("D"), F.right(brand, F.lit(1)))).alias("domain_id"),
        _unless(no_domain, F.concat(F.lit("Domain "), F.right(brand, F.lit(1)))).alias("domain_name"),
    )


def institution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    kind = F.when(key % 4 == 0, "education").when(key % 4 == 1, "company").when(key % 4 == 2, "government")
    return table(spark, sf_dir, "supplier").select(
        key.alias("institution_key"),
        F.concat(F.lit("I"), key.cast("string")).alias("institution_id"),
        _unless(key % 19 == 0, F.col("s_name")).alias("institution_name"),
        kind.alias("institution_type"),
        _unless(key % 17 == 0, F.concat(F.lit("A"), _letter(F.col("s_nationkey")))).alias("country_code_iso2"),
    )


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("source_key"),
        F.concat(F.lit("S"), key.cast("string")).alias("source_id"),
        F.col("c_name").alias("source_name"),
        _unless(key % 37 == 0, F.col("c_mktsegment")).alias("source_type"),
        _unless(key % 3 == 0, F.lpad(key.cast("string"), 9, "0")).alias("issn_l"),
    )


def _publication_date() -> Column:
    return _unless(F.col("o_orderkey") % 101 == 0, F.col("o_orderdate").cast("date"))


def publication_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    citations = F.floor(F.col("o_totalprice") / 3000) - 5
    return table(spark, sf_dir, "orders").select(
        key.alias("publication_key"),
        F.concat(F.lit("W"), key.cast("string")).alias("work_id"),
        M.date_key(_publication_date()).alias("date_key"),
        _unless(F.col("o_custkey") % 10 == 0, F.col("o_custkey")).alias("source_key"),
        _unless(key % 53 == 0, F.col("o_orderpriority")).alias("publication_type"),
        _unless(key % 59 == 0, status).alias("language"),
        F.when(status == "F", True).when(status == "O", False).alias("is_open_access"),
        F.lit(1).alias("publication_count"),
        _unless(key % 97 == 0, F.greatest(citations, F.lit(0))).alias("citation_count"),
    )


def date_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("full_date")
    days = table(spark, sf_dir, "orders").select(_publication_date().alias("full_date"))
    return days.where(day.isNotNull()).distinct().select(
        M.date_key(day).alias("date_key"),
        "full_date",
        F.dayofmonth(day).alias("day_of_month"),
        F.month(day).alias("month_number"),
        F.quarter(day).alias("quarter_number"),
        F.year(day).alias("calendar_year"),
    )


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country x year measures; null, zero and absent cells included."""
    year = F.year("o_orderdate")
    sums = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .where(F.col("c_nationkey") != 24)
        .groupBy(F.col("c_nationkey").cast("long").alias("country_key"), year.alias("year"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum("o_totalprice"), 2).alias("gdp"),
            F.count_if(F.col("o_orderstatus") == "F").alias("open"),
            F.count_if(F.col("o_orderstatus") == "P").alias("partial"),
        )
    )
    key, n = F.col("country_key"), F.col("n")
    population = F.when((key == 3) & (F.col("year") == 1997), F.lit(0)).otherwise(n * 10000)
    gdp = _unless((key % 7 == 0) & (F.col("year") == 1999), F.col("gdp"))
    return sums.select(
        (key * 10000 + F.col("year")).alias("country_year_key"),
        "country_key",
        "year",
        population.alias("population"),
        gdp.alias("gdp_current_usd"),
        F.round(M.rate(gdp, population, 1), 6).alias("gdp_per_capita_current_usd"),
        _unless(key % 4 == 0, F.round(F.col("open") * 100.0 / n, 4)).alias("internet_users_pct"),
        F.when(key % 3 == 1, F.round(F.col("partial") * 10.0 / n, 4)).alias("rd_expenditure_pct_gdp"),
    )


def weighted(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with weight 1/n. The counts are joined, not windowed: their partial
    aggregate copes with a publication that holds a large part of all pairs."""
    members = pairs.groupBy("publication_key").agg(F.count("*").alias("members"))
    weight = F.lit(1.0) / F.col("members")
    return pairs.join(members, "publication_key").withColumn("fractional_weight", weight)


def _lines(spark: SparkSession, sf_dir: str, column: str, alias: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("publication_key"), F.col(column).alias(alias))


def topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "l_partkey", "topic_key").distinct()


def institution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "l_suppkey", "institution_key").distinct()


def country_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("institution_key"), F.col("s_nationkey").cast("long").alias("country_key")
    )
    lines = _lines(spark, sf_dir, "l_suppkey", "institution_key").join(places, "institution_key")
    return lines.select("publication_key", "country_key").distinct()


def topic_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(topic_pairs(spark, sf_dir)).withColumns(
        {
            "topic_rank": (F.col("topic_key") % 5 + 1).cast("int"),
            "topic_score": F.col("fractional_weight") / 2,
            "is_primary_topic": F.lit(False),
        }
    )


ROLES = {
    "dim_date": date_rows,
    "dim_country": country_rows,
    "dim_topic": topic_rows,
    "dim_institution": institution_rows,
    "dim_source": source_rows,
    "fact_publication": publication_rows,
    "fact_country_year": panel_rows,
    "bridge_publication_topic": topic_bridge,
    "bridge_publication_country": lambda *at: weighted(country_pairs(*at)),
    "bridge_publication_institution": lambda *at: weighted(institution_pairs(*at)),
}


def role_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse({name: partial(build, spark, sf_dir) for name, build in ROLES.items()})


# The same roles as common table expressions; follows WITH.
ROLE_SQL = """
dim_country AS (
  SELECT n_nationkey::BIGINT AS country_key, 'A' || chr(65 + n_nationkey) AS country_code_iso2,
         'QA' || chr(65 + n_nationkey) AS country_code_iso3,
         CASE WHEN n_nationkey <> 10 THEN n_name END AS country_name,
         CASE WHEN n_nationkey <> 24 THEN 'R' || r_regionkey END AS region_id,
         CASE WHEN n_nationkey <> 24 THEN r_name END AS region_name,
         CASE n_nationkey // 5 WHEN 0 THEN 'HIC' WHEN 1 THEN 'UMC' WHEN 2 THEN 'LMC' WHEN 3 THEN 'LIC' END AS income_level_id,
         CASE n_nationkey // 5 WHEN 0 THEN 'High income' WHEN 1 THEN 'Upper middle income'
              WHEN 2 THEN 'Lower middle income' WHEN 3 THEN 'Low income' END AS income_level_name,
         n_nationkey <> 24 AS has_indicator_data
  FROM nation JOIN region ON n_regionkey = r_regionkey),
dim_topic AS (
  SELECT p_partkey AS topic_key, 'T' || p_partkey AS topic_id,
         CASE WHEN p_partkey % 41 <> 0 THEN p_name END AS topic_name,
         CASE WHEN p_partkey % 29 <> 0 THEN p_brand || '/' || p_type END AS subfield_id,
         CASE WHEN p_partkey % 29 <> 0 THEN p_type || ' of ' || p_brand END AS subfield_name,
         CASE WHEN p_partkey % 31 <> 0 THEN p_brand END AS field_id,
         CASE WHEN p_partkey % 31 <> 0 THEN lower(p_brand) END AS field_name,
         CASE WHEN p_partkey % 23 <> 0 THEN 'D' || right(p_brand, 1) END AS domain_id,
         CASE WHEN p_partkey % 23 <> 0 THEN 'Domain ' || right(p_brand, 1) END AS domain_name
  FROM part),
dim_institution AS (
  SELECT s_suppkey AS institution_key, 'I' || s_suppkey AS institution_id,
         CASE WHEN s_suppkey % 19 <> 0 THEN s_name END AS institution_name,
         CASE s_suppkey % 4 WHEN 0 THEN 'education' WHEN 1 THEN 'company' WHEN 2 THEN 'government' END AS institution_type,
         CASE WHEN s_suppkey % 17 <> 0 THEN 'A' || chr(65 + s_nationkey) END AS country_code_iso2
  FROM supplier),
dim_source AS (
  SELECT c_custkey AS source_key, 'S' || c_custkey AS source_id, c_name AS source_name,
         CASE WHEN c_custkey % 37 <> 0 THEN c_mktsegment END AS source_type,
         CASE WHEN c_custkey % 3 <> 0 THEN lpad(c_custkey::VARCHAR, 9, '0') END AS issn_l
  FROM customer),
dated_orders AS (
  SELECT *, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate::DATE END AS full_date FROM orders),
dim_date AS (
  SELECT DISTINCT year(full_date) * 10000 + month(full_date) * 100 + day(full_date) AS date_key, full_date,
         day(full_date) AS day_of_month, month(full_date) AS month_number,
         quarter(full_date) AS quarter_number, year(full_date) AS calendar_year
  FROM dated_orders WHERE full_date IS NOT NULL),
fact_publication AS (
  SELECT o_orderkey AS publication_key, 'W' || o_orderkey AS work_id,
         year(full_date) * 10000 + month(full_date) * 100 + day(full_date) AS date_key,
         full_date, year(full_date) AS calendar_year,
         CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS source_key,
         CASE WHEN o_orderkey % 53 <> 0 THEN o_orderpriority END AS publication_type,
         CASE WHEN o_orderkey % 59 <> 0 THEN o_orderstatus END AS language,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_open_access,
         1 AS publication_count,
         CASE WHEN o_orderkey % 97 <> 0 THEN greatest(floor(o_totalprice / 3000)::BIGINT - 5, 0) END AS citation_count
  FROM dated_orders),
bridge_publication_topic AS (
  SELECT publication_key, topic_key, 1e0 / count(*) OVER (PARTITION BY publication_key) AS fractional_weight
  FROM (SELECT DISTINCT l_orderkey AS publication_key, l_partkey AS topic_key FROM lineitem) pairs),
bridge_publication_country AS (
  SELECT publication_key, country_key, 1e0 / count(*) OVER (PARTITION BY publication_key) AS fractional_weight
  FROM (SELECT DISTINCT l_orderkey AS publication_key, s_nationkey::BIGINT AS country_key
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) pairs),
bridge_publication_institution AS (
  SELECT publication_key, institution_key, 1e0 / count(*) OVER (PARTITION BY publication_key) AS fractional_weight
  FROM (SELECT DISTINCT l_orderkey AS publication_key, l_suppkey AS institution_key FROM lineitem) pairs),
panel_sums AS (
  SELECT c_nationkey::BIGINT AS country_key, year(o_orderdate) AS year, count(*) AS n,
         round(sum(o_totalprice), 2) AS gdp,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS open_n,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS partial_n
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 24 GROUP BY 1, 2),
panel_values AS (
  SELECT *, CASE WHEN country_key = 3 AND year = 1997 THEN 0 ELSE n * 10000 END AS population,
         CASE WHEN NOT (country_key % 7 = 0 AND year = 1999) THEN gdp END AS gdp_current_usd
  FROM panel_sums),
fact_country_year AS (
  SELECT country_key, year, population, gdp_current_usd,
         round(gdp_current_usd / nullif(population, 0), 6) AS gdp_per_capita_current_usd,
         CASE WHEN country_key % 4 <> 0 THEN round(open_n * 100e0 / n, 4) END AS internet_users_pct,
         CASE WHEN country_key % 3 = 1 THEN round(partial_n * 10e0 / n, 4) END AS rd_expenditure_pct_gdp
  FROM panel_values)"""
