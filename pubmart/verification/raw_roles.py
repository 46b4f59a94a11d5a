"""Raw JSON records made from the driver's tables, and SQL for what they hold.

Each order becomes one work record whose nested parts follow from its keys by rule, written as
JSON text; some orders give two records that complete each other. The panel comes from
orders and customers. The SQL derives the same relations from the orders without any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmart.plans.reconcile import place_policy, reconcile
from pubmart.schemas import RECONCILED
from pubmart.session import stored
from pubmart.sources.records import typed_panel, typed_works
from pubmart.verification.roles import ROLE_SQL, country_rows, panel_rows, table

_KINDS = ("article", "review", "preprint", "book", "dataset", "book-chapter")


def _url(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"https://ids.example/{kind}"), number.cast("string"))


def _unless(condition: Column, value) -> Column:
    return F.when(~condition, value)


def _pick(names: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), (position + 1).cast("int"))


def _place(number: Column) -> Column:
    return F.concat(F.lit("A"), F.char(number % 24 + 65))


def _steps(size: Column) -> Column:
    """0 .. size-1; empty when size is 0."""
    return F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(F.array().cast("array<bigint>"))


def _named(identifier: Column, name: Column) -> Column:
    return F.struct(identifier.alias("id"), name.alias("display_name"))


def _topic_parts(order: Column, topic: Column) -> list[Column]:
    """A topic is named in records of even orders only, so that merging has to fill it."""
    field = topic % 7 + 10
    return [
        _url("T", topic).alias("id"),
        F.when(order % 2 == 0, F.concat(F.lit("  topic "), topic.cast("string"))).alias("display_name"),
        _named(
            _url("subfields/", topic % 3 + 1701), F.concat(F.lit("subfield "), (topic % 3).cast("string"))
        ).alias("subfield"),
        F.when(topic % 31 != 0, _named(_url("fields/", field), F.concat(F.lit("field "), field.cast("string")))).alias("field"),
        _named(_url("domains/", topic % 4), F.lit(None).cast("string")).alias("domain"),
    ]


def _institution(order: Column, number: Column) -> Column:
    code = F.when(number % 11 == 0, F.lit("")).when(number % 13 != 0, _place(number))
    return F.struct(
        _url("I", number).alias("id"),
        F.when(order % 3 != 0, F.concat(F.lit("institution "), number.cast("string"))).alias("display_name"),
        _pick(("education", "company", "government"), number % 3).alias("type"),
        code.alias("country_code"),
    )


_TASK_ROWS = 50_000


def spread(rows: DataFrame, each: int = _TASK_ROWS) -> DataFrame:
    """The rows dealt evenly to tasks of at most about ``each`` rows.

    A file is split by row groups, which hold any number of narrow rows; a task that parses what
    is made of one would grow with it. Dealt in turn, so no key decides and none can be too full.
    """
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-rows.count() // each)))


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per record, in a column named value."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dated = k % 101 != 0
    size = k % 4

    def authorship(j: Column) -> Column:
        return F.struct(
            F.when((k + j) % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_place(c + j))).alias("countries"),
            F.array(_institution(k, c * 2 + j)).alias("institutions"),
        )

    source = F.struct(
        _url("S", c).alias("id"),
        F.when(k % 2 == 1, F.concat(F.lit("source "), c.cast("string"))).alias("display_name"),
        _unless(c % 37 == 0, F.lit("journal")).alias("type"),
        F.lpad(c.cast("string"), 8, "0").alias("issn_l"),
    )
    first_copy = F.col("copy") == 1
    oa = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    record = F.struct(
        _url("W", k).alias("id"),
        _unless(first_copy & (k % 89 == 0), _url("doi/", k)).alias("doi"),
        F.when(k % 7 != 0, F.concat(F.lit("Title "), k.cast("string"))).alias("title"),
        F.concat(F.lit(" Title "), k.cast("string"), F.lit(" ")).alias("display_name"),
        F.when(dated, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publication_date"),
        F.when(dated, F.year("o_orderdate")).alias("publication_year"),
        _pick(_KINDS, k % 6).alias("type"),
        _unless(k % 59 == 0, F.col("o_orderstatus")).alias("language"),
        _unless(k % 97 == 0, F.floor(F.col("o_totalprice") / 3000)).alias("cited_by_count"),
        _unless(k % 47 == 0, k % 43 == 0).alias("is_retracted"),
        F.when(size > 0, F.struct(*_topic_parts(k, c + k % size))).alias("primary_topic"),
        F.transform(
            _steps(size), lambda i: F.struct(*_topic_parts(k, c + i), (1 - i * 0.25).alias("score"))
        ).alias("topics"),
        F.transform(_steps(k % 3), authorship).alias("authorships"),
        F.when(c % 20 != 0, F.struct(F.when(c % 10 != 0, source).alias("source"))).alias("primary_location"),
        _unless(k % 61 == 0, F.struct(oa.alias("is_oa"))).alias("open_access"),
    )
    copies = F.explode(F.when(k % 89 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    orders = spread(table(spark, sf_dir, "orders"))
    orders = orders.withColumn("copy", copies)
    return orders.select(F.to_json(record).alias("value"))


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = country_rows(spark, sf_dir).drop("has_indicator_data")
    rows = panel_rows(spark, sf_dir).drop("country_year_key").join(places, "country_key")
    return rows.drop("country_key").select(F.to_json(F.struct("*")).alias("value"))


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, typed) -> DataFrame:
    """Records or a relation as a compressed table, as a load stages them; kept per application."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STAGED:
        _STAGED[at] = stored(typed(), name.replace(" ", "-"))
    return _STAGED[at]


def typed_role_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    def typed():
        return typed_works(raw_works(spark, sf_dir))

    return staged(spark, sf_dir, "works", typed)


def typed_role_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    def typed():
        return typed_panel(raw_panel(spark, sf_dir))

    return staged(spark, sf_dir, "panel", typed)


def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules over all raw records, counted by name."""
    found = typed_role_works(spark, sf_dir).select("problems").unionAll(
        typed_role_panel(spark, sf_dir).select("problems")
    )
    return found.select(F.explode("problems").alias("problem")).groupBy("problem").count()


def broken_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the raw works after every 40th record of four kinds was damaged."""
    k = F.regexp_extract("value", r"/W(\d+)", 1).cast("bigint")

    def damaged(kind: int, pattern: str, text: str) -> Column:
        return F.when(F.col("kind") == kind, F.regexp_replace("value", pattern, text))

    value = F.coalesce(
        damaged(0, ".{5}$", ""),
        damaged(1, '"display_name":" Title [0-9]+ "', '"display_name":5'),
        damaged(2, '"cited_by_count":', '"cited_by_count":-1,"cited_before":'),
        damaged(3, '"publication_year":', '"publication_year":99999999999,"year_before":'),
        F.col("value"),
    )
    lines = raw_works(spark, sf_dir).withColumn("kind", k % 40).select(value.alias("value"))
    # staged first: an explode on the parsing projection would parse each record again
    typed = staged(spark, sf_dir, "broken works", lambda: typed_works(lines).select("problems"))
    return typed.select(F.explode("problems").alias("problem")).groupBy("problem").count()


BROKEN_SQL = """WITH damaged AS (
  SELECT o_orderkey AS k, o_orderkey % 40 AS kind, CASE WHEN o_orderkey % 89 = 0 THEN 2 ELSE 1 END AS copies FROM orders)
SELECT problem, sum(copies)::BIGINT AS count FROM (
  SELECT copies, CASE kind WHEN 0 THEN ['malformed JSON object']
    WHEN 1 THEN CASE WHEN k % 7 = 0 THEN ['display_name is not text'] ELSE ['display_name is not text', 'title differs from display_name'] END
    WHEN 2 THEN CASE WHEN k % 97 = 0 THEN [] ELSE ['cited_by_count is negative'] END
    WHEN 3 THEN CASE WHEN k % 101 = 0 THEN [] ELSE ['publication_year is out of range', 'publication_date and publication_year differ'] END
    ELSE [] END AS problems FROM damaged), unnest(problems) AS u(problem) GROUP BY problem"""


def role_reconciled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = reconcile(
        typed_role_works(spark, sf_dir), typed_role_panel(spark, sf_dir), place_policy(spark)
    )
    return {name: rows.select(*RECONCILED[name]) for name, rows in tables.items()}


_PLACE_OF = "'A' || chr((65 + ({0}) % 24)::INT)"
_WORK = "'https://ids.example/W' || o_orderkey AS work_id"

RAW_SQL = (
    ROLE_SQL.strip()
    + f""",
named_topics AS (
  SELECT o_orderkey, i AS position, o_custkey + i AS t, i = o_orderkey % (o_orderkey % 4) AS is_primary
  FROM orders, unnest(range(o_orderkey % 4)) AS u(i)),
authors AS (SELECT o_orderkey, o_custkey, j FROM orders, unnest(range(o_orderkey % 3)) AS u(j)),
named_institutions AS (
  SELECT o_orderkey, o_custkey * 2 + j AS n FROM authors),
r_topic AS (
  SELECT 'https://ids.example/T' || t AS topic_id, max(CASE WHEN o_orderkey % 2 = 0 THEN 'topic ' || t END) AS topic_name,
         'https://ids.example/subfields/' || (t % 3 + 1701) AS subfield_id, 'subfield ' || (t % 3) AS subfield_name,
         CASE WHEN t % 31 <> 0 THEN 'https://ids.example/fields/' || (t % 7 + 10) END AS field_id,
         CASE WHEN t % 31 <> 0 THEN 'field ' || (t % 7 + 10) END AS field_name,
         'https://ids.example/domains/' || (t % 4) AS domain_id, NULL::VARCHAR AS domain_name
  FROM named_topics GROUP BY t),
r_institution AS (
  SELECT 'https://ids.example/I' || n AS institution_id, max(CASE WHEN o_orderkey % 3 <> 0 THEN 'institution ' || n END) AS display_name,
         CASE n % 3 WHEN 0 THEN 'education' WHEN 1 THEN 'company' ELSE 'government' END AS institution_type,
         CASE WHEN n % 11 <> 0 AND n % 13 <> 0 THEN {_PLACE_OF.format("n")} END AS country_code_iso2
  FROM named_institutions GROUP BY n),
r_source AS (
  SELECT 'https://ids.example/S' || o_custkey AS source_id, max(CASE WHEN o_orderkey % 2 = 1 THEN 'source ' || o_custkey END) AS display_name,
         CASE WHEN o_custkey % 37 <> 0 THEN 'journal' END AS source_type, lpad(o_custkey::VARCHAR, 8, '0') AS issn_l
  FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey),
r_work AS (
  SELECT {_WORK}, 'https://ids.example/doi/' || o_orderkey AS doi, 'Title ' || o_orderkey AS title,
         full_date AS publication_date, year(full_date) AS publication_year,
         ['article', 'review', 'preprint', 'book', 'dataset', 'book-chapter'][o_orderkey % 6 + 1] AS work_type,
         CASE WHEN o_orderkey % 59 <> 0 THEN o_orderstatus END AS language,
         CASE WHEN o_orderkey % 97 <> 0 THEN floor(o_totalprice / 3000)::BIGINT END AS cited_by_count,
         CASE WHEN o_orderkey % 4 > 0 THEN 'https://ids.example/T' || (o_custkey + o_orderkey % (o_orderkey % 4)) END AS primary_topic_id,
         CASE WHEN o_custkey % 10 <> 0 THEN 'https://ids.example/S' || o_custkey END AS source_id,
         CASE WHEN o_orderkey % 61 <> 0 AND o_orderstatus IN ('F', 'O') THEN o_orderstatus = 'F' END AS is_open_access,
         o_orderkey, o_custkey, CASE WHEN o_orderkey % 47 <> 0 THEN o_orderkey % 43 = 0 END AS is_retracted
  FROM dated_orders),
r_work_topic AS (
  SELECT {_WORK}, 'https://ids.example/T' || t AS topic_id, position + 1 AS topic_rank, 1 - position * 0.25e0 AS topic_score
  FROM named_topics),
r_work_country AS (
  SELECT {_WORK}, {_PLACE_OF.format("o_custkey + j")} AS country_code_iso2 FROM authors WHERE (o_orderkey + j) % 5 <> 0
  UNION SELECT {_WORK}, {_PLACE_OF.format("n")} FROM named_institutions WHERE n % 11 <> 0 AND n % 13 <> 0),
r_work_institution AS (
  SELECT DISTINCT {_WORK}, 'https://ids.example/I' || n AS institution_id FROM named_institutions),
r_country_year_indicator AS (
  SELECT country_code_iso2, f.* EXCLUDE (country_key) FROM fact_country_year f JOIN dim_country USING (country_key)),
r_country AS (
  SELECT * EXCLUDE (country_key) FROM dim_country WHERE country_code_iso2 IN (SELECT country_code_iso2 FROM r_country_year_indicator))"""
)
