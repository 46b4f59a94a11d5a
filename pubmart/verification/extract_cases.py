"""Sampling, panel reshaping, profiling, checks and text functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubmart.functions import text as X
from pubmart.operators import checks as C
from pubmart.operators import merge, profile
from pubmart.operators import reshape as R
from pubmart.operators import sample as S
from pubmart.plans import gates
from pubmart.schemas import COUNTRY_RECORD, MEASURES, WAREHOUSE_KEYS, WAREHOUSE_REFERENCES
from pubmart.sources import landed as L
from pubmart.sources import sinks
from pubmart.verification.case import Registry
from pubmart.verification.raw_roles import RAW_SQL, staged, typed_role_panel, typed_role_works
from pubmart.verification.roles import ROLE_SQL, role_warehouse, table, topic_pairs

YEARS = tuple(range(1995, 2002))
TARGET = 500
_CORPUS_SQL = """corpus AS (SELECT *, year(publication_date) AS y FROM r_work
  WHERE o_orderkey % 4 > 0 AND (o_custkey + o_orderkey % (o_orderkey % 4)) % 3 + 1701 = 1702
    AND publication_date IS NOT NULL AND work_type <> 'dataset' AND NOT is_retracted)"""
_ALLOCATION_SQL = f"""population AS (SELECT y AS year, count(*) AS population FROM corpus GROUP BY 1),
shares AS (SELECT year, population, ({TARGET} * population) // sum(population) OVER () AS base,
  ({TARGET} * population) % sum(population) OVER () AS remainder FROM population),
allocation AS (SELECT year, population, (base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, year)
  <= {TARGET} - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS allocation FROM shares)"""


def _raw(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([RAW_SQL, *ctes]) + "\n" + select


def _roles(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([ROLE_SQL.strip(), *ctes]) + "\n" + select


def _hashed(works):
    return works.withColumn("line_hash", F.sha2(F.to_json(F.struct(*works.columns)), 256))


def _lines(spark, sf_dir):
    """All qualifying lines with their hashes; some works have two, with different text."""
    # staged, as a load does: a sample reads them several times, and a line's hash costs a JSON text
    return staged(spark, sf_dir, "corpus", lambda: _hashed(typed_role_works(spark, sf_dir).where(S.in_corpus(YEARS))))


def _reject_reasons(spark, sf_dir):
    """Works by the first rule they fail: every line is judged, each work counts by the line that the operator picks."""
    judged = _hashed(typed_role_works(spark, sf_dir)).select(
        "work_id", "line_hash", "publication_year", S.reject_reason(range(1996, 2001)).alias("reason")
    )
    works = S.one_line_each(judged, "reason")
    return works.groupBy("reason").agg(F.count("*").alias("works"))


def _corpus(spark, sf_dir):
    """Whole works, each by the line that the operator picks."""
    lines = _lines(spark, sf_dir)
    return lines.join(S.one_line_each(lines), ["work_id", "line_hash"], "left_semi")


def _allocation(spark, sf_dir):
    return S.allocate(S.population_by_year(_corpus(spark, sf_dir)), TARGET)


def _sample(spark, sf_dir):
    return S.stratified_sample(_corpus(spark, sf_dir), _allocation(spark, sf_dir))


def _countries(spark, sf_dir):
    """The panel's countries and two that the panel lacks."""
    return role_warehouse(spark, sf_dir).dim_country.select("country_code_iso3", "country_code_iso2")


def _observations(spark, sf_dir):
    """The panel in long form, plus rows of every rejected kind derived from it."""
    panel = typed_role_panel(spark, sf_dir)
    codes = F.create_map(*[F.lit(x) for f, code in R.INDICATORS.items() for x in (f, code)])
    long = profile.long_form(panel).select(
        codes[F.col("field")].alias("indicator"),
        "country_code_iso3",
        F.col("year").cast("string").alias("date"),
        F.to_variant_object(F.struct("value")).alias("boxed"),
    )
    value = F.try_variant_get("boxed", "$.value", "variant").alias("value")
    text = F.parse_json(F.lit('"n/a"')).alias("value")
    base = ["indicator", "country_code_iso3", "date"]
    good = long.select(*base, value)
    first = F.col("indicator") == "SP.POP.TOTL"
    return (
        good.unionAll(long.where(first).select(F.lit("XX.YY"), *base[1:], value))
        .unionAll(long.where(first).select(base[0], F.lit("WLD"), base[2], value))
        .unionAll(long.where(first).select(*base[:2], F.lit("20x1"), value))
        .unionAll(long.where(first).select(*base[:2], F.lit("1960"), value))
        .unionAll(long.where(first & (F.col("date") == "1999")).select(*base, value))
        .unionAll(long.where(F.col("date") == "2001").select(base[0], F.lit("QAY"), base[2], text))
    )


def _triaged(spark, sf_dir):
    return R.triage_observations(_observations(spark, sf_dir), _countries(spark, sf_dir), YEARS)


def _pivoted(spark, sf_dir):
    return R.pivot_observations(_triaged(spark, sf_dir), _countries(spark, sf_dir), YEARS)


_LONG_SQL = """wide AS (SELECT country_code_iso3, year, population::DOUBLE AS population, gdp_current_usd::DOUBLE AS gdp_current_usd,
    gdp_per_capita_current_usd::DOUBLE AS gdp_per_capita_current_usd, internet_users_pct::DOUBLE AS internet_users_pct,
    rd_expenditure_pct_gdp::DOUBLE AS rd_expenditure_pct_gdp FROM r_country_year_indicator JOIN r_country USING (country_code_iso2)),
long AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR field IN
  (population, gdp_current_usd, gdp_per_capita_current_usd, internet_users_pct, rd_expenditure_pct_gdp)))"""


def _page_text(spark, sf_dir):
    """Events as landed pages, one endpoint per event type and one page per user."""
    events = table(spark, sf_dir, "events")
    users = events.select("event_type", "user_id").distinct()
    body = F.concat(
        F.lit('[{"page":1,"pages":1,"total":'),
        (F.col("user_id") % 3).cast("string"),
        F.lit('},'),
        F.when(F.col("user_id") % 3 == 0, F.lit("null"))
        .when(F.col("user_id") % 3 == 1, F.lit('[{"id":"a ","name":"x","region":{"id":"NA","value":"all"}}]'))
        .otherwise(F.lit('[{"id":"b","iso2Code":"B1","region":{"id":"EU"}},{"id":"c","region":{"value":"Aggregates"}}]')),
        F.lit("]"),
    )
    endpoint = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    return users.select(endpoint.alias("endpoint"), body.alias("value"))


def _page_records(spark, sf_dir):
    return L.page_records(L.parse_pages(_page_text(spark, sf_dir)), COUNTRY_RECORD)


_PAGES_SQL = """pages AS (SELECT DISTINCT event_type || '-' || user_id AS endpoint, user_id % 3 AS n FROM events)"""


def _checks(spark, sf_dir):
    """All generic checks over the role warehouse; its faults are put in by the roles."""
    w = role_warehouse(spark, sf_dir)
    panel, fact, country = w.fact_country_year, w.fact_publication, w.dim_country
    measures = ("population", "gdp_current_usd")
    shifted = panel.withColumn(
        "population", F.when(F.col("country_key") == 5, F.col("population") + 1).otherwise(F.col("population"))
    )
    return C.all_checks(
        C.table_checks(w.tables(), WAREHOUSE_KEYS, WAREHOUSE_REFERENCES)
        + [
            C.duplicate_keys(table(spark, sf_dir, "lineitem"), "lineitem", ("l_orderkey", "l_linenumber")),
            C.orphans(fact, "publication_key", w.bridge_publication_topic, "publication_key", "fact_publication"),
            C.same_count(country, table(spark, sf_dir, "nation"), "dim_country"),
            C.same_count(fact, w.dim_source, "fact_publication"),
            C.missing_values(country, "dim_country", ("country_name",)),
            C.holds(fact, "citations below 100", "fact_publication", F.col("citation_count") < 100),
            C.holds(country, "country codes", "dim_country", X.is_country_code(F.col("country_code_iso2"), 2)),
            C.same_nulls(panel, shifted, "fact_country_year", measures),
            C.same_values(panel, shifted, "fact_country_year", ("country_key", "year"), measures),
            C.not_empty(fact, "fact_publication"),
            gates.fabricated_indicators(panel, country, "country_key", "fact_country_year"),
        ]
        + [C.weight_sums(w.table(name), name) for name in ("bridge_publication_topic", "bridge_publication_country", "bridge_publication_institution")]
    )


def _checks_sql() -> str:
    rows = [(f"'{n}'", "'duplicate key'", f"(SELECT count(*) FROM (SELECT 1 FROM {n} GROUP BY {', '.join(k)} HAVING count(*) > 1))")
            for n, k in WAREHOUSE_KEYS.items()]
    rows += [
        (f"'{child}.{column}'", "'orphan'",
         f"(SELECT count(*) FROM {child} c LEFT JOIN {parent} p ON p.{key} = c.{column} WHERE c.{column} IS NOT NULL AND p.{key} IS NULL)")
        for child, column, parent, key in WAREHOUSE_REFERENCES
    ]
    rows += [
        ("'lineitem'", "'duplicate key'", "(SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))"),
        ("'fact_publication.publication_key'", "'orphan'", "(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"),
        ("'dim_country'", "'row count'", "0"),
        ("'fact_publication'", "'row count'", "(SELECT abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM customer)))"),
        ("'dim_country'", "'missing value'", "1"),
        ("'fact_publication'", "'citations below 100'", "(SELECT count(*) FROM fact_publication WHERE citation_count >= 100)"),
        ("'dim_country'", "'country codes'", "0"),
        ("'fact_country_year'", "'null count'", "0"),
        ("'fact_country_year'", "'value parity'", "(SELECT count(*) FROM fact_country_year WHERE country_key = 5)"),
        ("'fact_publication'", "'not empty'", "0"),
        ("'fact_country_year'", "'fabricated indicator'", "0"),
    ]
    rows += [(f"'{name}'", "'weights sum to one'", "0") for name in ("bridge_publication_topic", "bridge_publication_country", "bridge_publication_institution")]
    body = "\nUNION ALL ".join(f'SELECT {check} AS "check", {relation} AS relation, {n}::BIGINT AS violations' for relation, check, n in rows)
    return f"WITH {ROLE_SQL.strip()}\n{body}"


def _text_functions(spark, sf_dir):
    """Cleaning functions over values derived from parts and suppliers."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit(" \t"), "p_name", F.lit("\n ")).alias("raw"), F.col("p_partkey").alias("k"))
    raw = F.when(F.col("k") % 10 == 0, F.lit("  \t ")).otherwise(F.col("raw"))
    url = F.concat(F.lit("https://ids.example/"), F.col("k").cast("string"), F.repeat(F.lit("/"), (F.col("k") % 3).cast("int")))
    number = F.when(F.col("k") % 2 == 0, F.concat(F.col("k").cast("string"), F.lit(".5"))).otherwise(F.lit("n/a"))
    code = F.concat(F.char(F.col("k") % 26 + 65), F.char(F.col("k") % 40 + 65))
    return parts.select(
        "k",
        X.clean_text(raw).alias("cleaned"),
        X.trimmed_or_empty(raw).alias("trimmed"),
        X.short_id(url).alias("short_id"),
        X.lenient_number(number).alias("number"),
        X.is_country_code(code, 2).alias("is_code"),
        X.safe_slug(F.concat_ws(" & ", F.col("raw"), F.col("k").cast("string"))).alias("slug"),
    )


def _digest_sql(name: str, columns: tuple[str, ...]) -> str:
    """The digest of all columns, sorted by name: sums of the words of each row's SHA-256."""
    texts = [f"CAST(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,12)) AS VARCHAR)" if c == "o_totalprice" else f"CAST({c} AS VARCHAR)" for c in columns]
    line = " || ',' || ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts)
    words = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)), 0) AS w{i}" for i in range(8))
    joined = " || ':' || ".join(f"CAST(w{i} AS VARCHAR)" for i in range(8))
    return f"""WITH hashed AS (SELECT sha256({line}) AS h FROM {name}),
      summed AS (SELECT count(*) AS row_count, {words} FROM hashed)
      SELECT row_count, sha256(row_count || ':' || {joined}) AS digest FROM summed"""


def _merged_parts(spark, sf_dir):
    """Line items merged per order, ship date known on returned lines only."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("supplier"),
    )
    merged = merge.merge_entities(lines, ("l_orderkey",), ("l_orderkey", "status", "supplier"))
    clean = F.when(F.size("conflicts") == 0, F.col("supplier"))
    return merged.select("l_orderkey", clean.alias("supplier"), F.array_join("conflicts", ",").alias("conflicts"))


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "corpus_population",
        lambda spark, sf_dir: S.population_by_year(_corpus(spark, sf_dir)),
        _raw(_CORPUS_SQL, select="SELECT y AS year, count(*) AS population FROM corpus GROUP BY 1"),
    )
    add("sample_allocation", _allocation, _raw(_CORPUS_SQL, _ALLOCATION_SQL, select="SELECT * FROM allocation"))
    add(
        "stratified_sample",
        lambda spark, sf_dir: _sample(spark, sf_dir).select("work_id", "publication_year"),
        _raw(
            _CORPUS_SQL,
            _ALLOCATION_SQL,
            """ranked AS (SELECT work_id, y, row_number() OVER (PARTITION BY y ORDER BY md5((20260910 + y)::VARCHAR || ':' || work_id), work_id) AS n FROM corpus)""",
            select="SELECT work_id, y AS publication_year FROM ranked JOIN allocation ON year = y WHERE n <= allocation",
        ),
    )
    add(
        "sample_checks",
        lambda spark, sf_dir: S.sample_checks(_sample(spark, sf_dir), _allocation(spark, sf_dir), TARGET, years=YEARS),
        """SELECT unnest(['sample size', 'allocation met', 'duplicate key', 'guardrails']) AS "check",
          unnest(['sample', 'sample', 'sample.work_id', 'sample']) AS relation, 0::BIGINT AS violations""",
    )
    add(
        "sample_checks_of_all_lines",
        # every line is taken for a sample: wrong sizes, doubled works, and works beyond the guardrails' years
        lambda spark, sf_dir: S.sample_checks(_lines(spark, sf_dir), _allocation(spark, sf_dir), TARGET, years=YEARS[1:]),
        _raw(
            _CORPUS_SQL,
            _ALLOCATION_SQL,
            "lines AS (SELECT y, o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN 2 ELSE 1 END AS n FROM corpus)",
            "by_year AS (SELECT y, sum(n) AS drawn FROM lines GROUP BY y)",
            select=f"""SELECT 'sample size' AS "check", 'sample' AS relation, (sum(n) <> {TARGET})::BIGINT AS violations FROM lines
            UNION ALL SELECT 'allocation met', 'sample', count(*) FILTER (WHERE coalesce(drawn, 0) <> allocation)
              FROM allocation LEFT JOIN by_year ON y = year
            UNION ALL SELECT 'duplicate key', 'sample.work_id', count(*) FILTER (WHERE n > 1) FROM lines
            UNION ALL SELECT 'guardrails', 'sample', coalesce(sum(n) FILTER (WHERE y = {YEARS[0]}), 0)::BIGINT FROM lines""",
        ),
    )
    add(
        "reject_reasons",
        _reject_reasons,
        _raw(
            """judged AS (SELECT CASE WHEN publication_year IS NULL OR publication_year NOT BETWEEN 1996 AND 2000 THEN 'publication_year'
              WHEN work_type = 'dataset' THEN 'work_type' WHEN is_retracted IS NULL OR is_retracted THEN 'retracted_or_unknown'
              WHEN o_orderkey % 4 = 0 THEN 'primary_topic'
              WHEN (o_custkey + o_orderkey % (o_orderkey % 4)) % 3 <> 1 THEN 'primary_topic_subfield' END AS reason FROM r_work)""",
            select="SELECT reason, count(*) AS works FROM judged GROUP BY 1",
        ),
    )
    add(
        "panel_skeleton",
        lambda spark, sf_dir: R.build_skeleton(_countries(spark, sf_dir), YEARS),
        _roles(select="SELECT country_code_iso3, country_code_iso2, y AS year FROM dim_country, unnest(range(1995, 2002)) AS u(y)"),
    )
    add(
        "observation_triage",
        lambda spark, sf_dir: R.triage_counts(_triaged(spark, sf_dir)),
        _raw(
            _LONG_SQL,
            """codes AS (SELECT unnest(['population', 'gdp_current_usd', 'gdp_per_capita_current_usd', 'internet_users_pct', 'rd_expenditure_pct_gdp']) AS field,
              unnest(['SP.POP.TOTL', 'NY.GDP.MKTP.CD', 'NY.GDP.PCAP.CD', 'IT.NET.USER.ZS', 'GB.XPD.RSDV.GD.ZS']) AS indicator)""",
            "cells AS (SELECT count(*) AS n, count(*) FILTER (WHERE year = 1999) AS n99, count(*) FILTER (WHERE year = 2001) AS n01 FROM r_country_year_indicator)",
            select="""SELECT 'applied' AS status, indicator, CASE WHEN indicator = 'SP.POP.TOTL' THEN n - n99 ELSE n END AS observations FROM codes, cells
            UNION ALL SELECT 'duplicate', indicator, n01 + CASE WHEN indicator = 'SP.POP.TOTL' THEN 2 * n99 ELSE 0 END FROM codes, cells
            UNION ALL SELECT 'unexpected_indicator', 'XX.YY', n FROM cells
            UNION ALL SELECT unnest(['not_a_country', 'bad_year', 'out_of_period']), 'SP.POP.TOTL', n FROM cells""",
        ),
    )
    add(
        "panel_pivot",
        _pivoted,
        _raw(
            """cells AS (SELECT c.country_code_iso3, c.country_code_iso2, y AS year, CASE WHEN y <> 1999 THEN population END AS population,
              gdp_current_usd, gdp_per_capita_current_usd, internet_users_pct, rd_expenditure_pct_gdp
              FROM dim_country c CROSS JOIN unnest(range(1995, 2002)) AS u(y)
              LEFT JOIN r_country_year_indicator i ON i.country_code_iso2 = c.country_code_iso2 AND i.year = y)""",
            select="SELECT * REPLACE (population::DOUBLE AS population) FROM cells",
        ),
    )
    add(
        "panel_completeness",
        lambda spark, sf_dir: profile.completeness(typed_role_panel(spark, sf_dir)),
        _raw(
            _LONG_SQL,
            select="""SELECT field, year, count(value) AS present, count(*) - count(value) AS missing,
              round(count(value) * 100e0 / count(*), 4) AS coverage_pct, round((count(*) - count(value)) * 100e0 / count(*), 4) AS missing_pct
            FROM long GROUP BY GROUPING SETS ((field), (field, year))""",
        ),
    )
    add(
        "countries_without_values",
        lambda spark, sf_dir: profile.countries_without_values(typed_role_panel(spark, sf_dir)),
        _raw(_LONG_SQL, select="SELECT field, country_code_iso3 FROM long GROUP BY 1, 2 HAVING count(value) = 0"),
    )
    add(
        "country_coverage",
        lambda spark, sf_dir: profile.country_coverage(typed_role_panel(spark, sf_dir), "rd_expenditure_pct_gdp"),
        _raw(
            "per_country AS (SELECT country_code_iso2, count(rd_expenditure_pct_gdp) AS n FROM r_country_year_indicator GROUP BY 1)",
            select="SELECT count(*) FILTER (WHERE n > 0) AS countries_with_a_value, count(*) FILTER (WHERE n = 0) AS countries_without_a_value FROM per_country",
        ),
    )
    add(
        "panel_all_null_rows",
        lambda spark, sf_dir: profile.all_null_rows(typed_role_panel(spark, sf_dir), MEASURES[3:]),
        _raw(
            select="""SELECT country_code_iso3, year FROM r_country_year_indicator JOIN r_country USING (country_code_iso2)
            WHERE internet_users_pct IS NULL AND rd_expenditure_pct_gdp IS NULL"""
        ),
    )
    add(
        "panel_out_of_range",
        lambda spark, sf_dir: profile.out_of_range(
            typed_role_panel(spark, sf_dir), {**profile.RANGES, "internet_users_pct": (30, True, 36)}
        ),
        _raw(
            _LONG_SQL,
            select="""SELECT country_code_iso3, year, field, round(value, 6) AS value FROM long WHERE (field = 'population' AND value <= 0)
            OR (field LIKE 'gdp%' AND value < 0) OR (field = 'internet_users_pct' AND NOT value BETWEEN 30 AND 36)
            OR (field = 'rd_expenditure_pct_gdp' AND NOT value BETWEEN 0 AND 100)""",
        ),
    )
    add(
        "panel_rows_by_year",
        lambda spark, sf_dir: profile.rows_by_year(typed_role_panel(spark, sf_dir)),
        _raw(select="SELECT year, count(*) AS rows FROM r_country_year_indicator GROUP BY 1"),
    )
    add(
        "panel_checks",
        lambda spark, sf_dir: profile.panel_checks(typed_role_panel(spark, sf_dir), _countries(spark, sf_dir), YEARS),
        _raw(
            select="""SELECT unnest(['not empty', 'not empty', 'duplicate key', 'year set', 'iso3 present', 'known country', 'complete grid']) AS "check",
            unnest(['panel', 'countries', 'panel', 'panel', 'panel', 'panel', 'panel']) AS relation,
            unnest([0, 0, 0, 0, 0, 0, (SELECT count(*) * 7 FROM nation) - (SELECT count(*) FROM r_country_year_indicator)])::BIGINT AS violations"""
        ),
    )
    add("generic_checks", _checks, _checks_sql())
    add(
        "entity_merge",
        _merged_parts,
        """WITH rows AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS status,
          CASE WHEN l_linenumber = 1 THEN l_suppkey END AS supplier FROM lineitem),
        merged AS (SELECT l_orderkey, max(supplier) AS s, count(DISTINCT status) > 1 AS a, count(DISTINCT supplier) > 1 AS b FROM rows GROUP BY 1)
        SELECT l_orderkey, CASE WHEN NOT a AND NOT b THEN s END AS supplier,
          CASE WHEN a AND b THEN 'status,supplier' WHEN a THEN 'status' WHEN b THEN 'supplier' ELSE '' END AS conflicts FROM merged""",
    )
    add(
        "text_functions",
        _text_functions,
        r"""WITH parts AS (SELECT p_partkey AS k, p_name AS name FROM part),
        raw AS (SELECT k, name, CASE WHEN k % 10 = 0 THEN '' ELSE name END AS t FROM parts)
        SELECT k, nullif(t, '') AS cleaned, t AS trimmed, k::VARCHAR AS short_id,
          CASE WHEN k % 2 = 0 THEN k + 0.5e0 END AS number,
          (k % 40 < 26)::VARCHAR AS is_code,
          trim(regexp_replace(lower(name || '-' || k), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM raw""",
    )
    add(
        "landed_page_records",
        lambda spark, sf_dir: _page_records(spark, sf_dir).select(
            "endpoint",
            "id",
            "iso2Code",
            "name",
            F.col("region.id").alias("region_id"),
            F.col("region.value").alias("region_value"),
        ),
        f"""WITH {_PAGES_SQL}
        SELECT endpoint, 'a ' AS id, NULL::VARCHAR AS "iso2Code", 'x' AS name, 'NA' AS region_id, 'all' AS region_value FROM pages WHERE n = 1
        UNION ALL SELECT endpoint, 'b', 'B1', NULL, 'EU', NULL FROM pages WHERE n = 2
        UNION ALL SELECT endpoint, 'c', NULL, NULL, NULL, 'Aggregates' FROM pages WHERE n = 2""",
    )
    add(
        "landed_page_checks",
        lambda spark, sf_dir: L.page_checks(L.parse_pages(_page_text(spark, sf_dir))),
        """SELECT unnest(['page shape', 'pages complete', 'page count constant', 'declared records']) AS "check",
          unnest(['pages', 'endpoints', 'endpoints', 'endpoints']) AS relation, 0::BIGINT AS violations""",
    )
    add(
        "landed_countries",
        lambda spark, sf_dir: L.split_countries(_page_records(spark, sf_dir))[0],
        f"""WITH {_PAGES_SQL} SELECT 'b' AS country_code_iso3, 'B1' AS country_code_iso2, '' AS country_name, 'EU' AS region_id,
          '' AS region_name, '' AS income_level_id, '' AS income_level_name FROM pages WHERE n = 2""",
    )
    add(
        "event_properties",
        lambda spark, sf_dir: table(spark, sf_dir, "events").select(
            "event_id", F.from_json("props", "k BIGINT")["k"].alias("k")
        ),
        "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    )
    add(
        "row_digest",
        lambda spark, sf_dir: sinks.rows_digest(table(spark, sf_dir, "orders")),
        _digest_sql("orders", ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")),
    )
    add(
        "calendar_spine",
        lambda spark, sf_dir: R.calendar_spine(
            table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")), "day", "Month"
        ),
        """SELECT unnest(generate_series(date_trunc('month', min(l_shipdate)), date_trunc('month', max(l_shipdate)), INTERVAL 1 MONTH))::DATE::VARCHAR AS period
        FROM lineitem""",
    )
    add(
        "members_per_publication",
        lambda spark, sf_dir: topic_pairs(spark, sf_dir)
        .groupBy("publication_key")
        .agg(F.count("*").alias("members"))
        .groupBy("members")
        .agg(F.count("*").alias("publications")),
        """SELECT members, count(*) AS publications FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1) GROUP BY 1""",
    )
