"""Loads from raw files to published tables. Each publishes only after all its checks pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmart.operators import checks as C
from pubmart.operators import profile as P
from pubmart.operators import reshape as R
from pubmart.operators import sample as S
from pubmart.operators.nested import work_countries
from pubmart.plans import gates
from pubmart.plans.build import build_warehouse
from pubmart.plans.reconcile import (
    panel_countries,
    place_policy,
    reconcile,
    uncovered_codes,
    unrecognised_codes,
)
from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import (
    ALLOWED_WORK_TYPES,
    CORPUS_SUBFIELD,
    COUNTRY_RECORD,
    END_YEAR,
    INDICATOR_RECORD,
    INDICATORS,
    OBSERVATION_RECORD,
    RECONCILED,
    SAMPLE_SEED,
    SAMPLE_TARGET,
    SOURCE_RECORD,
    START_YEAR,
    WAREHOUSE_INPUT,
    YEARS,
)
from pubmart.sources import landed as L
from pubmart.sources import sinks
from pubmart.sources.records import json_lines, read_panel, typed_works
from pubmart.sources.releases import Release, open_table, open_warehouse, path_exists, table_path

_SHOWN = 20  # examples named in an error; the counts are complete
_LISTED = 1000  # unexpected codes listed in a manifest, which also holds their number


def read_manifest(spark: SparkSession, path: str | None) -> dict:
    """Checksums a manifest records; empty without a manifest."""
    if path is None or not path_exists(spark, path):
        return {}
    document = spark.read.schema("sha256 STRING, digest STRING").json(path, multiLine=True).first()
    return document.asDict() if document else {}


def _stage_records(release: Release, name: str, typed: DataFrame) -> DataFrame:
    """Write typed records once; stop when any record breaks a rule."""
    broken = F.count_if(F.size("problems") > 0)
    staged, seen = release.stage_observed(name, typed, broken=broken, records=F.count("*"))
    if seen["records"] == 0:
        raise C.CheckFailed(f"{name} input is empty")
    if seen["broken"]:
        by_rule = staged.select(F.explode("problems").alias("rule")).groupBy("rule").count()
        rules = [f"{row.rule} ({row['count']})" for row in by_rule.orderBy("rule").collect()]
        raise C.CheckFailed(f"{seen['broken']} of {seen['records']} {name} records: " + ", ".join(rules))
    return staged


def _stage_merged(release: Release, name: str, merged: DataFrame) -> DataFrame:
    columns = RECONCILED[name]
    observed = F.count_if(F.size("conflicts") > 0)
    # The written table keeps the conflicts, so that a failure is named without a second merge.
    staged, seen = release.stage_observed(name, merged, conflicts=observed)
    if seen["conflicts"]:
        rows = staged.where(F.size("conflicts") > 0).select(columns[0], "conflicts").limit(_SHOWN)
        shown = [f"{row[0]}: {', '.join(row[1])}" for row in rows.collect()]
        raise C.CheckFailed(f"{seen['conflicts']} conflicts in {name}: " + "; ".join(shown))
    return staged.select(*columns)


def load_reconciled(
    spark: SparkSession,
    works_path: str,
    panel_path: str,
    root: str,
    manifest_path: str | None = None,
    validate_only: bool = False,
) -> dict[str, DataFrame]:
    """Raw works and panel to nine checked tables; published unless only validating."""
    recorded = read_manifest(spark, manifest_path)
    lines = json_lines(spark, works_path)
    sinks.verify_file(spark, works_path, recorded.get("sha256"))
    sinks.verify_rows(lines.select("value"), recorded.get("digest"))

    release = Release(spark, root)
    panel = _stage_records(release, "panel", read_panel(spark, panel_path))
    works = _stage_records(release, "works", typed_works(lines))
    policy = place_policy(spark)
    # The pairs decide which places are needed, so they are written first.
    countries = release.stage("r_work_country", work_countries(works))
    uncovered = uncovered_codes(countries, panel_countries(panel))
    unknown = unrecognised_codes(uncovered, policy).orderBy("country_code_iso2")
    codes = [row[0] for row in unknown.limit(_SHOWN).collect()]
    if codes:
        raise C.CheckFailed("Country codes without a panel entry or a policy: " + ", ".join(codes))
    staged = {"r_work_country": countries}
    for name, merged in reconcile(works, panel, policy, countries).items():
        if name not in staged:
            staged[name] = _stage_merged(release, name, merged)
    C.require(gates.reconciled_checks(staged, panel))
    if not validate_only:
        release.publish()
    return staged


def open_reconciled(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: open_table(spark, root, name).select(*RECONCILED[name]) for name in RECONCILED}


def load_warehouse(
    spark: SparkSession,
    reconciled: dict[str, DataFrame],
    root: str,
    first: int = START_YEAR,
    last: int = END_YEAR,
    buckets: int | None = None,
) -> Warehouse:
    """Reconciled tables to a checked and published warehouse.

    The fact and the bridges are written in a folder for each year, sorted by publication. With
    ``buckets`` they are also bucketed by it, so that queries join them without a shuffle; choose the
    number so that one bucket of the largest bridge, over the years asked for, fits a task.
    """
    C.require_columns(reconciled, WAREHOUSE_INPUT)
    release = Release(spark, root, buckets)

    def stage(name: str, rows: DataFrame) -> DataFrame:
        keyed = name == "fact_publication" or name.startswith("bridge_")
        return release.stage(name, rows, ("publication_key",) if keyed else ())

    built = build_warehouse(reconciled, stage)
    C.require(gates.warehouse_checks(built.tables(), reconciled, first, last))
    release.publish()
    return open_warehouse(spark, root)


def extract_panel(
    spark: SparkSession, pages_path: str, root: str, years=YEARS, indicators: dict = INDICATORS
) -> DataFrame:
    """Landed pages to a complete, profiled country-year panel.

    ``pages_path`` holds one folder per endpoint: country, source, indicator, data.
    """
    pages = L.parse_pages(L.read_pages(spark, f"{pages_path}/*/*"))
    release = Release(spark, root)
    pages = release.stage("pages", pages)
    C.require(L.page_checks(pages))

    def records(endpoint: str, record: str) -> DataFrame:
        return L.page_records(pages.where(F.col("endpoint") == endpoint), record)

    entities = records("country", COUNTRY_RECORD)
    countries, aggregates = L.split_countries(entities)
    C.require(L.country_checks(countries))
    metadata = L.indicator_metadata(records("indicator", INDICATOR_RECORD), indicators)
    C.require(L.indicator_checks(metadata, records("source", SOURCE_RECORD)))
    triaged = release.stage(
        "observations",
        R.triage_observations(
            L.long_observations(records("data", OBSERVATION_RECORD)), countries, years, indicators
        ),
    )
    wrong = triaged.where(F.col("status").isin(list(R.FATAL_STATUSES))).groupBy("status").count()
    found = [f"{row.status} ({row['count']})" for row in wrong.orderBy("status").collect()]
    if found:
        raise C.CheckFailed("Observations: " + ", ".join(found))
    panel = release.stage("panel_table", R.pivot_observations(triaged, countries, years, indicators))
    C.require(P.panel_checks(panel, countries, years))

    at = table_path(root, release.version, "{}")
    sinks.write_json_lines(panel, at.format("panel"), "country_code_iso3", "year")
    quality = P.quality_document(panel, countries, years)
    sinks.write_document(quality, at.format("quality"))
    for name, listed in P.quality_lists(panel).items():
        sinks.write_json_lines(listed, at.format(f"quality_{name}"), *listed.columns)
    sinks.write_document(
        panel_manifest(entities, aggregates, panel, metadata, triaged, years), at.format("manifest")
    )
    release.publish()
    return panel


def _entries(rows: DataFrame, *order: str):
    """A small frame as one list value; callers pass frames with one row per year, measure or
    source entity."""
    return rows.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("entries")).scalar()


def panel_manifest(
    entities: DataFrame,
    aggregates: DataFrame,
    panel: DataFrame,
    metadata: DataFrame,
    triaged: DataFrame,
    years=YEARS,
) -> DataFrame:
    """Lineage and counts of an extracted panel as one row."""
    coverage = P.completeness(panel)
    overall = coverage.where(F.col("year").isNull()).withColumnRenamed("field", "output_field")
    lineage = metadata.join(overall.drop("year"), "output_field")
    # codes come from the source, so their number has no bound: the list names the most frequent ones
    unexpected = triaged.where("status = 'unexpected_indicator'").groupBy("indicator").agg(F.count("*").alias("observations"))
    returned = entities.agg(F.count("*").alias("n")).scalar()
    excluded = aggregates.agg(F.count("*").alias("n")).scalar()
    return panel.agg(F.count("*").alias("actual_rows")).select(
        F.lit(min(years)).alias("start_year"),
        F.lit(max(years)).alias("end_year"),
        returned.alias("entities_returned"),
        (returned - excluded).alias("countries_retained"),
        excluded.alias("aggregates_excluded"),
        _entries(aggregates.select("id"), "id").alias("excluded_codes"),
        ((returned - excluded) * len(tuple(years))).alias("expected_rows"),
        "actual_rows",
        P.duplicate_rows(panel).scalar().alias("duplicate_rows"),
        _entries(lineage, "output_field", "code", "official_name", "unit", "source_name", "present", "missing", "coverage_pct").alias("indicators"),
        _entries(coverage.where(F.col("year").isNotNull()), "year", "field", "missing").alias("missing_by_year"),
        _entries(triaged.groupBy("status").agg(F.count("*").alias("observations")), "status", "observations").alias("observations"),
        unexpected.agg(F.count("*").alias("n")).scalar().alias("unexpected_indicator_count"),
        _entries(unexpected.orderBy(F.desc("observations"), "indicator").limit(_LISTED), "indicator", "observations").alias("unexpected_indicators"),
        F.lit(True).alias("no_missing_values_imputed"),
    )


def extract_sample(
    spark: SparkSession,
    works_path: str,
    root: str,
    target: int = SAMPLE_TARGET,
    seed: int = SAMPLE_SEED,
    years=YEARS,
    stratum_limit: int | None = None,
) -> DataFrame:
    """An exact year-stratified sample of qualifying raw works, with its manifest.

    A work with several qualifying lines is drawn once, with the line of smallest hash. The
    published lines are those of the chosen rows; they are read back, and the checks and the
    manifest come from what was read.
    """
    release = Release(spark, root)
    works = _stage_records(release, "works", typed_works(json_lines(spark, works_path), "value"))
    corpus = works.where(S.in_corpus(years)).withColumn("line_hash", F.sha2("value", 256))
    unique = release.stage("corpus", S.one_line_each(corpus))
    population = release.stage("population", S.population_by_year(unique))
    C.require(S.population_checks(population, years))
    allocation = release.stage("allocation", S.allocate(population, target))
    C.require(S.allocation_checks(allocation, target, stratum_limit))
    ids = release.stage("sample_ids", S.sample_ids(unique, allocation, seed))

    at = table_path(root, release.version, "{}")
    chosen = corpus.join(unique.join(ids, "work_id", "left_semi"), ["work_id", "line_hash"], "left_semi")
    lines = chosen.select("work_id", "value").dropDuplicates(["work_id"])
    lines.orderBy("work_id").select("value").write.mode("overwrite").text(at.format("sample"))
    written = spark.read.text(at.format("sample"))
    read_back = _stage_records(release, "sample_read", typed_works(json_lines(spark, at.format("sample"))))
    C.require(S.sample_checks(read_back, allocation, target, years=years))
    copies = corpus.agg((F.count("*") - F.countDistinct("work_id")).alias("n")).scalar()
    sinks.write_document(
        sample_manifest(written, read_back, population, allocation, target, seed, years).withColumn(
            "further_lines_of_chosen_corpus", copies
        ),
        at.format("manifest"),
    )
    release.publish()
    return written


def sample_manifest(
    lines: DataFrame,
    sample: DataFrame,
    population: DataFrame,
    allocation: DataFrame,
    target: int,
    seed: int,
    years=YEARS,
) -> DataFrame:
    """Method of a sample and what its written lines, read back as ``sample``, hold: one row."""
    drawn = sample.groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("works"))
    drawn = drawn.withColumn("seed", F.col("year") + seed)
    rejected = F.count_if(S.reject_reason(years).isNotNull())
    measured = sample.agg(
        F.count("*").alias("actual_total"),
        (F.count("*") - F.countDistinct("work_id")).alias("duplicate_count"),
        rejected.alias("guardrail_failures"),
    )
    complete = (F.col("actual_total") == target) & (F.col("duplicate_count") == 0) & (F.col("guardrail_failures") == 0)
    return measured.crossJoin(sinks.rows_digest(lines)).select(
        F.lit(target).alias("target_sample_size"),
        F.lit(seed).alias("seed"),
        F.lit("seed + publication year").alias("annual_seed_strategy"),
        F.lit("proportional by year, largest remainder, earlier year first").alias("allocation_method"),
        F.lit(CORPUS_SUBFIELD).alias("subfield"),
        F.array(*[F.lit(t) for t in ALLOWED_WORK_TYPES]).alias("allowed_types"),
        _entries(population, "year", "population").alias("population_by_year"),
        population.agg(F.sum("population").alias("n")).scalar().alias("qualifying_population"),
        _entries(allocation, "year", "allocation").alias("allocation_by_year"),
        _entries(drawn, "year", "works", "seed").alias("actual_by_year"),
        "actual_total",
        "duplicate_count",
        "guardrail_failures",
        "digest",
        complete.alias("complete"),
    )
