"""Corpus filter, proportional allocation and an exact seeded sample per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pubmart.functions.text import short_id
from pubmart.operators import checks as C
from pubmart.schemas import (
    ALLOWED_WORK_TYPES,
    CORPUS_SUBFIELD,
    SAMPLE_SEED,
    SAMPLE_TARGET,
    YEARS,
)


def in_corpus(
    years=YEARS, subfield: str = CORPUS_SUBFIELD, types: tuple[str, ...] = ALLOWED_WORK_TYPES
) -> Column:
    """Typed works that belong to the corpus."""
    return (
        (short_id(F.col("primary_topic.subfield_id")) == subfield)
        & F.col("publication_year").isin(list(years))
        & F.col("work_type").isin(list(types))
        & ~F.col("is_retracted")
    )


def reject_reason(
    years=YEARS, subfield: str = CORPUS_SUBFIELD, types: tuple[str, ...] = ALLOWED_WORK_TYPES
) -> Column:
    """The first rule a typed work fails, or NULL; the order of the rules is fixed."""

    def fails(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    primary = F.col("primary_topic")
    primary_id = short_id(primary["topic_id"])
    date, year = F.col("publication_date"), F.col("publication_year")
    listed = F.exists("topics", lambda t: short_id(t["topic_id"]) == primary_id)
    return (
        F.when(fails(short_id(F.col("work_id")).startswith("W")), "invalid_work_id")
        .when(fails(year.isin(list(years))), "publication_year")
        .when(date.isNull(), "publication_date")
        .when(F.year(date) != year, "publication_date_year_mismatch")
        .when(fails(F.col("work_type").isin(list(types))), "work_type")
        .when(fails(~F.col("is_retracted")), "retracted_or_unknown")
        .when(primary_id.isNull(), "primary_topic")
        .when(fails(short_id(primary["subfield_id"]) == subfield), "primary_topic_subfield")
        .when(fails(F.size("topics") > 0), "topics")
        .when(fails(listed), "primary_topic_relationship")
    )


def one_line_each(corpus: DataFrame, *more: str) -> DataFrame:
    """work_id, line_hash, publication_year and ``more`` columns: for each work its line of smallest hash."""
    line = F.min(F.struct("line_hash", "publication_year", *more)).alias("line")
    return corpus.groupBy("work_id").agg(line).select("work_id", "line.*")


def population_by_year(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("population"))


def population_checks(population: DataFrame, years=YEARS) -> DataFrame:
    """Every year has a stratum."""
    wanted = population.sparkSession.createDataFrame([(int(y),) for y in years], "year INT")
    empty = wanted.join(population.where("population > 0"), "year", "left_anti")
    return C.holds(empty, "stratum not empty", "population", F.lit(False))


def allocate(population: DataFrame, target: int = SAMPLE_TARGET) -> DataFrame:
    """Proportional whole numbers by largest remainder, earlier years first on ties.

    All arithmetic is on integers. The windows run over one row per year.
    """
    if target < 1:
        raise ValueError("The sample target must be positive")
    everything = Window.partitionBy()
    total = F.sum("population").over(everything)
    share = F.lit(target).cast("bigint") * F.col("population")
    rows = population.select(
        "year",
        "population",
        F.expr(f"(cast({target} as bigint) * population) div sum(population) over ()").alias("base"),
        (share % total).alias("remainder"),
    )
    missing = F.lit(target) - F.sum("base").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("remainder"), "year"))
    extra = (place <= missing).cast("bigint")
    return rows.select("year", "population", (F.col("base") + extra).alias("allocation"))


def allocation_checks(
    allocation: DataFrame, target: int = SAMPLE_TARGET, limit: int | None = None
) -> DataFrame:
    """``limit``: most works of one year, where a service behind the sample has such a quota."""
    sums = allocation.agg(
        F.sum("population").alias("population"), F.sum("allocation").alias("allocation")
    )
    checks = [
        C.holds(sums, "target within population", "allocation", F.col("population") >= target),
        C.holds(sums, "target reached", "allocation", F.col("allocation") == target),
    ]
    if limit is not None:
        checks.append(C.holds(allocation, "stratum limit", "allocation", F.col("allocation") <= limit))
    return C.all_checks(checks)


_PREFIX = 4  # hex digits: 65,536 steps of the hash range


def sample_ids(
    corpus: DataFrame, allocation: DataFrame, seed: int = SAMPLE_SEED, work_id: str = "work_id"
) -> DataFrame:
    """Exactly the allocated number of works per year: those with the smallest seeded hashes.

    A year may hold most of all works, so no year is sorted as a whole. Works are counted per
    year and hash prefix, which partial aggregates reduce to a small table; its running sum
    gives the prefix at which each year is full. Works below that prefix are in, unranked; only
    those that share it, one of 65,536 steps, are ranked for the places left. Work ids must be
    unique, which ``sample_checks`` verifies.
    """
    year = F.col("publication_year")
    text = F.concat((year + seed).cast("string"), F.lit(":"), F.col(work_id))
    hashed = corpus.select(year.alias("year"), work_id, F.md5(text).alias("hash"))
    prefix = F.substring("hash", 1, _PREFIX)
    running = F.sum("works").over(Window.partitionBy("year").orderBy("prefix"))
    histogram = hashed.groupBy("year", prefix.alias("prefix")).agg(F.count("*").alias("works"))
    sizes = allocation.select("year", "allocation")
    full_at = (
        histogram.withColumn("running", running)
        .join(sizes, "year")
        .where(F.col("running") - F.col("works") < F.col("allocation"))
        .groupBy("year", "allocation")
        .agg(F.max("prefix").alias("cut"), F.max(F.col("running") - F.col("works")).alias("before"))
    )
    near = hashed.join(full_at, "year").where(prefix <= F.col("cut"))
    below = near.where(prefix < F.col("cut")).select("year", work_id)
    rank = F.row_number().over(Window.partitionBy("year").orderBy("hash", work_id))
    ranked = near.where(prefix == F.col("cut")).withColumn("rank", rank)
    last = ranked.where(F.col("rank") <= F.col("allocation") - F.col("before")).select("year", work_id)
    return below.unionAll(last)


def stratified_sample(
    corpus: DataFrame, allocation: DataFrame, seed: int = SAMPLE_SEED
) -> DataFrame:
    """Whole works of the sample."""
    ids = sample_ids(corpus, allocation, seed).select("work_id")
    return corpus.join(ids, "work_id", "left_semi")


def sample_checks(
    sample: DataFrame, allocation: DataFrame, target: int = SAMPLE_TARGET, **guardrails
) -> DataFrame:
    """Sizes as allocated, ids unique, and no work that the guardrails reject."""
    drawn = sample.groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("drawn"))
    sizes = allocation.join(drawn, "year", "left")
    exact = F.coalesce("drawn", F.lit(0)) == F.col("allocation")
    total = sizes.agg(F.coalesce(F.sum("drawn"), F.lit(0)).alias("drawn"))
    return C.all_checks(
        [
            C.holds(total, "sample size", "sample", F.col("drawn") == target),
            C.holds(sizes, "allocation met", "sample", exact),
            C.duplicate_keys(sample, "sample.work_id", ("work_id",)),
            C.holds(sample, "guardrails", "sample", reject_reason(**guardrails).isNull()),
        ]
    )
