"""Versioned table sets: written aside, checked, then made current by one new log file.

Layout: ``<root>/version=<n>/<table>`` and the log ``<root>/_releases``, one file a release. Readers use the
version of the log's last file, so a run that fails before its log file leaves the previous one in place.

Several writers may work at once. Each claims a version of its own, by a file that only one can create, and so
writes to folders that no other writes to. To publish is to create the log file that follows the release
the writer began from; of two writers that began from the same release one creates it and the other is told.
Both rest on the file system's "create unless it exists".

Rows that carry the year they are stored by are written to one folder a year, so that a query over some years
opens the folders of these years only, of the fact and of the bridges alike.

Tables may be written in hash buckets of one key, below the years. Tables bucketed alike then join and
group on that key without a shuffle; buckets are part of a table's definition in the session catalog,
which readers set up from the log.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pubmart.plans.warehouse import Warehouse
from pubmart.schemas import STORED_YEAR, WAREHOUSE

_LOG_SCHEMA = "version BIGINT, tables ARRAY<STRING>, buckets BIGINT, sequence BIGINT"
BUCKET_KEY = "publication_key"


class NotPublished(LookupError):
    pass


class PublishConflict(RuntimeError):
    """Another writer has published since this one began; nothing of this one is visible."""


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system its scheme names."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists; whether this call created it.

    Hadoop's local file system looks and then creates, so two threads may both succeed; there the file
    is claimed by the operating system's exclusive create first.
    """
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    local = system.getUri().getScheme() == "file"
    if local:
        file = spark._jvm.java.io.File(system.makeQualified(location).toUri().getPath())
        file.getParentFile().mkdirs()
        if not file.createNewFile():
            return False
    try:
        stream = system.create(location, local)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName() or system.exists(location):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def file_names(spark: SparkSession, path: str) -> list[str]:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in system.listStatus(location)] if system.exists(location) else []


def last_release(spark: SparkSession, root: str) -> tuple[int, int, int | None]:
    """Sequence, version and buckets of the release readers see; zeros before the first one.

    A log file that is still being written has no version yet and does not count.
    """
    log = f"{root}/_releases"
    if not path_exists(spark, log):
        return 0, 0, None
    rows = spark.read.schema(_LOG_SCHEMA).json(log).where("version IS NOT NULL")
    # releases logged without a sequence follow each other by version
    rows = rows.withColumn("sequence", F.coalesce("sequence", "version"))
    last = rows.orderBy(F.desc("sequence")).first()
    return (last.sequence, last.version, last.buckets) if last else (0, 0, None)


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the release readers see; 0 before the first one."""
    return last_release(spark, root)[0]


def table_path(root: str, version: int, name: str) -> str:
    return f"{root}/version={version}/{name}"


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    _, version, _ = last_release(spark, root)
    if version == 0:
        raise NotPublished(f"Nothing is published under {root}")
    return spark.read.parquet(table_path(root, version, name))


def catalog_name(path: str) -> str:
    return f"pubmart_{hashlib.md5(path.encode()).hexdigest()}"


def open_bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A bucketed table by its path, entered into the session catalog when it is new there."""
    name = catalog_name(path)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by_year = f"PARTITIONED BY ({STORED_YEAR}) " if STORED_YEAR in schema.names else ""
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {by_year}"
            f"CLUSTERED BY ({BUCKET_KEY}) SORTED BY ({BUCKET_KEY}) INTO {int(buckets)} BUCKETS "
            f"LOCATION '{path}'"
        )
        if by_year:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


def open_warehouse(spark: SparkSession, root: str) -> Warehouse:
    """The current warehouse; every table of it comes from the same version."""
    _, version, buckets = last_release(spark, root)
    if version == 0:
        raise NotPublished(f"Nothing is published under {root}")

    def opener(name: str):
        path = table_path(root, version, name)
        if buckets and BUCKET_KEY in WAREHOUSE[name]:
            return partial(open_bucketed, spark, path, buckets)
        return partial(spark.read.parquet, path)

    return Warehouse({name: opener(name) for name in WAREHOUSE})


def _claimed(spark: SparkSession, root: str) -> int:
    """A version that no other writer has, and that no folder is there of."""
    names = file_names(spark, f"{root}/_claims") + [n.removeprefix("version=") for n in file_names(spark, root) if n.startswith("version=")]
    version = max((int(n) for n in names if n.isdigit()), default=0) + 1
    while not create_once(spark, f"{root}/_claims/{version}", ""):
        version += 1
    return version


class Release:
    """A new version of a table set while it is being written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets
        self.begun_from = last_release(spark, root)[0]
        self.version = _claimed(spark, root)
        self.tables: list[str] = []

    def stage(self, name: str, rows: DataFrame, order: Iterable[str] = ()) -> DataFrame:
        """Write a table and give back the frame that reads what was written."""
        path = table_path(self.root, self.version, name)
        if self.buckets and BUCKET_KEY in rows.columns:
            return self._stage_bucketed(name, rows, path)
        by_year = [STORED_YEAR] if STORED_YEAR in rows.columns else []
        if by_year:
            # Rows of a year meet in few tasks; adaptive execution splits large years.
            rows = rows.hint("rebalance", *by_year)
        if order or by_year:
            rows = rows.sortWithinPartitions(*by_year, *order)
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by_year) if by_year else writer).parquet(path)
        self._keep_schema(path, rows)
        self.tables.append(name)
        return self.spark.read.parquet(path)

    def _keep_schema(self, path: str, rows: DataFrame) -> None:
        """A table without rows has no year folder: one file without rows tells readers its columns."""
        if STORED_YEAR in rows.columns and not any(n.startswith(STORED_YEAR) for n in file_names(self.spark, path)):
            self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)

    def _stage_bucketed(self, name: str, rows: DataFrame, path: str) -> DataFrame:
        # Partitioned like the buckets, each task writes one bucket instead of a part of all.
        placed = rows.repartition(self.buckets, BUCKET_KEY)
        writer = placed.write.mode("overwrite").format("parquet").option("path", path)
        if STORED_YEAR in rows.columns:
            writer = writer.partitionBy(STORED_YEAR)
        writer = writer.bucketBy(self.buckets, BUCKET_KEY).sortBy(BUCKET_KEY)
        writer.saveAsTable(catalog_name(path))
        self._keep_schema(path, rows)
        self.tables.append(name)
        return open_bucketed(self.spark, path, self.buckets)

    def stage_observed(self, name: str, rows: DataFrame, **metrics) -> tuple[DataFrame, dict]:
        """Like ``stage``, with aggregates taken while the rows are written: no second pass."""
        observation = Observation(name)
        observed = rows.observe(observation, *[value.alias(key) for key, value in metrics.items()])
        return self.stage(name, observed), observation.get

    def publish(self, retries: int = 0) -> int:
        """Make this version the current one, or raise PublishConflict.

        A load that does not build on the release before may ask to follow up to ``retries`` other
        releases that came meanwhile.
        """
        for sequence in range(self.begun_from + 1, self.begun_from + 2 + retries):
            entry = {"version": self.version, "tables": sorted(self.tables), "buckets": self.buckets, "sequence": sequence}
            if create_once(self.spark, f"{self.root}/_releases/{sequence:020d}.json", json.dumps(entry) + "\n"):
                return self.version
        raise PublishConflict(f"Another release of {self.root} was published meanwhile; version {self.version} is not visible")
