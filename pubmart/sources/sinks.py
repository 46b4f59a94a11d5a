"""File sinks and checksums."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ChecksumMismatch(ValueError):
    pass


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """JSON Lines in key order, NULL fields included; the parts, read by name, are sorted."""
    rows.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_document(metrics: DataFrame, path: str) -> None:
    """A single-row frame as one JSON document."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


_SHOWN = 20  # files named in an error; the comparison is complete


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file. A file is one value here, below 2 GB; ``file_digests`` has no such bound."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


_WORD = 8  # hex digits per summed word of a row hash


def canonical(field: T.StructField) -> Column:
    """A value as text that other engines can repeat: length and text, or a hyphen for NULL.

    Fractions are written as decimals with 12 places, or in their own form where these cannot hold them; nested
    values as JSON.
    """
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = F.coalesce(column.cast("double").try_cast("decimal(38,12)").cast("string"), column.cast("string"))
    elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Row count and digest per group of rows with a column h, a SHA-256 in hex.

    The eight 32-bit words of the hashes are added up, which partial aggregates do in constant
    memory, and the sums are hashed once more. Copies of a row count.
    """

    def word(position: int) -> Column:
        digits = F.substring(F.col("h"), position * _WORD + 1, _WORD)
        return F.sum(F.conv(digits, 16, 10).cast("decimal(20,0)"))

    sums = rows.groupBy(*by).agg(F.count("*").alias("row_count"), *[word(i).alias(f"w{i}") for i in range(8)])
    parts = [F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(8)]
    joined = F.concat_ws(":", F.col("row_count").cast("string"), *parts)
    return sums.select(*by, "row_count", F.sha2(joined, 256).alias("digest"))


def rows_digest(rows: DataFrame) -> DataFrame:
    """Row count and digest of a frame of any size, independent of row order and of files."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    line = F.sha2(F.concat_ws(",", *[canonical(f) for f in fields]), 256)
    return _summed(rows.select(line.alias("h")), [])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name below the path, number of lines and digest of every text file there, of any size and number.

    A file is read in splits by many tasks; each split's lines are added up to its file's digest. The
    digest holds every line with its copies, not the order of lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    inside = F.regexp_replace("file_path", r"^.*?" + _literal(path) + r"/?", "")
    name = F.when(inside == "", F.element_at(F.split("file_path", "/"), -1)).otherwise(inside)
    return _summed(lines.select(name.alias("file"), F.sha2("value", 256).alias("h")), ["file"])


def _literal(path: str) -> str:
    """A path as a pattern, without its scheme and the slash at its end."""
    return re.escape(re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/"))


def tree_digest(files: DataFrame) -> DataFrame:
    """Number of files, lines and one digest over the names and digests of all files, whatever their order."""
    leaf = F.sha2(F.concat_ws(":", F.length("file").cast("string"), "file", F.col("row_count").cast("string"), "digest"), 256)
    total = files.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("lines"))
    return _summed(files.select(leaf.alias("h")), []).withColumnRenamed("row_count", "files").crossJoin(total)


def differing_files(spark: SparkSession, path: str, recorded: dict[str, str]) -> DataFrame:
    """Files whose digest is not the recorded one, that are not recorded, or that are gone.

    ``recorded`` maps names to digests: a row a file, as a manifest has them.
    """
    wanted = spark.createDataFrame(list(recorded.items()), "file STRING, wanted STRING")
    both = file_digests(spark, path).join(wanted, "file", "full")
    problem = (
        F.when(F.col("wanted").isNull(), "not recorded").when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("wanted"), "differs")
    )
    return both.select("file", problem.alias("problem")).where(F.col("problem").isNotNull())


def verify_files(spark: SparkSession, path: str, recorded: dict[str, str] | None) -> None:
    """Compare all files below a path with a recorded map; without one there is nothing to verify."""
    if not recorded:
        return
    wrong = differing_files(spark, path, recorded).orderBy("file").limit(_SHOWN).collect()
    if wrong:
        raise ChecksumMismatch(f"Files of {path}: " + ", ".join(f"{r.file} {r.problem}" for r in wrong))


def verify_file(spark: SparkSession, path: str, expected: str | None) -> None:
    """Compare a file with its recorded checksum; without one there is nothing to verify."""
    if not expected:
        return
    found = {r.sha256 for r in file_checksums(spark, path).select("sha256").distinct().limit(2).collect()}
    if found != {expected}:
        raise ChecksumMismatch(f"Checksum of {path} differs from its manifest")


def verify_rows(rows: DataFrame, expected: str | None) -> None:
    if expected and rows_digest(rows).first().digest != expected:
        raise ChecksumMismatch("Row digest differs from the manifest")
