"""Helpers shared by the operators: reading tables, staging, batches and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmart.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, so that very long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (null text: empty), so that no other column can clash."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame once to the shared folder and go on from the written table."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_words(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.

    Bytes are lower-cased and split at exactly these letters and blanks.
    """
    joined = b" ".join(text.encode("utf-8", "replace").lower().split())
    return joined.decode().split(" ") if joined else []


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges start..start+length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (multiply and shift, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one partition, reduced to a star per part: never more rows than vertices."""
    for batch in batches:
        root: dict = {}

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in root]
        yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"]).astype("int64")


def components(edges: DataFrame, rounds: int = 60, starred: bool = False) -> DataFrame:
    """(node, component): the smallest node that each node of an edge list reaches.

    ``edges`` has two long columns a and b; ``starred`` says that its tasks have reduced them to stars, which
    saves a second Python worker beside theirs. Each round links every node to the smallest
    neighbour of its neighbourhood and then halves the paths, so the number of rounds grows with
    the logarithm of the diameter. A hub's edges are pre-aggregated by partial ``min``; nothing
    is gathered in the driver but a count of changed rows. The label table is written each round.
    """
    edges = edges.where("a <> b").select("a", "b")
    if not starred:
        edges = edges.mapInPandas(_forest, "a long, b long")
    edges = staged(edges.distinct(), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels"
    )
    for _ in range(rounds):
        # smallest label in the neighbourhood, then the label's own label
        offered = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(offered, "node").select("node", "component", F.least("component", "near").alias("next"))
        # a root that is offered a smaller label hands it on to all that carry it
        hooks = lower.where("next < component").groupBy("component").agg(F.min("next").alias("hook"))
        moved = (
            lower.join(hooks, "component", "left")
            .select("node", F.col("component").alias("was"), F.least("next", F.coalesce("hook", "next")).alias("next"))
        )
        jumped = moved.join(
            labels.select(F.col("node").alias("next"), F.col("component").alias("far")), "next", "left"
        ).select("node", "was", F.least("next", F.coalesce("far", "next")).alias("component"))
        step = staged(jumped, "labels")
        changed = step.where("was <> component").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"Components did not settle in {rounds} rounds")


def merged(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
}


def chunks_of(texts: list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of a batch with about ``most`` characters, one text at least."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text or "") > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(text or "")
    if at < len(texts):
        yield slice(at, len(texts))


def per_text(frame: DataFrame, start: Callable, added: dict[str, str], drop: Sequence[str] = ("text",)) -> DataFrame:
    """Columns computed from each text; the other columns pass through unread.

    ``start`` is called once in each task and gives a function from a list of texts to the list of
    the added columns. ``added`` has their names and kinds (KINDS).
    """
    kept = [c for c in frame.columns if c not in drop and c not in added]
    names = kept + list(added)
    fields = [f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in kept]
    fields += [f"`{c}` {kind}" for c, kind in added.items()]
    bounded_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = start()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in chunks_of(texts):
                same = [batch.column(c).slice(part.start, part.stop - part.start) for c in kept]
                more = [
                    pa.array(values, type=KINDS[kind])
                    for values, kind in zip(of_texts(texts[part]), added.values(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(same + more, names=names)

    return frame.mapInArrow(run, ", ".join(fields))
