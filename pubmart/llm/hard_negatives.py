"""Hard negatives by anchor-clustered shared lists with certified termination (operator 13).

Anchors are clustered by direction, apart by label. For a cluster with centre c and widest member
angle r, the inner product of a member u with a row x is at most |u| |x| cos(max(0, angle(x, c) - r)).
Each cluster sorts the candidate rows by this bound once; every member walks the shared list and stops
as soon as its bound certifies that no later row can enter its result. Scores are exact integers.

First the nearest rows of the same label are found (positives); their scores then limit the walk for
rows of other labels (negatives): a negative counts for a positive if its score lies between ``LOW``
per cent of the positive's score and that score.

Rows stay where they are: each task lists its own share of the rows and carries its members' best rows
from batch to batch, so that later lists are left sooner. Only a few best rows of each task are
shuffled. Anchors visit the rows in blocks of ``ANCHORS``, sorted by label and cluster; a block and its
positives (at most ``POSITIVES`` each) are what is broadcast and what the driver holds at a time. The
clusters are fitted on the ``SAMPLE`` anchors of smallest hash; they steer the order only, not the result.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no
part; zero and empty vectors do, shorter ones count as filled up with zeros. Each row counts on its
own, also rows that share an id: a repeated anchor gives its results as often, and only the anchor's
own row is never its positive. Ties go to the smaller id. An anchor without positives, or a positive
without negatives, gives no row. Components so large that a score could reach 2**53 stop the
query with a message. Columns other
than vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubmart.llm.common import bounded_batches, flat_ranges, fresh_path, merged, staged

POSITIVES = 5
NEGATIVES = 5
LOW = 80
ANCHORS = 16_384
GROUP = 64
CELL_ANCHORS = 128
CELLS = 64
SAMPLE = 4096
STEPS = 10
FIRST_SLAB = 256
BATCH_BYTES = 8 << 20
SEED = 13

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(frame: DataFrame, label: Column, scale: float) -> DataFrame:
    """row, id, label and vector (components floor(scale * x), as doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        frame.select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), vector.alias("vector"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
        .select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths_of(vectors))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(values))], names=batch.schema.names
            )

    bounded_batches(frame.sparkSession)
    return rows.mapInArrow(run, "row long, id long, label long, vector array<double>")


def lengths_of(vectors: pa.Array) -> np.ndarray:
    return vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of vectors, filled up with zeros."""
    lengths, values = lengths_of(vectors), vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), flat_ranges(np.zeros_like(lengths), lengths)] = values
    return out


def units(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def cells_of(sample: np.ndarray) -> np.ndarray:
    """Unit centres of a spherical k-means over a bounded sample."""
    directions = units(sample)
    count = int(np.clip(len(sample) // CELL_ANCHORS, 1, CELLS))
    rng = np.random.default_rng(SEED)
    centres = directions[rng.choice(len(directions), count, replace=False)]
    for _ in range(STEPS):
        own = (directions @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, directions)
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, units(sums), centres)
    return centres


class Block:
    """Anchors sorted by label and cell, in groups of one label and cell and at most GROUP members."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, vectors: np.ndarray):
        self.columns = (row, ids, labels, cells, vectors)
        self.row, self.ids, self.vectors = row, ids, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        turn = np.flatnonzero((labels[1:] != labels[:-1]) | (cells[1:] != cells[:-1])) + 1
        ends = np.concatenate([[0], turn, [len(ids)]])
        cuts = [np.arange(a, b, GROUP) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.starts = np.concatenate(cuts) if len(ids) else np.zeros(0, dtype=np.int64)
        self.stops = np.append(self.starts[1:], len(ids))
        self.labels = labels[self.starts]
        directions = units(vectors)
        self.centres = units(np.add.reduceat(directions, self.starts, axis=0)) if len(ids) else directions
        group = np.repeat(np.arange(len(self.starts)), self.stops - self.starts)
        cosine = np.clip((directions * self.centres[group]).sum(axis=1), -1, 1)
        # a zero anchor's scores are all zero: its bound |u| = 0 holds at any angle
        angle = np.where(self.norms > 0, np.arccos(cosine), 0)
        self.radius = np.maximum.reduceat(angle, self.starts) if len(ids) else angle


class Walk:
    """The best rows so far of each anchor of a block, for each of its score ranges."""

    def __init__(self, block: Block, same: bool, low: np.ndarray, high: np.ndarray, most: int):
        self.block, self.same, self.low, self.high, self.most = block, same, low, high, most
        shape = (*low.shape, most)
        self.score = np.full(shape, -np.inf)
        self.ids = np.zeros(shape, dtype=np.int64)
        self.row = np.full(shape, -1, dtype=np.int64)

    def meet(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Walk every group's list of these rows."""
        order = np.argsort(labels, kind="stable")
        vectors, labels, ids, row = vectors[order], labels[order], ids[order], row[order]
        norms = np.linalg.norm(vectors, axis=1)
        block = self.block
        for g, label in enumerate(block.labels):
            first, last = np.searchsorted(labels, [label, label + 1])
            chosen = np.arange(first, last) if self.same else np.concatenate([np.arange(first), np.arange(last, len(labels))])
            if not len(chosen):
                continue
            size = norms[chosen]
            cosine = np.clip(vectors[chosen] @ block.centres[g] / np.where(size > 0, size, 1), -1, 1)
            bound = size * np.cos(np.maximum(0, np.arccos(cosine) - block.radius[g]))
            listed = np.argsort(-bound, kind="stable")
            self._walk(g, bound[listed], chosen[listed], float(size.max()), vectors, ids, row)

    def _needed(self, members: np.ndarray) -> np.ndarray:
        """Lowest score that could still enter a member's result, over its open ranges."""
        floor = np.maximum(self.low[members], self.score[members, :, -1])
        open_ranges = self.low[members] <= self.high[members]
        return np.where(open_ranges, floor, np.inf).min(axis=1)

    def _walk(self, g, bound, listed, longest, vectors, ids, row) -> None:
        block = self.block
        members = np.arange(block.starts[g], block.stops[g])
        at, slab = 0, FIRST_SLAB
        while at < len(listed) and len(members):
            # room for rounding: far below the distance of two integers, or of two bounds
            reach = block.norms[members] * bound[at] + 1e-6 * block.norms[members] * longest + 0.5
            members = members[self._needed(members) <= reach]
            part = listed[at : at + slab]
            if len(members):
                self._enter(members, block.vectors[members] @ vectors[part].T, ids[part], row[part])
            at += slab
            slab = min(4096, 2 * slab)

    def _enter(self, members, scores, ids, row) -> None:
        own = row[None, :] == self.block.row[members][:, None]
        for k in range(self.low.shape[1]):
            floor = np.maximum(self.low[members, k], self.score[members, k, -1])
            i, j = np.nonzero((scores >= floor[:, None]) & (scores <= self.high[members, k][:, None]) & ~own)
            if not len(i):
                continue
            touched = np.unique(i)
            held = members[touched]
            # the rows held so far and the new ones, best first for each member
            who = np.concatenate([np.repeat(touched, self.most), i])
            score = np.concatenate([self.score[held, k].ravel(), scores[i, j]])
            name = np.concatenate([self.ids[held, k].ravel(), ids[j]])
            place = np.concatenate([self.row[held, k].ravel(), row[j]])
            order = np.lexsort((place, name, -score, who))
            who = who[order]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            order, nth = order[nth < self.most], nth[nth < self.most]
            at = members[np.repeat(touched, self.most)]
            self.score[at, k, nth] = score[order]
            self.ids[at, k, nth] = name[order]
            self.row[at, k, nth] = place[order]

    def found(self) -> pa.RecordBatch:
        anchor, k, nth = np.nonzero(self.row >= 0)
        columns = [anchor, k, self.ids[anchor, k, nth], self.row[anchor, k, nth], self.score[anchor, k, nth].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "k", "id", "row", "score"])


def _best(rows: DataFrame, width: int, block: Block, same: bool, low, high, most: int) -> DataFrame:
    """anchor (place in the block), k (range), nth, id and score of the best rows over all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast((block.columns, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, low, high = sent.value
        walk = Walk(Block(*columns), same, low, high, most)
        for batch in merged(batches, BATCH_BYTES):
            row, ids, labels = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
            walk.meet(matrix(batch.column("vector"), width), labels, ids, row)
        yield walk.found()

    found = rows.mapInArrow(run, "anchor long, k long, id long, row long, score long")
    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def _blocks(anchors: DataFrame, width: int, cells: np.ndarray) -> Iterator[Block]:
    """The anchors in blocks, sorted by label and nearest cell; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (matrix(batch.column("vector"), width) @ cells.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = anchors.mapInArrow(run, "row long, id long, label long, vector array<double>, cell long")
    lines = staged(placed, "anchors").orderBy("label", "cell", "id", "row").toLocalIterator(prefetchPartitions=True)
    while some := list(islice(lines, ANCHORS)):
        row, ids, labels, cell = (np.array([r[c] for r in some], dtype=np.int64) for c in ("row", "id", "label", "cell"))
        yield Block(row, ids, labels, cell, matrix(pa.array([r["vector"] for r in some], type=pa.list_(pa.float64())), width))


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """RESULT for ``rows`` (row, id, label, vector); ``is_anchor`` chooses the anchors by id."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = staged(rows, "vectors")
    largest = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    shape = rows.agg(F.max(F.size("vector")).alias("width"), F.max(largest).alias("largest")).first()
    width = shape["width"] or 0
    if not max(1, width) * (shape["largest"] or 0.0) ** 2 < 2**53:
        raise ValueError("Inner products may reach 2**53, where doubles are not exact: scale the vectors down")
    anchors = rows.where(is_anchor)
    sample = anchors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    path = fresh_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    if len(sample):
        for block in _blocks(anchors, width, cells_of(matrix(sample, width))):
            _block_negatives(rows, width, block).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _block_negatives(rows: DataFrame, width: int, block: Block) -> DataFrame:
    spark, count = rows.sparkSession, len(block.ids)
    low, high = np.full((count, 1), -np.inf), np.full((count, 1), np.inf)
    # at most POSITIVES rows for each anchor of the block
    positives = _best(rows, width, block, True, low, high, POSITIVES).toArrow()
    anchor, nth, ids, score = (positives[c].to_numpy() for c in ("anchor", "nth", "id", "score"))
    positive = np.zeros((count, POSITIVES), dtype=np.int64)
    low, high = np.full((count, POSITIVES), np.inf), np.full((count, POSITIVES), -np.inf)
    high[anchor, nth - 1] = score
    low[anchor, nth - 1] = -(-LOW * score // 100)
    positive[anchor, nth - 1] = ids
    negatives = _best(rows, width, block, False, low, high, NEGATIVES)
    names = pa.table({"anchor": anchor, "k": nth.astype(np.int64) - 1, "anchor_id": block.ids[anchor], "positive_id": ids, "positive_score": score})
    return negatives.join(spark.createDataFrame(names), ["anchor", "k"]).select(
        "anchor_id",
        "positive_id",
        F.col("nth").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100, on components floor(256 * x)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(vectors, label, 256.0), F.col("id") % 100 == 0)
