"""Near-duplicates by an LSH forest over MinHash signatures (operator 6).

A document is the set of its distinct word shingles. Documents with equal sets form a class with
one representative. The signature of a representative is cut into TREES sorted orders of DEPTH
minima each. In every order, rows that share their first LEAST_PREFIX minima form a region; only
regions of two and more go on. A row's first candidates are its neighbours there, so that in a dense
region those of longest common prefix are met: the depth adapts to the region. Then every row meets
its whole region, but for rows that are already in one clump with it. Candidates are pairs whose sketches
reach LEAST_ESTIMATE; a clump is a connected group of candidates.

The full sets of a clump are compared exactly inside the tasks: all pairs of a block at once, as products
of incidence matrices of the shingles that repeat there. Clumps of more than a block are met block by
block, then as pairs of blocks, where only rows outside the largest component ask. Tasks give a star for
each component that they find, never more rows than they read: neither candidates nor links are listed pair
by pair. Nothing is gathered in the driver but counts, and no group is held in one task.

Two sets of similarity 0.75 miss all regions with probability (1 - 0.75**2)**16 < 2e-6. The sketches of such sets
are estimated below LEAST_ESTIMATE, over six deviations lower, with probability 2e-9; only sets that also share
no chain of candidates are lost then.

Defined results: null, empty or blank texts have an empty set, are linked with nothing and kept.
Rows that share a doc_id are one node, each row with its own n_shingles. A null doc_id is never
linked; its component is null and it is kept. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmart.llm.common import (
    bounded_batches,
    chunks_of,
    components,
    flat_ranges,
    merged,
    mix64,
    parts,
    per_text,
    split_words,
    staged,
    whole_texts,
)

SHINGLE = 5
TREES = 16
DEPTH = 8
LEAST_PREFIX = 2
SIMILARITY = (75, 100)
#: Lowest estimate of a candidate: over six deviations of the sketch below the threshold.
LEAST_ESTIMATE = 0.5
WIDTH = 8
#: Rows and shingles of a block.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
COLUMNS = 8192
SKETCH_BITS = 4

_SEEDS = mix64(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64))
_XOR = (_SEEDS[: TREES * DEPTH] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_SEEDS[TREES * DEPTH :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Shingler:
    """64-bit shingle hashes of whole texts; word hashes are kept between texts."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        words = split_words(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        codes = []
        for w in words:
            code = known.get(w)
            if code is None:
                code = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
            codes.append(code)
        column = np.array(codes, dtype=np.uint64)
        width = min(self.size, len(words))
        mixed = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            mixed = mix64(mixed * np.uint64(0xC2B2AE3D27D4EB4F) + column[i : i + len(mixed)])
        return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of a non-empty set."""
    low = (shingles >> np.uint64(20)).astype(np.uint32)
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048, None]
        np.minimum(best, ((part ^ _XOR) * _TIMES).min(axis=0), out=best)
    return best


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of two sorted distinct arrays reaches SIMILARITY."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both) and both > 0


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest halves and signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in chunks_of(texts):
                sizes, digests, signatures = [], [], []
                for text in texts[part]:
                    own = shingles_of(text)
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    signatures.append(signature(own).astype(">u4").tobytes() if len(own) else None)
                halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, len(sizes)),
                        pa.array(sizes, type=pa.int64()),
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                        pa.array(signatures, type=pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "low", "high", "signature"],
                )

    bounded_batches(docs.sparkSession)
    return whole_texts(docs).mapInArrow(run, "doc_id long, n_shingles long, low long, high long, signature binary")


def _packed_sketch(minima: np.ndarray) -> np.ndarray:
    """SKETCH_BITS of each minimum, two to a byte."""
    low = (minima & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def _orders(classes: DataFrame) -> DataFrame:
    """A row per representative and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u4").reshape(n, -1)
            sketch = [x.tobytes() for x in _packed_sketch(minima.astype(np.uint32))]
            prefix = minima.reshape(n, TREES, DEPTH)
            for tree in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, tree, dtype=np.int32)),
                        pa.array([x.tobytes() for x in prefix[:, tree]], type=pa.binary()),
                        batch.column("id"),
                        batch.column("n"),
                        pa.array(sketch, type=pa.binary()),
                    ],
                    names=["tree", "prefix", "id", "n", "sketch"],
                )

    bounded_batches(classes.sparkSession)
    return classes.mapInArrow(run, "tree int, prefix binary, id long, n long, sketch binary")


def _minima(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").reshape(n, DEPTH)


def _whole(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, to meet few batch borders."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _regions(orders: DataFrame) -> DataFrame:
    """Sorted rows with a neighbour in their region, with their range and place.

    Rows at the border of a range stay; a region cut by a border is met whole in the other trees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in _whole(batches):
            n = batch.num_rows
            head = _minima(batch.column("prefix"), n)[:, :LEAST_PREFIX]
            tree = batch.column("tree").to_numpy()
            same = (head[1:] == head[:-1]).all(axis=1) & (tree[1:] == tree[:-1])
            kept = np.concatenate([[True], same]) | np.concatenate([same, [True]])
            index = pa.array(np.flatnonzero(kept))
            places = pa.array(place + np.flatnonzero(kept))
            place += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(index), part, dtype=np.int32)), places] + [c.take(index) for c in batch.columns],
                names=["part", "place", *batch.schema.names],
            )

    spark = orders.sparkSession
    bounded_batches(spark)
    ranges = orders.repartitionByRange(parts(spark), "tree", "prefix", "id").sortWithinPartitions("tree", "prefix", "id")
    return ranges.mapInArrow(
        run, "part int, place long, tree int, prefix binary, id long, n long, sketch binary"
    )


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of packed sketches."""
    differ = a.view("<u8") ^ b.view("<u8")
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    differ &= np.uint64(0x1111111111111111)
    equal = TREES * DEPTH - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    chance = 1 / 2**SKETCH_BITS
    return (equal / (TREES * DEPTH) - chance) / (1 - chance)


def _codes(heads: DataFrame) -> DataFrame:
    """tree, code (the first LEAST_PREFIX minima) and id of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u4").reshape(n, TREES, DEPTH)
            codes = np.ascontiguousarray(minima[:, :, :LEAST_PREFIX]).view(">i8").astype(np.int64).reshape(-1)
            trees = np.tile(np.arange(TREES, dtype=np.int32), n)
            ids = batch.column("id").to_numpy().repeat(TREES)
            yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(codes), pa.array(ids)], names=["tree", "code", "id"])

    bounded_batches(heads.sparkSession)
    return heads.select("id", "signature").mapInArrow(run, "tree int, code long, id long")


def _with_company(heads: DataFrame) -> DataFrame:
    """The representatives that share a region with another one."""
    codes = _codes(heads)
    crowded = codes.groupBy("tree", "code").agg(F.count("*").alias("rows")).where("rows > 1").select("tree", "code")
    return heads.join(codes.join(crowded, ["tree", "code"], "left_semi").select("id").distinct(), "id", "left_semi")


def _neighbours(rows: DataFrame) -> DataFrame:
    """Candidate pairs a, b among the next WIDTH rows of a region, in sorted order."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        minima = _minima(table.column("prefix"), n)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(n, -1)
        part, tree, ids, size = (table.column(c).to_numpy() for c in ("part", "tree", "id", "n"))
        region = (
            (part[1:] != part[:-1]) | (tree[1:] != tree[:-1]) | (minima[1:, :LEAST_PREFIX] != minima[:-1, :LEAST_PREFIX]).any(axis=1)
        )
        region = np.concatenate([[0], np.cumsum(region)])
        every, out = np.arange(n), []
        for step in range(1, WIDTH + 1):
            i, j = every[:-step], every[step:]
            ok = (region[i] == region[j]) & _sizes_fit(size[i], size[j])
            i, j = i[ok], j[ok]
            ok = _estimates(sketch[i], sketch[j]) >= LEAST_ESTIMATE
            out.append((ids[i[ok]], ids[j[ok]]))
        return star(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _whole(batches):
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            yield pairs(table)
            held = table.slice(max(0, table.num_rows - WIDTH))

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Could sets of these sizes reach the similarity?"""
    return SIMILARITY[1] * np.minimum(a, b) >= SIMILARITY[0] * np.maximum(a, b)


def star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The links a, b as a star for each component: fewer rows than there are nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist() if len(a) else ():
        x, y = find(root.setdefault(x, x)), find(root.setdefault(y, y))
        if x != y:
            root[max(x, y)] = min(x, y)
    found = [(find(x), x) for x in root]
    found = [p for p in found if p[0] != p[1]]
    return pa.RecordBatch.from_arrays(
        [pa.array([p[k] for p in found], type=pa.int64()) for k in (0, 1)], names=["a", "b"]
    )


def _labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The rows with the label of their id, or else the id itself."""
    labels = labels.select(F.col("node").alias("id"), F.col("component").alias("found"))
    return rows.join(labels, "id", "left").withColumn(name, F.coalesce("found", "id")).drop("found")


def _blocks(rows: DataFrame, group: list[str], shares: DataFrame) -> DataFrame:
    """The rows of open groups as pairs of blocks, sorted: asked rows first, then those that ask.

    ``shares`` has for each group its largest label (main), which need not ask, and the number of blocks and
    of asking blocks.
    """
    open_rows = rows.join(shares, group)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    asked = open_rows.select("*", at("blocks").alias("block"), every("ask_blocks").alias("ask_block"), F.lit(False).alias("asks"))
    asking = open_rows.where("label <> main").select(
        "*", every("blocks").alias("block"), at("ask_blocks").alias("ask_block"), F.lit(True).alias("asks")
    )
    keys = [*group, "ask_block", "block"]
    both = asked.unionByName(asking).drop("main", "blocks", "ask_blocks")
    return both.repartition(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "asks")


def _shares(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """Groups of several labels, with their blocks: as many as their rows' weights fill."""
    shares = rows.groupBy(*group, "label").agg(F.sum("weight").alias("weight")).groupBy(*group).agg(
        F.sum("weight").alias("weight"),
        F.max("weight").alias("main_weight"),
        F.max_by("label", F.struct("weight", "label")).alias("main"),
        F.count("*").alias("labels"),
    )
    return shares.where("labels > 1").select(
        *group,
        "main",
        F.ceil(F.col("weight") / block).alias("blocks"),
        F.ceil((F.col("weight") - F.col("main_weight")) / block).alias("ask_blocks"),
    )


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], least_bytes: int = 8 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the groups' starts and the end."""
    held = None

    def cuts(table: pa.Table) -> np.ndarray:
        n = table.num_rows
        turn = np.zeros(n, dtype=bool)
        turn[:1] = True
        for name in names:
            column = table.column(name).to_numpy()
            turn[1:] |= column[1:] != column[:-1]
        return np.append(np.flatnonzero(turn), n)

    for batch in merged(batches, least_bytes):
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        starts = cuts(table)
        if len(starts) > 2:
            yield table.slice(0, starts[-2]).combine_chunks(), starts[:-1]
        held = table.slice(starts[-2])
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])
    # the worker goes on with other tasks: it need not keep the largest batch's memory
    pa.default_memory_pool().release_unused()


def _region_links(rows: DataFrame) -> DataFrame:
    """Links between the labels of candidates: every row against its whole regions."""
    group = ["tree", "code"]
    rows = rows.select(
        "tree", F.expr(f"cast(conv(hex(substring(prefix, 1, {4 * LEAST_PREFIX})), 16, -10) as bigint)").alias("code"), "id", "n", "sketch", "label"
    )
    shares = staged(_shares(rows.withColumn("weight", F.lit(1)), group, BLOCK), "open-regions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, [*group, "ask_block", "block"]):
            n = table.num_rows
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(n, -1)
            size, label, asks = (table.column(c).to_numpy() for c in ("n", "label", "asks"))
            which = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            askers = np.flatnonzero(asks)
            # rows are sorted: in a group those that are asked come first
            count = np.bincount(which[~asks], minlength=len(starts) - 1)[which[askers]]
            out = [(np.zeros(0, dtype=np.int64),) * 2]
            for some in np.split(np.arange(len(askers)), np.flatnonzero(np.diff(np.cumsum(count) >> 18)) + 1):
                i = np.repeat(askers[some], count[some])
                j = flat_ranges(starts[which[askers[some]]], count[some])
                ok = (label[i] != label[j]) & _sizes_fit(size[i], size[j])
                i, j = i[ok], j[ok]
                ok = _estimates(sketch[i], sketch[j]) >= LEAST_ESTIMATE
                i, j = label[i[ok]], label[j[ok]]
                found = np.unique(np.stack([i, j], axis=1), axis=0)
                out.append((found[:, 0], found[:, 1]))
            yield star(*(np.concatenate(x) for x in zip(*out, strict=True)))

    bounded_batches(rows.sparkSession)
    return _blocks(rows, group, shares).mapInArrow(run, "a long, b long")


def _clump_sets(docs: DataFrame, clumps: DataFrame) -> DataFrame:
    """clump, id, n and the sorted shingles of every distinct set of a clump's representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in chunks_of(texts):
                own = [shingles_of(t) for t in texts[part]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(part.start, len(own)) for c in ("clump", "id")),
                        pa.array([len(x) for x in own], type=pa.int64()),
                        pa.array([x.tobytes() for x in own], type=pa.binary()),
                    ],
                    names=["clump", "id", "n", "shingles"],
                )

    bounded_batches(docs.sparkSession)
    texts = whole_texts(docs).where("doc_id is not null").withColumnRenamed("doc_id", "id")
    found = texts.join(clumps, "id").select("clump", "id", "text").mapInArrow(run, "clump long, id long, n long, shingles binary")
    # an id may come in many rows: each of its sets once, gathered by partial aggregates
    found = found.where("n > 0").withColumn("digest", F.sha2("shingles", 256))
    once = found.groupBy("clump", "id", "n", "digest").agg(F.first("shingles").alias("shingles")).drop("digest")
    return staged(once, "clump-sets")


def linked_rows(values: np.ndarray, sizes: np.ndarray, asked: int) -> np.ndarray:
    """Boolean matrix [row, row]: which of the sets, laid one after the other, are linked.

    Shingles that no two rows share are left out first, then rows that keep too few; the sizes of all
    intersections are the product of the incidence matrix with itself, exact in single precision. With
    ``asked``, only pairs of one of the first ``asked`` rows and a later row are computed.
    """
    n = len(sizes)
    out = np.zeros((n, n), dtype=bool)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for _ in range(2):
        same = values[1:] == values[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(values) else np.zeros(0, dtype=bool)
        enough = SIMILARITY[1] * np.bincount(owner[shared], minlength=n) >= SIMILARITY[0] * sizes
        kept = shared & enough[owner]
        values, owner = values[kept], owner[kept]
    rows = np.unique(owner)
    if len(rows) < 2:
        return out
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    place = np.searchsorted(rows, owner)
    split = np.searchsorted(rows, asked) if asked else 0
    both = np.zeros((len(rows) - split, split or len(rows)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        incidence = np.zeros((len(rows), min(COLUMNS, int(column[-1]) + 1 - first)), dtype=np.float32)
        incidence[place[lo:hi], column[lo:hi] - first] = 1
        both += incidence[split:] @ (incidence[:split] if asked else incidence).T
    left, right = sizes[rows[split:]], sizes[rows[:split] if asked else rows]
    union = left[:, None] + right[None, :] - both
    out[np.ix_(rows[split:], rows[:split] if asked else rows)] = SIMILARITY[1] * both.astype(np.float64) >= SIMILARITY[0] * union
    return out | out.T


def _set_links(rows: DataFrame, names: list[str], crossed: bool) -> DataFrame:
    """Exact links inside each group of rows, as stars; ``crossed``: between rows that ask and that are asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, names):
            ids, sizes = table.column("id").to_numpy(), table.column("n").to_numpy()
            values = np.frombuffer(b"".join(table.column("shingles").to_pylist()), dtype="<u8")
            ends = np.concatenate([[0], np.cumsum(sizes)])
            asks = table.column("asks").to_numpy() if crossed else None
            label = table.column("label").to_numpy() if crossed else ids
            out = [(np.zeros(0, dtype=np.int64),) * 2]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                asked = int((~asks[s:e]).sum()) if crossed else 0
                if e - s < 2 or (crossed and asked in (0, e - s)):
                    continue
                links = linked_rows(values[ends[s] : ends[e]], sizes[s:e], asked)
                # row by row: all that its links reach
                todo = links.any(axis=0)
                while todo.any():
                    seen = np.zeros(e - s, dtype=bool)
                    start = int(todo.argmax())
                    front = np.array([start])
                    seen[start] = True
                    while len(front):
                        near = links[front].any(axis=0) & ~seen
                        seen |= near
                        front = np.flatnonzero(near)
                    todo &= ~seen
                    out.append((np.full(int(seen.sum()), label[s + start]), label[s:e][seen]))
            yield star(*(np.concatenate(x) for x in zip(*out, strict=True)))

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = docs.sparkSession
    sets = staged(_sets(docs), "shingle-sets")
    named = sets.where("n_shingles > 0 and doc_id is not null")
    key = ["low", "high"]
    # a class: equal sets. Its representative is the smallest id, with one of its (equal) signatures
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("id"))
    members = staged(named.join(classes, key).select("doc_id", "id").distinct(), "classes")
    heads = named.join(classes, key).where("doc_id = id").select("id", F.col("n_shingles").alias("n"), "signature")
    heads = heads.dropDuplicates(["id", "n", "signature"])
    regions = staged(_regions(_orders(staged(_with_company(heads), "heads"))), "regions")

    # candidates: neighbours in the sorted orders, then whole regions; a clump is what they connect
    ordered = regions.repartitionByRange(parts(spark), "part", "place").sortWithinPartitions("part", "place")
    labels = components(_neighbours(ordered), starred=True)
    more = _region_links(_labelled(regions, labels, "label"))
    clumps = components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more), starred=True)
    clumps = clumps.select(F.col("node").alias("id"), F.col("component").alias("clump"))

    # exact links in blocks of a clump's sets, then between the blocks
    rows = _clump_sets(docs, clumps)
    weight = F.greatest(F.lit(BLOCK_SHINGLES // BLOCK), "n")
    blocks = rows.groupBy("clump").agg(F.ceil(F.sum(weight) / BLOCK_SHINGLES).alias("blocks"))
    dealt = rows.join(blocks, "clump").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    names = ["clump", "block"]
    near = _set_links(dealt.repartition(parts(spark), *names).sortWithinPartitions(*names), names, False)
    # ids with several sets are one node, and so are their classes
    shared = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    same = members.join(shared.select("doc_id", "a"), "doc_id").where("a < id").select("a", F.col("id").alias("b"))
    labels = components(near.union(same), starred=True)
    large = _labelled(rows.join(blocks.where("blocks > 1"), "clump").drop("blocks"), labels, "label").withColumn("weight", weight)
    shares = staged(_shares(large, ["clump"], BLOCK_SHINGLES), "open-clumps")
    across = _set_links(_blocks(large.drop("weight"), ["clump"], shares), ["clump", "ask_block", "block"], True)
    labels = components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(across), starred=True)

    found = _labelled(members, labels, "component").groupBy("doc_id").agg(F.min("component").alias("component"))
    found = found.select(F.col("doc_id").alias("named"), "component")
    return sets.join(found, F.col("doc_id") == F.col("named"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The documents of each group's smallest id, with their own columns.

    Of rows that share the kept doc_id, those of equal sets count once: the row of smallest text, then of
    smallest hash, stays. Rows of other sets under that id, rows without words and rows with a null doc_id stay.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    given = docs.select(whole, F.col("doc_id").alias("id"))
    kept = near_duplicates(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"))
    named = given.join(kept, "id")

    def start():
        shingles_of = Shingler()

        def of_texts(texts):
            sets = [shingles_of(t or "") for t in texts]
            return [[xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]]

        return of_texts

    several = per_text(named.where("rows > 1").select("row", "id", F.col("row.text").alias("text")), start, {"digest": "binary"})
    first = F.min_by("row", F.struct(F.col("row.text"), F.xxhash64("row")))
    several = several.where("digest is null").select("row").union(
        several.where("digest is not null").groupBy("id", "digest").agg(first.alias("row")).select("row")
    )
    return named.where("rows = 1").select("row").union(several).union(given.where("id is null").select("row")).select("row.*")
