"""Prefix trie of conversations by a splitter skeleton (operator 11).

A turn becomes a unit of fixed width: 128 bits of the SHA-256 of role and text, and the code points of the
text. A conversation is cut into segments of ``SEGMENT`` units; a segment's root is named by its number and a
128-bit hash of all units before it. Segments are sorted by (root, units, conv_id), so that the members of
every node are neighbours.

Splitters drawn from a bounded sample (``SAMPLE`` rows a range) cut that order into ranges of like size, one a
partition, within a group of equal conversations too. The trie of the splitters' paths, the skeleton, is
broadcast: a node whose members lie in two ranges is a prefix of a splitter. Each sorted shard is read once
with a stack and finishes all other nodes; of skeleton nodes it gives partial aggregates, which are added up
over the shards and then along the skeleton. At most ``SEGMENT`` nodes a splitter are skeleton nodes.

Sums over subtrees that go on into the next segments are added by doubling: after k rounds every root holds
its sums down to 2**k segments below it. Conversations of one segment each, which is the usual case, need none.

No conversation, group of copies or node is held in one task: places in a conversation come from ranges of
the sorted turns plus the counts of the ranges before, a segment is bounded, and a shard's stack holds
the open nodes of one path and the children of its open nodes. SHA-256 of a node's ends is sequential by
nature: a skeleton node's ids are joined to chunks of ``CHUNK`` bytes in the shards, and only these chunks of
one node pass one after the other.

Defined results: rows with a null conv_id take no part. Turns are sorted by turn (null first), then by the hash
of role and text; repeated rows are turns each. Null role or text counts as empty. No conversations: no rows,
not even a root. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pubmart.llm.common import bounded_batches, parts, staged

SEGMENT = 512
SAMPLE = 20
CHUNK = 1 << 16
ROWS = 8192
HEAD_TURNS = 6
BLOCK = 100
DIGEST, UNIT = 16, 24

ROOT = ["seg", "hi", "lo"]
RECORD = pa.schema(
    [
        ("seg", pa.int64()),
        ("hi", pa.int64()),
        ("lo", pa.int64()),
        ("step", pa.int64()),  # depth below the segment's root
        ("skeleton", pa.int64()),  # a partial aggregate of this skeleton node
        ("parent_skeleton", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
        ("more", pa.bool_()),
        ("next_hi", pa.int64()),
        ("next_lo", pa.int64()),
        ("below_children", pa.int64()),
        ("below_leaves", pa.int64()),
        ("below_saved", pa.int64()),
        ("first_end", pa.int64()),
        ("chunk", pa.string()),
    ]
)
RECORD_TYPES = ", ".join(f"{f.name} {({'int64': 'long', 'bool': 'boolean'}).get(str(f.type), 'string')}" for f in RECORD)


def units(conversations: DataFrame) -> DataFrame:
    """conv_id, turn and unit of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    unit = F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(F.length(text)), 2 * (UNIT - DIGEST), "0"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.unhex(unit).alias("unit"))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, unit) with places from 0, and (conv_id, n_turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            nth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                nth[ids == last] += count
            last, count = int(ids[-1]), int(nth[-1]) + 1
            columns = [batch.column("conv_id"), pa.array(np.full(len(ids), part, dtype=np.int64)), pa.array(nth), batch.column("unit")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "nth", "unit"])

    order = ["conv_id", F.col("turn").asc_nulls_first(), "unit"]
    ranges = turns.repartitionByRange(parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = staged(ranges.mapInArrow(run, "conv_id long, part long, nth long, unit binary"), "turns")
    shares = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    late = shares.withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv_id", "part", "before")
    place = F.col("nth") + F.coalesce("before", F.lit(0))
    rows = rows.join(late, ["conv_id", "part"], "left").select("conv_id", place.alias("place"), "unit")
    return rows, shares.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, unit, length) of the rebuilt turns, and (conv_id, length) of every conversation."""
    turns, counts = placed(units(conversations))
    own_head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS
    bases = counts.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    convs = counts.select("conv_id", "n_turns", own_head.alias("head"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    taken = F.least("head", F.coalesce("base_turns", F.lit(0)))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("n_turns") - F.col("head"), F.lit(0))).alias("length")
    )
    convs = staged(convs, "conversations")
    own = (
        turns.join(convs, "conv_id")
        .where("place >= head")
        .select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "unit", "length")
    )
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < HEAD_TURNS)).withColumnRenamed("conv_id", "base")
    given = convs.join(heads, "base").where("place < head").select("conv_id", "place", "unit", "length")
    return own.union(given), convs.select("conv_id", "length")


def segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """A row per conversation and segment, with its root, the root below and whether there is one."""
    units_in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "unit"))), lambda x: F.hex(x["unit"]))
    rows = turns.groupBy("conv_id", "length", F.floor(F.col("place") / segment).alias("seg")).agg(
        F.unhex(F.array_join(units_in_order, "")).alias("path")
    )
    none = convs.where("length = 0").select("conv_id", "length", F.lit(0).cast("long").alias("seg"), F.lit(b"").alias("path"))
    short = rows.where(F.col("length") <= segment).union(none)
    nothing = F.lit(None).cast("long")
    short = short.select(
        "conv_id", "seg", F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "path",
        F.lit(False).alias("more"), nothing.alias("next_hi"), nothing.alias("next_lo"), nothing.alias("up_hi"), nothing.alias("up_lo"),
    )
    # the hash of all units before a segment: the segments' own hashes, each with its number, combined
    own = [F.xxhash64(F.lit(k), "seg", F.sha2("path", 256)).alias(f"own_{k}") for k in (1, 2)]
    order = Window.partitionBy("conv_id").orderBy("seg")
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where(F.col("length") > segment).select("*", *own)
    long = long.select("*", *[F.coalesce(F.bit_xor(f"own_{k}").over(until), F.lit(0)).alias(n) for k, n in ((1, "hi"), (2, "lo"))])
    more = (F.col("seg") + 1) * segment < F.col("length")
    long = long.select(
        "conv_id", "seg", "hi", "lo", "path", more.alias("more"),
        F.when(more, F.col("hi").bitwiseXOR(F.col("own_1"))).alias("next_hi"),
        F.when(more, F.col("lo").bitwiseXOR(F.col("own_2"))).alias("next_lo"),
        F.lag("hi").over(order).alias("up_hi"), F.lag("lo").over(order).alias("up_lo"),
    )
    return short.union(long)


class Skeleton:
    """The trie of the splitters' paths: a number, a parent and children for each node."""

    def __init__(self, splitters: list[tuple]):
        self.roots: dict[tuple, int] = {}
        self.children: list[dict[bytes, int]] = []
        self.nodes: list[tuple] = []
        for seg, hi, lo, path, _ in splitters:
            node = self.roots.get((seg, hi, lo))
            if node is None:
                node = self.roots[seg, hi, lo] = self._add(None, seg, hi, lo, 0, 0)
            for step, at in enumerate(range(0, len(path), UNIT), 1):
                unit = path[at : at + UNIT]
                child = self.children[node].get(unit)
                if child is None:
                    child = self._add(node, seg, hi, lo, step, int.from_bytes(unit[DIGEST:], "big"))
                    self.children[node][unit] = child
                node = child

    def _add(self, *node) -> int:
        self.nodes.append((len(self.nodes), *node))
        self.children.append({})
        return len(self.nodes) - 1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, "skeleton long, parent long, seg long, hi long, lo long, step long, tokens long")


class Open:
    """A node on the path of the row that is being read."""

    __slots__ = ("step", "skeleton", "tokens", "n", "least", "children", "leaves", "saved", "ends", "first", "digest", "waiting", "more")

    def __init__(self, step: int, skeleton: int | None, tokens: int):
        self.step, self.skeleton, self.tokens = step, skeleton, tokens
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[str] = []
        self.first: int | None = None
        self.digest = None
        self.waiting: list[list] = []
        self.more = None


class Shard:
    """Reads the sorted rows of a shard and gives records of RECORD."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.records: list[list] = []
        self.stack: list[Open] = []
        self.root: tuple | None = None
        self.key: tuple | None = None
        self.path = b""

    def read(self, key: tuple, path: bytes, conv: int, more, below: tuple) -> None:
        """``key`` is (shard, seg, hi, lo); ``below``: the next root, and its children, leaves and savings."""
        same = 0
        if key == self.key:
            most = min(len(path), len(self.path))
            while same < most and path[same : same + UNIT] == self.path[same : same + UNIT]:
                same += UNIT
            self.close_to(same // UNIT)
        else:
            self.close_to(-1)
            self.key, self.root = key, key[1:]
            self.stack.append(Open(0, self.skeleton.roots.get(self.root), 0))
        for at in range(same, len(path), UNIT):
            unit = path[at : at + UNIT]
            above = self.stack[-1].skeleton
            number = None if above is None else self.skeleton.children[above].get(unit)
            self.stack.append(Open(len(self.stack), number, int.from_bytes(unit[DIGEST:], "big")))
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if more:
            node.more = below
        else:
            self._end(node, conv)

    def _end(self, node: Open, conv: int) -> None:
        if node.first is None:
            node.first = conv
        node.ends.append(str(conv))
        if len(node.ends) * 8 >= CHUNK:
            self._flush(node)

    def _flush(self, node: Open) -> None:
        """Hand on the ids held: to the node's hash, or as a chunk of a skeleton node."""
        if not node.ends:
            return
        joined = ",".join(node.ends)
        if node.skeleton is not None:
            record = self._record(node)
            record[-2:] = node.first, joined
            self.records.append(record)
            node.first = None
        else:
            if node.digest is None:
                node.digest = hashlib.sha256(joined.encode())
            else:
                node.digest.update(b"," + joined.encode())
        node.ends = []

    def _record(self, node: Open) -> list:
        return [*self.root, node.step, node.skeleton, *[None] * 16]

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            self._close(node, self.stack[-1] if self.stack else None)

    def _close(self, node: Open, parent: Open | None) -> None:
        self._flush(node)
        below = node.more or (None, None, 0, 0, 0)
        children, leaves, saved = node.children, node.leaves, node.saved
        record = self._record(node)
        if node.skeleton is None:
            children, leaves, saved = children + below[2], leaves + below[3], saved + below[4]
            if not children and node.more is None:
                leaves = 1
            saved += (node.n - 1) * node.tokens
            record[12] = (node.digest or hashlib.sha256()).hexdigest()
        record[6], record[8:12], record[13:19] = node.least, [node.n, children, leaves, saved], [node.more is not None, *below]
        for child in node.waiting:
            child[7] = node.least
        self.records += node.waiting
        if parent is not None:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
        if parent is None or parent.skeleton is not None:
            record[5] = None if parent is None else parent.skeleton
            self.records.append(record)
        else:
            parent.waiting.append(record)
        if parent is not None and node.skeleton is None:
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.records, strict=True) if self.records else [[] for _ in RECORD]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, RECORD, strict=True)], schema=RECORD)
        self.records = []
        return out


def _splitters(rows: DataFrame, count: int) -> list[tuple]:
    """``count`` - 1 rows that cut the order into ranges of like size, by a bounded sample."""
    names = [*ROOT, "path", "conv_id"]
    lines = rows.orderBy(F.xxhash64("conv_id", "seg"), "conv_id", "seg").limit(SAMPLE * count).select(*names).collect()
    keys = sorted((r["seg"], r["hi"], r["lo"], bytes(r["path"]), r["conv_id"]) for r in lines)
    return sorted({keys[len(keys) * k // count] for k in range(1, count)}) if keys else []


def _records(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Finished nodes, partial aggregates of skeleton nodes and chunks of their ends."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (*ROOT, "path", "conv_id")), strict=True)
            shard = pa.array([bisect_right(cuts, key) for key in keys], type=pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names=["shard", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(Skeleton(sent.value))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            for number, conv, seg, hi, lo, path, more, *below in zip(*columns, strict=True):
                shard.read((number, seg, hi, lo), path, conv, more, tuple(below))
                if len(shard.records) >= ROWS:
                    yield shard.batch()
        shard.close_to(-1)
        yield shard.batch()

    names = ["conv_id", *ROOT, "path", "more", "next_hi", "next_lo", "below_children", "below_leaves", "below_saved"]
    rows = rows.select(*names)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    bounded_batches(spark)
    dealt = rows.mapInArrow(deal, "shard int, " + types)
    order = ["shard", *ROOT, "path", "conv_id"]
    shards = dealt.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions(*order)
    return staged(shards.mapInArrow(run, RECORD_TYPES), "trie")


def subtree_sums(nodes: DataFrame, *values: str) -> DataFrame:
    """``nodes`` (id, parent, values) with every value added up over its subtree, by doubling."""
    now = staged(nodes, "subtrees")
    while now.where("parent is not null").limit(1).count():
        given = now.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        above = now.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        added = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
        now = staged(now.join(given, "id", "left").join(above, "parent", "left").select("id", F.col("next").alias("parent"), *added), "subtrees")
    return now


def _ends(chunks: DataFrame) -> DataFrame:
    """SHA-256 of each skeleton node's chunks in order, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for batch in batches:
            for number, chunk in zip(batch.column("skeleton").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if number != node:
                    if digest is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = number, hashlib.sha256(chunk.encode())
                else:
                    digest.update(b"," + chunk.encode())
        if digest is not None:
            done.append((node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in done], type=pa.int64()), pa.array([d for _, d in done], type=pa.string())], names=["skeleton", "ends"]
        )

    spark = chunks.sparkSession
    sorted_chunks = chunks.repartition(parts(spark), "skeleton").sortWithinPartitions("skeleton", "first_end")
    return sorted_chunks.select("skeleton", "chunk").mapInArrow(run, "skeleton long, ends string")


def _nodes(records: DataFrame, skeleton: Skeleton) -> DataFrame:
    """All nodes, roots of later segments included: the finished ones and the reduced skeleton."""
    spark = records.sparkSession
    shape = skeleton.table(spark)
    partial = (
        records.where("skeleton is not null and chunk is null")
        .groupBy("skeleton")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
            F.max("more").alias("more"),
            F.max("next_hi").alias("next_hi"),
            F.max("next_lo").alias("next_lo"),
            # the same in every shard
            F.max("below_children").alias("below_children"),
            F.max("below_leaves").alias("below_leaves"),
            F.max("below_saved").alias("below_saved"),
        )
    )
    inner = shape.where("parent is not null").groupBy(F.col("parent").alias("skeleton")).agg(F.count("*").alias("inner"))
    children = F.col("n_children") + F.coalesce("inner", F.lit(0)) + F.col("below_children")
    leaf = F.when((children == 0) & ~F.col("more"), 1).otherwise(0)
    reduced = shape.join(partial, "skeleton").join(inner, "skeleton", "left")
    reduced = reduced.select(
        "skeleton", "parent", *ROOT, "step", "conv_id", "n_convs", children.alias("n_children"), "next_hi", "next_lo",
        (F.col("n_leaves") + F.col("below_leaves") + leaf).alias("own_leaves"),
        (F.col("saved_tokens") + F.col("below_saved") + (F.col("n_convs") - 1) * F.col("tokens")).alias("own_saved"),
    )
    reduced = staged(reduced, "skeleton")
    sums = subtree_sums(
        reduced.select(F.col("skeleton").alias("id"), "parent", F.col("own_leaves").alias("n_leaves"), F.col("own_saved").alias("saved_tokens")),
        "n_leaves",
        "saved_tokens",
    )
    ends = _ends(records.where("chunk is not null").select("skeleton", "first_end", "chunk"))
    names = reduced.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256().hexdigest()
    big = (
        reduced.join(sums.select(F.col("id").alias("skeleton"), "n_leaves", "saved_tokens"), "skeleton")
        .join(ends, "skeleton", "left")
        .join(names, "parent", "left")
    )
    columns = [*ROOT, "step", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "next_hi", "next_lo"]
    big = big.withColumn("ends_sha256", F.coalesce("ends", F.lit(none))).select(*columns)
    small = records.where("skeleton is null").join(names.withColumnsRenamed({"parent": "parent_skeleton", "parent_conv_id": "named"}), "parent_skeleton", "left")
    small = small.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named")).select(*columns)
    return big.union(small)


def _with_later_segments(rows: DataFrame, splitters: list[tuple], skeleton: Skeleton) -> DataFrame:
    """The segments with what hangs below each of them: children, leaves and savings of the next root."""
    roots = _nodes(_records(rows, splitters), skeleton).where("step = 0 and seg > 0")
    name = lambda *c: F.concat_ws(":", *c)
    above = rows.where("seg > 0").select(*ROOT, F.when(F.col("seg") > 1, name(F.col("seg") - 1, "up_hi", "up_lo")).alias("parent")).distinct()
    roots = staged(roots.join(above, ROOT).select(name(*ROOT).alias("id"), "parent", "n_children", "n_leaves", "saved_tokens"), "roots")
    sums = subtree_sums(roots.select("id", "parent", "n_leaves", "saved_tokens"), "n_leaves", "saved_tokens")
    below = sums.join(roots.select("id", "n_children"), "id").select(
        "id", F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved")
    )
    rows = rows.drop("below_children", "below_leaves", "below_saved")
    rows = rows.withColumn("id", F.when(F.col("more"), name(F.col("seg") + 1, "next_hi", "next_lo")))
    return rows.join(below, "id", "left").drop("id")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    none = {c: F.lit(0).cast("long") for c in ("below_children", "below_leaves", "below_saved")}
    rows = staged(segments(*rebuilt(conversations), segment).withColumns(none), "segments")
    splitters = _splitters(rows, parts(spark))
    skeleton = Skeleton(splitters)
    deep = rows.where("more").limit(1).count() > 0
    if deep:
        rows = _with_later_segments(rows, splitters, skeleton)
    nodes = _nodes(_records(rows, splitters), skeleton)
    if deep:
        # the parent of a segment's first nodes is the last node of the segment before
        last = nodes.where("next_hi is not null").select(
            (F.col("seg") + 1).alias("seg"), F.col("next_hi").alias("hi"), F.col("next_lo").alias("lo"), F.lit(1).cast("long").alias("step"), F.col("conv_id").alias("last_conv")
        )
        nodes = nodes.join(last, [*ROOT, "step"], "left").withColumn("parent_conv_id", F.coalesce("last_conv", "parent_conv_id"))
    return nodes.where("seg = 0 or step > 0").select(
        "conv_id",
        (F.col("seg") * segment + F.col("step")).alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )
