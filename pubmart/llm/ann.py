"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search (operator 10).

The tree is fitted on the SAMPLE vectors of smallest hash, which bounds the driver's share, and every
vector is then sent down to its leaf. A query walks the tree with a priority queue, largest inner
product with a node's centre first. The number of leaves to visit is widened on CALIBRATION
queries, whose true neighbours are found by brute force over all rows, until their recall reaches
TARGET; a query goes on while its leaves hold fewer rows than it asks for.

A first search of each query's FIRST nearest leaves gives it K scores; in the other leaves only rows
that reach the lowest of these are sent on, so that the number of rows does not grow with the leaves.

Leaves are searched in blocks of at most BLOCK vectors and BLOCK queries, so that neither a leaf
with a third of all rows nor a leaf that all queries visit lands in one task. Each block gives at
most K rows for each query; the last step ranks these.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinity, and rows with a
null id, take no part. Shorter vectors count as filled up with zeros. Rows that share an id are one
candidate, at its best score, and never their own neighbour. Fewer than K candidates: all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubmart.llm.common import bounded_batches, staged

K = 20
SAMPLE = 20_000
CALIBRATION = 200
TARGET = 0.95
BRANCH = 8
LEAF = 512
FIRST = 3
BLOCK = 4096
STEPS = 12
SEED = 11


def usable(frame: DataFrame) -> DataFrame:
    """id and vector, in its own precision, of the rows that take part."""
    vector = F.col("embedding")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        frame.select(F.col("vec_id").alias("id"), vector.alias("vector"))
        .where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
        .where(finite & F.exists("vector", lambda x: x != 0))
    )


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of vectors, filled up with zeros."""
    vectors = list(vectors)
    if vectors and all(len(v) == width for v in vectors):
        return np.concatenate(vectors).reshape(-1, width).astype(np.float64)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Tree:
    """Nodes in arrays: centre, children (empty for a leaf), leaf number."""

    def __init__(self, rows: np.ndarray):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._rng = np.random.default_rng(SEED)
        self._grow(rows)
        self.centre = np.array(self.centres)

    def _grow(self, rows: np.ndarray) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        groups = self._split(rows) if len(rows) > LEAF else []
        if len(groups) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(g) for g in groups]
        return node

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        centres = [rows[self._rng.integers(len(rows))]]
        for _ in range(BRANCH - 1):  # spread seeds: far rows are likelier
            far = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0)
            if far.sum() <= 1e-18:
                return []
            centres.append(rows[self._rng.choice(len(rows), p=far / far.sum())])
        centres = np.array(centres)
        for _ in range(STEPS):
            own = self._nearest(rows, centres)
            counts = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, rows)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        own = self._nearest(rows, centres)
        return [rows[own == i] for i in range(len(centres)) if (own == i).any()]

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1)[None] - 2 * rows @ centres.T).argmin(axis=1)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every node the nearest child."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, index = todo.pop()
            if not self.children[node]:
                out[index] = self.leaf[node]
                continue
            kids = self.children[node]
            own = self._nearest(rows[index], self.centre[kids])
            todo += [(kid, index[own == i]) for i, kid in enumerate(kids) if (own == i).any()]
        return out

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
                continue
            for near, kid in zip((self.centre[kids] @ query).tolist(), kids, strict=True):
                heapq.heappush(queue, (-near, kid))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, summed in the same order for every pair, so that equal vectors tie."""
    return np.einsum("qd,vd->qv", queries, rows)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, least: np.ndarray | None = None) -> pd.DataFrame:
    """The K nearest of a block for each query, if they reach ``least``; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    if least is None:
        least = np.full(len(queries), -np.inf)
    found = [pd.DataFrame({"query_id": query_ids[:0], "vec_id": ids[:0], "score": np.zeros(0)})]
    for at in range(0, len(queries), 256):
        part = slice(at, at + 256)
        scores = products(queries[part], rows)
        scores[query_ids[part, None] == ids[None]] = -np.inf
        scores[scores < least[part, None]] = -np.inf
        some = np.flatnonzero(np.isfinite(scores).any(axis=1))
        top = np.argsort(-scores[some], axis=1, kind="stable")[:, :K]
        kept = np.take_along_axis(scores[some], top, axis=1)
        real = np.isfinite(kept)
        owner = np.repeat(query_ids[part][some], real.sum(axis=1))
        found.append(pd.DataFrame({"query_id": owner, "vec_id": ids[top[real]], "score": kept[real]}))
    return pd.concat(found, ignore_index=True)


_FOUND = "query_id long, vec_id long, score double"


def ranked(found: DataFrame) -> DataFrame:
    """The K best of each query; at most K rows for each query and block come in."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= K)
        .select("query_id", "rank", "vec_id", "score")
    )


def exact(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray) -> DataFrame:
    """Brute force for a bounded set of queries against all rows, block by block."""
    width = queries.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield best(query_ids, queries, batch["id"].to_numpy(), matrix(batch["vector"], width))

    return ranked(rows.select("id", "vector").mapInPandas(run, _FOUND))


def neighbours(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: up to K nearest of each query row (both: vec_id, embedding)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, asked = usable(vectors), usable(queries)
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(width or 1, asked.agg(F.max(F.size("vector"))).first()[0] or 1)
    kind = rows.schema["vector"].dataType.simpleString()
    by_hash = (F.xxhash64("id", "vector"), F.col("id"))
    sample = rows.orderBy(*by_hash).limit(SAMPLE).select("vector").toPandas()["vector"]
    tree = Tree(matrix(sample, width))

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=tree.place(matrix(batch["vector"], width)) if len(batch) else [])

    placed = staged(rows.mapInPandas(to_leaf, f"id long, vector {kind}, leaf long"), "leaves")
    # a row for each leaf; there are at most as many leaves as sampled vectors
    held = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([held.get(leaf, 0) for leaf in range(tree.leaves)])

    visits = _calibrated(tree, sizes, placed, asked.orderBy(*by_hash).limit(CALIBRATION), width)

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query_id, given, vector in zip(batch["id"], batch["vector"], matrix(batch["vector"], width), strict=True):
                seen = rows_seen = 0
                for leaf in tree.best_first(vector):
                    enough = rows_seen > K
                    if seen >= visits and enough:
                        break
                    if sizes[leaf]:
                        out.append((query_id, given, leaf, seen < FIRST or not enough))
                        seen, rows_seen = seen + 1, rows_seen + sizes[leaf]
            yield pd.DataFrame(out, columns=["query_id", "query", "leaf", "first"])

    schema = f"query_id long, query {kind}, leaf long, first boolean"
    visiting = staged(asked.mapInPandas(to_leaves, schema), "visits")
    none = F.lit(float("-inf"))
    near = staged(_searched(placed, visiting.where("first").withColumn("least", none), width), "nearest")
    reached = (
        ranked(near).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == K)
    )
    rest = visiting.where("not first").join(reached.drop("n"), "query_id", "left")
    return ranked(near.unionByName(_searched(placed, rest.withColumn("least", F.coalesce("least", none)), width)))


def _searched(placed: DataFrame, visiting: DataFrame, width: int) -> DataFrame:
    """The best rows of every visited leaf, block by block."""
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("row_blocks")).join(
        visiting.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("query_blocks")), "leaf"
    )
    blocks = F.broadcast(blocks)  # a row for each leaf, at most SAMPLE
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.join(blocks, "leaf").select(
        "leaf",
        F.pmod(F.xxhash64("id"), "row_blocks").alias("row_block"),
        every(F.col("query_blocks")).alias("query_block"),
        "id",
        "vector",
    )
    right = visiting.join(blocks, "leaf").select(
        "leaf",
        every(F.col("row_blocks")).alias("row_block"),
        F.pmod(F.xxhash64("query_id"), "query_blocks").alias("query_block"),
        "query_id",
        "query",
        "least",
    )

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best(
            theirs["query_id"].to_numpy(),
            matrix(theirs["query"], width),
            mine["id"].to_numpy(),
            matrix(mine["vector"], width),
            theirs["least"].to_numpy(),
        )

    key = ["leaf", "row_block", "query_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, _FOUND)


def _calibrated(tree: Tree, sizes: np.ndarray, placed: DataFrame, queries: DataFrame, width: int) -> int:
    """Leaves to visit, widened until the calibration queries reach TARGET recall."""
    asked = queries.toPandas()
    if not len(asked):
        return 1
    ids, vectors = asked["id"].to_numpy(), matrix(asked["vector"], width)
    truth = exact(placed, ids, vectors).join(placed.select(F.col("id").alias("vec_id"), "leaf").distinct(), "vec_id")
    wanted = truth.select("query_id", "leaf").toPandas()
    reached = []
    for query_id, vector in zip(ids, vectors, strict=True):
        order = {leaf: i for i, leaf in enumerate(x for x in tree.best_first(vector) if sizes[x])}
        reached += [order[leaf] for leaf in wanted.loc[wanted["query_id"] == query_id, "leaf"]]
    if not reached:
        return 1
    return int(np.quantile(reached, TARGET, method="higher")) + 1


def every_twentieth(vectors: DataFrame) -> DataFrame:
    """The stated query set."""
    return vectors.where("vec_id % 20 = 0")
