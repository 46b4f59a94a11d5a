"""Document fingerprints by SpotSigs (operator 3).

A spot is an occurrence of a common word (an anchor). Its signature is the anchor with the next
CHAIN content words behind it, STEP apart; common words are passed over. A fingerprint is the set
of a text's signatures, 32 bits each, written as sorted hex. Two fingerprints are compared by
Jaccard only if their set lengths lie in the same or in reachable length partitions; the
comparison stops as soon as the words left over cannot lift the likeness to the least one asked.

``edited_pairs`` compares every document with its own edited text and with the next document by id.
The next one is found without a global sort of texts in one task: documents are cut into ranges of
ids, each range walks its own rows, and the row that begins a range is also sent to the one before.

Defined results: null texts are empty; an empty text has the empty fingerprint; two empty sets are
alike (1.0), an empty and a filled one are not (0.0). A text without a spot of full length has one
signature of all its words. Rows with equal ids follow each other by text; a null doc_id comes
first. With a single document, the next one is itself. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubmart.llm.common import bounded_batches, chunks_of, mix64, parts, per_text, split_words, staged, whole_texts

CHAIN = 2
STEP = 1

# Anchors, common words of the four languages.
ANCHORS = frozenset(
    "the of and to in a is that it for on was be with as by at from this are "
    "der die das und den von zu mit auf für ist im nicht ein eine "
    "de la le les et des en un une du que qui dans est pour par sur "
    "el los las y se del por con no su para al lo como".split()
)
_STOPS = str.maketrans("", "", ".,;:!?\"'()[]")


class Spotter:
    """Signature sets of whole texts."""

    def __init__(self, chain: int = CHAIN, step: int = STEP):
        self.chain, self.step = chain, step
        self.known: dict[str, tuple[int, bool]] = {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 32-bit signatures."""
        known = self.known
        if len(known) > 200_000:
            known.clear()
        codes, common = [], []
        for word in split_words(text):
            found = known.get(word)
            if found is None:
                bare = word.translate(_STOPS) or word
                found = known[word] = (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "replace")), bare in ANCHORS)
            codes.append(found[0])
            common.append(found[1])
        if not codes:
            return np.zeros(0, dtype=np.uint32)
        words, anchor = np.array(codes, dtype=np.uint64), np.array(common)
        content = words[~anchor]
        spots = np.flatnonzero(anchor)
        # the first content word behind a spot has as many content words before it as the spot has
        first = (spots - np.arange(len(spots))).astype(np.int64)
        last = first + (self.chain - 1) * self.step
        whole = last < len(content)
        mixed = words[spots[whole]]
        for i in range(self.chain):
            mixed = mix64(mixed * np.uint64(0xC2B2AE3D27D4EB4F) + content[first[whole] + i * self.step])
        if not len(mixed):
            mixed = np.array([xxhash.xxh3_64_intdigest(words.tobytes())], dtype=np.uint64)
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def length_partition(n: int, least: float) -> int:
    """Sets whose partitions differ by more than one cannot reach a likeness of ``least``."""
    return int(np.floor(np.log(max(n, 1)) / -np.log(least)))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0.0 where it is certain to be below ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if least and (
        abs(length_partition(len(a), least) - length_partition(len(b), least)) > 1
        or min(len(a), len(b)) < least * max(len(a), len(b))
    ):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def start():
        spotted = Spotter()
        return lambda texts: [[written(spotted(t)) for t in texts]]

    return per_text(whole_texts(docs), start, {"fingerprint": "string"})


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DIGEST = {
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}


def _row(text: str, own: np.ndarray, after: str, then: np.ndarray, spotted: Spotter) -> tuple:
    """The digest columns of a text with signatures ``own`` that ``after`` follows."""
    changed = edited(text, after)
    other = spotted(changed)
    return (
        len(text),
        hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(),
        written(own),
        written(other),
        likeness(own, other),
        likeness(own, then),
    )


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _dealt(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Rows with the range of ids they belong to; the rows that begin a range are also sent to the
    range before, as the texts that follow its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([-1 if i is None else np.searchsorted(bounds, i, side="right") for i in batch.column("doc_id").to_pylist()])
            starts = np.array([i in first for i in batch.column("doc_id").to_pylist()], dtype=bool)
            index = np.concatenate([np.arange(len(ids)), np.flatnonzero(starts)])
            ranges = np.concatenate([np.maximum(ids, 0), ids[starts] - 1]).astype(np.int32)
            ahead = np.arange(len(index)) >= len(ids)
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(index)) for c in batch.columns] + [pa.array(ranges), pa.array(ahead)],
                names=["doc_id", "text", "range", "ahead"],
            )

    first = set(bounds.tolist())
    return rows.mapInArrow(run, "doc_id long, text string, range int, ahead boolean")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id with the digest columns, for every document.

    The bounds of the ranges are ids of the table at its quantiles, so the first row of a range is
    known by its id; texts are shuffled once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, n = whole_texts(docs), 2 * parts(spark)
    steps = F.array(*[F.lit(i / n) for i in range(n)])
    bounds = np.array(sorted(set(rows.agg(F.percentile_approx("doc_id", steps, F.lit(10_000))).first()[0] or [])), dtype=np.int64)
    beginning = rows.orderBy(F.asc_nulls_first("doc_id"), "text").limit(1).collect()
    first_text = beginning[0]["text"] if beginning else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotted, held = Spotter(), None
        first_set = spotted(first_text)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "range", "ahead")]
            for piece in chunks_of(texts):
                ids, found = [], []
                for doc_id, place, ahead, text in zip(*[c[piece] for c in columns], texts[piece], strict=True):
                    own = spotted(text)
                    if held is not None:
                        follows = (text, own) if held[1] == place else (first_text, first_set)
                        ids.append(held[0])
                        found.append(_row(*held[2:], *follows, spotted))
                    held = None if ahead else (doc_id, place, text, own)
                yield _batch(ids, found)
        if held is not None:
            yield _batch([held[0]], [_row(*held[2:], first_text, first_set, spotted)])

    order = ("range", "ahead", F.asc_nulls_first("doc_id"), "text")
    ranges = _dealt(rows, bounds).repartition(parts(spark), "range").sortWithinPartitions(*order)
    return ranges.mapInArrow(run, f"doc_id long, {_COLUMNS}")


def _batch(ids: list, found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * len(_DIGEST)
    arrays = [pa.array(c, type=k) for c, k in zip(columns, _DIGEST.values(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), *arrays], names=["doc_id", *_DIGEST])


def similar_pairs(docs: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of different ids whose fingerprints are at least ``least`` (over 0) alike.

    A set meets the sets of its own and the next length partition only, and only through the
    smallest signatures that a pair of this likeness must share (prefix filter); the rest of the
    comparison is pruned by length. Rare signatures come first, so that a common chain is no hot key.
    """
    spark = docs.sparkSession
    sets = staged(fingerprints(docs.where("doc_id is not null")).where("fingerprint <> ''").distinct(), "fingerprints")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, codes = [], []
            for i, text in enumerate(batch.column("fingerprint").to_pylist()):
                own = np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.int64)
                owners += [i] * len(own)
                codes.append(own)
            codes = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owners, type=pa.int64())), pa.array(codes)], names=["doc_id", "code"]
            )

    bounded_batches(spark)
    codes = sets.mapInArrow(spread, "doc_id long, code long")
    frequent = codes.groupBy("code").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("n", "code")
    size = F.count("*").over(Window.partitionBy("doc_id"))
    heads = (
        codes.join(frequent.where("n > 1"), "code", "left")
        .select("doc_id", "code", F.coalesce("n", F.lit(1)).alias("n"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("size", size)
        .where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
        .where("n > 1")
        .withColumn("partition", F.floor(F.log(F.col("size").cast("double")) / -np.log(least)))
    )
    heads = staged(heads.select("doc_id", "code", "size", "partition"), "heads")
    one = heads.select(F.col("doc_id").alias("a"), "code", F.col("size").alias("size_a"), F.explode(F.array("partition", F.col("partition") + 1, F.col("partition") - 1)).alias("partition"))
    two = heads.select(F.col("doc_id").alias("b"), "code", F.col("size").alias("size_b"), "partition")
    pairs = one.join(two, ["code", "partition"]).where(
        (F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
    ).select("a", "b").distinct()
    left = sets.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("of_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda text: np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)
        for batch in batches:
            near = [
                likeness(read(x), read(y), least)
                for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, type=pa.float64())], names=["a", "b", "near"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long, near double").where(F.col("near") >= least)
