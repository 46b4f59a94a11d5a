"""Substring deduplication by content-defined chunks (operator 4).

A gear hash rolls over the last bytes of the UTF-8 text; a chunk ends where its top bits are
zero, so that borders move with the content and an insertion changes the chunks around it only.
Chunks are told apart by a 128-bit digest. A digest belongs to the document of smallest id that
holds it; in every other document it is a repeat. Consecutive repeats form a passage; a passage of
at least ``LEAST_WORDS`` words is reported and, by ``without_repeats``, taken out.

A digest that occurs in a third of all documents is counted by partial aggregation before the
shuffle, once per document; the join back to its places can be split by adaptive execution, because
no operator above it needs a digest's rows together. Passages are put together per document.

Defined results: null and empty texts have no chunks; rows that share a doc_id (null too, which
comes after all others) are one document, so that what they share is kept; a text that repeats only
itself is left alone. Other columns pass through ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmart.llm.common import bounded_batches, chunks_of, mix64, staged

WINDOW_BITS = 4  # 2**4 bytes of window
BORDER_BITS = 5  # a border every 2**5 bytes on average, behind LEAST_BYTES
LEAST_BYTES = 24
MOST_BYTES = 1024
LEAST_WORDS = 16

#: A fixed random value for each byte, from a counter.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def borders(data: bytes) -> np.ndarray:
    """Ends of the chunks of a UTF-8 text, the last one its length; never inside a character."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    rolled = GEAR[raw]
    for k in range(WINDOW_BITS):  # doubles the window: h(2w) = h(w) + h(w) of w bytes earlier << w
        w = 1 << k
        shifted = rolled.copy()
        shifted[w:] += rolled[:-w] << np.uint32(w)
        rolled = shifted
    starts_char = np.ones(n + 1, dtype=bool)
    starts_char[:n] = (raw & 0xC0) != 0x80
    ends = np.flatnonzero((rolled >> np.uint32(32 - BORDER_BITS) == 0) & starts_char[1:]) + 1
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > MOST_BYTES:  # only texts without borders, such as one repeated letter
            last += MOST_BYTES
            while not starts_char[last]:
                last -= 1
            out.append(last)
        if end - last >= LEAST_BYTES or end == n:
            if end > last:
                out.append(end)
            last = end
    return np.array(out, dtype=np.int64)


def digests(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ends of the chunks and their digests."""
    ends = borders(data)
    starts = [0, *ends.tolist()][: len(ends)]
    return ends, [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)]


def _chunked(docs: DataFrame) -> DataFrame:
    """doc_id and the two halves of each digest of the document, once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in chunks_of(texts, 1 << 19):
                rows, found = [], []
                for row in range(part.start, part.stop):
                    own = set(digests((texts[row] or "").encode("utf-8", "replace"))[1])
                    rows += [row] * len(own)
                    found += own
                halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, type=pa.int64())),
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                    ],
                    names=["doc_id", "low", "high"],
                )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, low long, high long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id and its repeats: an array of (low, high, first_doc_id)."""
    places = staged(_chunked(docs), "chunks")
    firsts = (
        places.groupBy("low", "high")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id"))
        .where("n > 1")
        .select("low", "high", "first_doc_id")
    )
    repeats = places.join(firsts, ["low", "high"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    return repeats.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high", "first_doc_id")).alias("repeats"))


def passages(data: bytes, repeats: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(start, end, first_doc_id) in bytes: runs of consecutive repeats, long enough."""
    ends, own = digests(data)
    out, at, run = [], 0, None
    for end, digest in zip(ends.tolist(), own, strict=True):
        if digest in repeats:
            run = (run[0], end, run[2]) if run else (at, end, repeats[digest])
        elif run:
            out.append(run)
            run = None
        at = end
    if run:
        out.append(run)
    return [r for r in out if len(data[r[0] : r[1]].split()) >= LEAST_WORDS]


def _by_digest(repeats: list[dict] | None) -> dict[bytes, int]:
    return {struct.pack("<qq", r["low"], r["high"]): r["first_doc_id"] for r in repeats or ()}


def _with_repeats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows next to their document's repeats, null where there are none."""
    found = repeated_chunks(docs).select(F.col("doc_id").alias("__doc_id"), F.col("repeats").alias("__repeats"))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns])
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left").drop("__doc_id")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """A row per repeated passage: doc_id, start, end (code points), words, first_doc_id, sha256.

    ``first_doc_id`` is the document that keeps the passage's first chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index = [], []
            repeats = batch.column("__repeats").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                for start, end, first in passages(data, _by_digest(repeats[i])):
                    a, piece = len(data[:start].decode()), data[start:end]
                    index.append(i)
                    rows.append(
                        (a, a + len(piece.decode()), len(piece.split()), first, hashlib.sha256(piece).hexdigest())
                    )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(index, type=pa.int64()))]
                + [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "end", "words", "first_doc_id", "sha256"],
            )

    bounded_batches(docs.sparkSession)
    rows = _with_repeats(docs, ["doc_id", "text"]).where("__repeats is not null")
    return rows.mapInArrow(
        run, "doc_id long, start long, end long, words long, first_doc_id long, sha256 string"
    )


def cut(text: str, repeats: dict[bytes, int]) -> str:
    """The text without its repeated passages."""
    if not repeats:
        return text
    data = text.encode("utf-8", "replace")
    out, at = [], 0
    for start, end, _ in passages(data, repeats):
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]]).decode()


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages; n_chars is counted anew where it is a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            repeats = batch.column("__repeats").to_pylist()
            texts = [
                t if t is None else cut(t, _by_digest(r))
                for t, r in zip(batch.column("text").to_pylist(), repeats, strict=True)
            ]
            columns = [pa.array(texts, type=pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    bounded_batches(docs.sparkSession)
    names = docs.columns
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    rows = _with_repeats(docs, names).mapInArrow(run, schema)
    changed = F.length("text").cast("long").alias("n_chars")
    return rows.select(*[changed if c == "n_chars" else F.col(f"`{c}`") for c in names])
