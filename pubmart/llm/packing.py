"""Concatenate and cut (operator 7).

Documents are tokenised once into a written table that also holds, for every row, the tokens
before it in its partition. Two prefix sums then give each document its place in the one long
stream: a first pass adds the totals of the partitions (a row per partition), a second adds the
place inside the partition. Windows of fixed length are cut out of that stream; a document that
lies across a border gives one record per window it touches. Texts and ids are never shuffled.

Defined results: a null or empty text is one token, its end; repeated rows and rows with a null
doc_id are packed each on its own; an empty table gives no pieces. Only ``doc_id`` and ``text``
are read. A document longer than a window fills as many as it needs.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubmart.llm.common import bounded_batches, chunks_of, flat_ranges, staged, whole_texts

VOCABULARY = "word_bpe_49k.json"
END = 1
LENGTH = 2048
KEPT = 150_000
#: Signs that form one pre-token behind letters (an apostrophe may begin another).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class LetterMerges:
    """The vocabulary's merges for many words of lower-case letters at once.

    Words of one length form a matrix; each step joins, in every row, the leftmost pair of lowest
    rank. Rows without a pair are done. The ids are those of the library (tests compare them).
    """

    LONGEST = 48
    NONE = np.int32(2**30)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # byte-level characters: printable bytes stand for themselves, the others follow from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        signs = [chr(other.get(b, b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in signs], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in signs], dtype=np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        # ranks of all pairs of bytes inside a word, and of those that end it
        self.first = self._ranks(np.repeat(self.inner, 256), np.tile(self.inner, 256))
        self.last = self._ranks(np.repeat(self.inner, 256), np.tile(self.final, 256))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], self.NONE)

    def _same_length(self, words: list[bytes], n: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), n)
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        pairs = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        ranks = self.first[pairs]
        ranks[:, -1:] = self.last[pairs[:, -1:]]
        rows, out = np.arange(len(words)), [b""] * len(words)
        while len(rows):
            size = ids.shape[1]
            at = ranks.argmin(axis=1) if size > 1 else np.zeros(len(rows), dtype=np.int64)
            low = ranks[np.arange(len(rows)), at] if size > 1 else np.full(len(rows), self.NONE)
            done = low == self.NONE
            data = ids[done].astype("<u4").tobytes()
            for i, row in enumerate(rows[done].tolist()):
                out[row] = data[4 * size * i : 4 * size * (i + 1)]
            live = ~done
            rows, ids, ranks, at, low = rows[live], ids[live], ranks[live], at[live], low[live]
            if not len(rows):
                break
            every, place = np.arange(len(rows)), np.arange(size - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            ids[every, at] = self.joined[low]
            if size > 2:
                ranks = np.take_along_axis(ranks, place[:-1] + (place[:-1] >= at[:, None]), axis=1)
                for step in (-1, 0):  # the pairs on either side of the joined one
                    pair = at + step
                    some = (pair >= 0) & (pair < size - 2)
                    ranks[every[some], pair[some]] = self._ranks(
                        ids[every[some], pair[some]], ids[every[some], pair[some] + 1]
                    )
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        coded = [w.encode() for w in words]
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(coded):
            by_length.setdefault(len(w), []).append(i)
        out = [b""] * len(words)
        for n, index in by_length.items():
            for i, ids in zip(index, self._same_length([coded[i] for i in index], n), strict=True):
                out[i] = ids
        return out


class WordIds:
    """Ids of whole texts through the distinct pieces between blanks.

    The vocabulary's pattern matches no white space, and a line end counts as a blank, so a text's
    ids are those of its pieces one after the other; each distinct piece is given to the tokenizer once while it is remembered.
    Pieces are remembered in two generations of at most KEPT and a batch: a piece that is used
    again moves to the new one, so that rare words leave and frequent words stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = LetterMerges(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new, old = self.new, self.old
        if len(new) > KEPT:
            self.old, self.new = new, {}
            new, old = self.new, self.old
        missing, letters, split = set(), set(), []
        for piece in pieces.difference(new):
            ids = old.get(piece)
            if ids is not None:
                new[piece] = ids
                continue
            # Latin letters before signs: two pre-tokens, and letters are the same in lower case
            alpha = piece.isalpha()
            core = piece if alpha else piece.rstrip(SIGNS)
            if (alpha or core.isalpha()) and len(core) <= LetterMerges.LONGEST // 2 and (core.isascii() or max(core) <= "\u00ff"):
                signs, core = piece[len(core) :], core.lower()
                if core != piece:
                    split.append((piece, core, signs))
                    if signs and signs not in new:
                        missing.add(signs)
                if core not in new:
                    letters.add(core)
            else:
                missing.add(piece)
        wanted = list(missing)
        for piece, found in zip(wanted, self.tokenizer.encode_batch_fast(wanted, add_special_tokens=False), strict=True):
            new[piece] = array("I", found.ids).tobytes()
        wanted = list(letters)
        new.update(zip(wanted, self.letters(wanted), strict=True))
        for piece, core, signs in split:
            new[piece] = new[core] + new[signs] if signs else new[core]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        found = [t.replace("\n", " ").split(" ") for t in texts]
        distinct: set[str] = set()
        for pieces in found:
            distinct.update(pieces)
        self._learn(distinct)
        known = self.new
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]


def _tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part, before (tokens before it in its partition), ids (32-bit, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids, part, before = WordIds(path), TaskContext.get().partitionId(), 0
        end = END.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for piece in chunks_of(texts):
                ids = [x + end for x in word_ids(texts[piece])]
                lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(piece.start, len(ids)),
                        pa.array(np.full(len(ids), part, dtype=np.int64)),
                        pa.array(before + np.cumsum(lengths) - lengths),
                        pa.array(lengths),
                        pa.array(ids, type=pa.binary()),
                    ],
                    names=["doc_id", "part", "before", "doc_tokens", "ids"],
                )
                before += int(lengths.sum())

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, part long, before long, doc_tokens long, ids binary"
    return whole_texts(docs).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Every sequence but the last is full, so the only padding is behind the last piece.
    """
    rows = staged(_tokenised(docs, path), "packing")
    # first pass: a total per partition, and their running sum over one row for each partition
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("base"))
    # a row per partition of the scan: a proven bound, and the ids stay where they are
    placed = rows.join(F.broadcast(places), "part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            count = batch.column("doc_tokens").to_numpy()
            first, last = at // length, (at + count - 1) // length
            n = last - first + 1
            row = np.repeat(np.arange(len(at)), n)
            sequence = flat_ranges(first, n)
            begin = np.maximum(at[row], sequence * length)
            size = np.minimum(at[row] + count[row], (sequence + 1) * length) - begin
            start = begin - at[row]
            ids = batch.column("ids").to_pylist()
            cuts = [ids[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(start),
                pa.array(size),
                pa.array([zlib.crc32(c) for c in cuts], type=pa.int64()),
                pa.array(count[row]),
                pa.array(sequence),
                pa.array(begin - sequence * length),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(cuts, type=pa.binary())] * with_ids, names=NAMES + ["ids"] * with_ids)

    schema = ", ".join(f"`{c}` long" for c in NAMES) + ", ids binary" * with_ids
    return placed.mapInArrow(run, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
