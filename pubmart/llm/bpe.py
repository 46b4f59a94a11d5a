"""Byte-level BPE by a two-tier lookup (operator 9).

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token in one probe,
because a pre-token that is itself in the vocabulary is always encoded as that one rank. Tier
two: the rest are merged from bytes with a heap over a linked list, lowest rank first.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are
encoded each on its own; rows with a null doc_id keep it. Only ``doc_id`` and ``text`` are read,
so further columns cannot clash. Text is processed whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from pubmart.llm.common import mix64, per_text, whole_texts

FILE = "byte_bpe_multi_50k.tiktoken"
BUCKET = 4
#: Distinct pre-tokens of a generation.
KEPT = 200_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("Ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """Minimal perfect hash: a bucket's displacement sends its keys to free slots 0..n-1."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // BUCKET))
        codes = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(codes)) != self.n:
            raise ValueError("Two keys share a 64-bit code; choose another seed")
        bucket = (codes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(counts) - counts
        self.shift = np.zeros(self.buckets, dtype=np.uint32)
        self.rank = np.full(self.n, -1, dtype=np.int64)
        taken = np.zeros(self.n, dtype=bool)
        for b in np.argsort(-counts, kind="stable"):
            size = counts[b]
            if not size:
                break
            members = order[starts[b] : starts[b] + size]
            base, width = 0, 64
            while True:  # a block of displacements at a time, wider when few slots are free
                tries = np.arange(base, base + width, dtype=np.uint64)
                slots = self._slots(codes[members][None, :], tries[:, None])
                free = ~taken[slots].any(axis=1)
                if size > 1:
                    ordered = np.sort(slots, axis=1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                hit = np.flatnonzero(free)
                if len(hit):
                    row = slots[hit[0]]
                    self.shift[b] = base + hit[0]
                    taken[row] = True
                    self.rank[row] = members
                    break
                base, width = base + width, min(width * 4, 65_536)

    def _slots(self, codes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix64(codes + shift * np.uint64(0x94D049BB133111EB)) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the one rank it can have; the caller compares the bytes."""
        codes = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        shift = self.shift[(codes % np.uint64(self.buckets)).astype(np.int64)].astype(np.uint64)
        return self.rank[self._slots(codes, shift)]


class Merges:
    """Ids of pieces that are not tokens: repeatedly join the pair of lowest rank, leftmost first.

    Every part is a token at any time, so a pair is looked up by its two ids and not by its bytes; a joined
    token's id is its rank. The heaps' first entries are found for many pieces at once.
    """

    SHIFT = 32

    def __init__(self, tokens: list[bytes]):
        ranks = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("Every byte must be a token")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.two = np.full(1 << 16, -1, dtype=np.int64)  # ranks of pairs of bytes
        self.joined: dict[int, int] = {}
        for joined, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left << self.SHIFT | right] = joined
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = joined

    def __call__(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each piece; no piece is empty."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        stops = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        # the rank of each part's pair with the part behind it; -1: no token, or the last part
        rank = np.full(len(flat), -1, dtype=np.int64)
        rank[:-1] = self.two[flat[:-1] << 8 | flat[1:]]
        rank[stops - 1] = -1
        some = rank >= 0
        entries = (rank << self.SHIFT | np.arange(len(flat)) - np.repeat(stops - sizes, sizes))[some].tolist()
        ids, ranks = self.single[flat].tolist(), rank.tolist()
        begin = first = 0
        for stop, last in zip(stops.tolist(), np.cumsum(some)[stops - 1].tolist(), strict=True):
            yield self._merged(ids[begin:stop], ranks[begin:stop], entries[first:last])
            begin, first = stop, last

    def _merged(self, ids: list[int], rank: list[int], heap: list[int]) -> list[int]:
        joined, pop, push, n, shift = self.joined, heapq.heappop, heapq.heappush, len(ids), self.SHIFT
        place = (1 << shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            low = pop(heap)
            left, token = low & place, low >> shift
            if rank[left] != token:  # stale: the pair has changed or gone
                continue
            right = after[left]
            ids[left], ids[right], rank[right] = token, -1, -1
            behind = after[left] = after[right]
            rank[left] = -1
            if behind < n:
                before[behind] = left
                pair = token << shift | ids[behind]
                if pair in joined:
                    rank[left] = found = joined[pair]
                    push(heap, found << shift | left)
            front = before[left]
            if front >= 0:
                rank[front] = -1
                pair = ids[front] << shift | token
                if pair in joined:
                    rank[front] = found = joined[pair]
                    push(heap, found << shift | front)
        return [i for i in ids if i >= 0]


class TwoTier:
    """Encoder of whole texts; one per task.

    Distinct pre-tokens are remembered in two generations of at most KEPT and a batch: one that is used
    again moves to the new one, so that rare ones leave and frequent ones stay.
    """

    def __init__(self, tokens: list[bytes], perfect: PerfectHash, merges: Merges, pattern: str):
        self.tokens = tokens
        self.perfect = perfect
        self.merges = merges
        self.pattern = regex.compile(pattern)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        new, old, tokens = self.new, self.old, self.tokens
        missing = []
        for piece in pieces.difference(new):
            ids = old.get(piece)
            if ids is None:
                missing.append(piece)
            else:
                new[piece] = ids
        if not missing:
            return
        keys = [m.encode("utf-8", "replace") for m in missing]
        ranks = self.perfect.candidates(keys).tolist()
        rest = []
        for text, key, rank in zip(missing, keys, ranks, strict=True):
            if tokens[rank] == key:
                new[text] = rank.to_bytes(4, "little")
            else:
                rest.append((text, key))
        if rest:
            texts, keys = zip(*rest, strict=True)
            new.update((text, array("I", ids).tobytes()) for text, ids in zip(texts, self.merges(keys), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.pattern.findall(t) for t in texts]
        distinct: set[str] = set()
        for pieces in found:
            distinct.update(pieces)
        self._learn(distinct)
        known = self.new
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype="<u4") for pieces in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    The tables of both tiers are built once in the driver (their size is the vocabulary's) and travel with
    the task; texts are not shuffled.
    """
    tokens = load_ranks(path)
    perfect, merges = PerfectHash(tokens), Merges(tokens)

    def start():
        coder = TwoTier(tokens, perfect, merges, pattern)

        def of_texts(texts: list[str]) -> list[list]:
            ids = coder.encode(texts)
            out = [
                [len(x) for x in ids],
                [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids],
            ]
            return out + [ids] * with_ids

        return of_texts

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return per_text(whole_texts(docs), start, added | ({"ids": "array<long>"} if with_ids else {}))
